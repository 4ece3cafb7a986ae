"""Traces and simplified lines against the kernels, region by region; bands filled from their edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from greensward.functions import kernels as K
from greensward.operators import fallline as FL
from greensward.operators import outlines as OU
from greensward.operators.grid import Grid


def blobs(seed, shape=(26, 30), share=0.5):
    rng = np.random.default_rng(seed)
    h = rng.normal(size=shape)
    for _ in range(4):
        h = K.relax(h, np.ones(shape, bool), 1, 0.0)
    return h > np.quantile(h, share)


def cells(spark, mask, **more):
    rows = [(int(r), int(c)) for r, c in np.argwhere(mask)]
    return spark.createDataFrame(rows, "row int, col int").withColumns({k: F.lit(v) for k, v in more.items()})


def grid(mask):
    return Grid(*mask.shape, 10.0, 20.0, 10.0 + 2.0 * mask.shape[1], 20.0 + 2.0 * mask.shape[0])


@pytest.mark.parametrize("seed", [1, 2])
def test_traces_equal_the_kernel(spark, seed):
    mask = blobs(seed) | (np.random.default_rng(seed).random((26, 30)) < 0.03)
    label = K.labels(mask)
    rows = [(int(label[r, c]), int(r), int(c)) for r, c in np.argwhere(mask)]
    got = {}
    for r in OU.traced(spark.createDataFrame(rows, "label int, row int, col int"), grid(mask), "label").orderBy("i").collect():
        got.setdefault(r.label, []).append((r.row, r.col))
    want = {int(k): K.boundary(label == k, divmod(int(k) - 1, 30)) for k in np.unique(label[label > 0])}
    assert got == want and max(map(len, want.values())) > 30


def test_lines_are_simplified_as_by_the_kernel(spark):
    rng = np.random.default_rng(4)
    lines = {k: np.cumsum(rng.normal(size=(n, 2)), axis=0) for k, n in enumerate([60, 33, 2, 1])}
    lines[4] = np.array([(0.0, 0.0), (5.0, 1.0), (9.0, 2.0), (0.0, 0.0)])  # its ends meet
    rows = [(k, i, float(p[1]), float(p[0])) for k, line in lines.items() for i, p in enumerate(line)]
    got = OU.simplified(spark.createDataFrame(rows, "line int, i long, x double, z double"), ["line"], 1.2).collect()
    for k, line in lines.items():
        want = K.simplified(line, 1.2)
        assert np.allclose(sorted((r.z, r.x) for r in got if r.line == k), sorted({tuple(p) for p in want} if k != 4 else map(tuple, want)))


def test_rings_and_the_holes_they_hold(spark):
    mask = np.zeros((30, 30), bool)
    mask[2:20, 2:22] = True
    mask[5:15, 5:15] = False  # a hole with an island that has a hole itself
    mask[7:13, 7:13] = True
    mask[9:11, 9:11] = False
    mask[22:28, 3:9] = True
    mask[25:, 25:] = True
    mask[27, 27] = False  # one cell is no ring
    rings = OU.region_rings(cells(spark, mask), grid(mask), 0.5, tile=7).collect()
    at = lambda r, c: 1 + r * 30 + c
    assert {(r.region, r.ring) for r in rings} == {(at(2, 2), 0), (at(2, 2), at(5, 5)), (at(2, 2), at(9, 9)), (at(7, 7), 0), (at(7, 7), at(9, 9)), (at(22, 3), 0), (at(25, 25), 0)}
    outer = sorted((r.x, r.z) for r in rings if r.region == at(22, 3))
    assert set(outer) == {(17.0, 65.0), (27.0, 65.0), (17.0, 75.0), (27.0, 75.0)} | set(outer) and len(outer) <= 5
    assert all(r.hole == (r.ring != 0) for r in rings)
    assert OU.region_rings(cells(spark, mask).limit(0), grid(mask)).count() == 0


def test_bands_are_filled_from_their_edges(spark):
    high = blobs(6, (24, 28), 0.45)
    g = grid(high)
    banded = cells(spark, high, band=1).withColumn("h", 100.0 + F.col("row")).unionByName(cells(spark, ~high, band=0).withColumn("h", 10.0 + F.col("col")))
    out = FL.fallline_stamps(banded, g, reach=12.0, least=4.0, tolerance=2.0, denoise=0, crumb_radius=6.0, crumb_share=0.7, tile=9)
    rows = out.collect()
    assert {r["pass"] for r in rows} == {1, 2} and {r.band for r in rows} == {0, 1}
    held = FL.rectangle_cells(out.where("pass = 1"), g).select("band", "row", "col").distinct()
    covered = {(r.band, r.row, r.col) for r in held.collect()}
    for r in rows:
        if r["pass"] == 2:
            covered |= {(r.band, a, b) for a in range(24) for b in range(28) if np.hypot((a - r.row) * 2.0, (b - r.col) * 2.0) <= 4.2}
    assert {(int(high[r, c]), int(r), int(c)) for r, c in np.argwhere(high | True)} <= covered
    assert all(r.value is not None and 10 <= r.value <= 124 for r in rows)
    again = FL.fallline_stamps(banded.repartition(3), g, reach=12.0, least=4.0, tolerance=2.0, denoise=0, crumb_radius=6.0, crumb_share=0.7, tile=30)
    key = lambda r: (r.band, r["pass"], r.region, r.ring, r.i, r.row, r.col, round(r.value, 6))
    assert sorted(map(key, again.collect()), key=str) == sorted(map(key, rows), key=str)
