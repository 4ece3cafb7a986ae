"""Discs, crumbs, pruning and hole numbers against loops that take one after the other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from greensward.functions import kernels as K
from greensward.operators import objects as OB
from greensward.operators import packing as PA
from greensward.operators import pruning as PR
from greensward.operators import refine as RE
from greensward.operators import tiled as TI
from greensward.operators.grid import Grid

from .test_refine import far

GRID = Grid(20, 24, 0.0, 0.0, 48.0, 60.0)  # cells of 2 m by 3 m


def bands(seed, n=3):
    rng = np.random.default_rng(seed)
    h = rng.normal(size=(20, 24))
    for _ in range(3):
        h = K.relax(h, np.ones(h.shape, bool), 1, 0.0)
    band = np.digitize(h, np.quantile(h, np.linspace(0, 1, n + 1)[1:-1]))
    return np.where(rng.random(h.shape) < 0.03, -1, band)


def cells(spark, band):
    return spark.createDataFrame([(int(band[r, c]), int(r), int(c), float(100 + 10 * band[r, c])) for r, c in np.argwhere(band >= 0)], "band int, row int, col int, h double")


def test_depths_are_distances_out_of_the_mask_of_the_key(spark):
    band = bands(1)
    got = {(r.band, r.row, r.col): r.depth for r in TI.depths(cells(spark, band), GRID, "band", 4).collect()}
    for b in range(3):
        deep = far(band == b, 3.0, 2.0)
        assert all(got.pop((b, r, c)) == pytest.approx(deep[r, c]) for r, c in np.argwhere(band == b).tolist())
    assert not got
    assert [r.depth for r in TI.depths(cells(spark, np.zeros((20, 24), int)), GRID, "band").limit(3).collect()] == [None] * 3


def test_denoised_masks_of_several_keys(spark):
    band = bands(2)
    got = {tuple(r) for r in TI.denoised(cells(spark, band), GRID, 1, 6, "band").collect()}
    assert got == {(b, int(r), int(c)) for b in range(3) for r, c in np.argwhere(K.denoised(band == b, 1))}


def test_discs_are_those_that_a_loop_takes(spark):
    band, radii = bands(3), [9.0, 6.0, 4.0]
    mask = cells(spark, band)
    rows = PA.candidates(TI.depths(mask, GRID, "band"), "band", radii, 0.6, 0.5, 25, 7).collect()
    assert all(sum(r.band == b and r.tier == k for r in rows) <= 25 for b in range(3) for k in range(3))
    taken = []
    for r in sorted(rows, key=lambda r: (r.band, r.tier, r.lot, r.row, r.col)):
        if all(b != r.band or np.hypot((r.row - a) * 3.0, (r.col - c) * 2.0) >= (r.radius + q) * 0.6 for b, a, c, q in taken):
            taken.append((r.band, r.row, r.col, r.radius))
    got = PA.packed(mask, GRID, "band", radii, 0.6, 0.5, 25, 7).collect()
    assert sorted((r.band, r.row, r.col, r.radius) for r in got) == sorted(taken) and len(taken) > 20
    assert PA.packed(mask, GRID, "band", radii, 0.0).count() == 0


def test_a_chain_takes_every_second(spark):
    nodes = spark.createDataFrame([(k,) for k in range(1, 30)], "n long")
    edges = spark.createDataFrame([(k, k + 1) for k in range(1, 29)], "a long, b long")
    assert sorted(r.n for r in PA.first_free(nodes, edges).collect()) == list(range(1, 30, 2))


@pytest.mark.parametrize(("tile", "halo"), [(5, 2), (8, 8)])
def test_crumbs_are_covered_from_the_deepest(spark, tile, halo):
    band = bands(4, 2)
    got = RE.deepest_first(cells(spark, band), GRID, 4.0, "band", tile, halo).collect()
    for b in range(2):
        left, want = band == b, []
        rr, cc = np.indices(left.shape)
        while left.any():
            deep = far(left, 3.0, 2.0)
            r, c = np.unravel_index(np.argmax(deep), deep.shape)
            want.append((int(r), int(c), round(float(deep[r, c]), 9)))
            left = left & (np.sqrt(((rr - r) * 3.0) ** 2 + ((cc - c) * 2.0) ** 2) > 4.0)
        assert sorted((r.row, r.col, round(r.depth, 9)) for r in got if r.band == b) == sorted(want)


def test_contour_stamps_cover_every_cell_of_the_region(spark):
    band = bands(5)
    region = cells(spark, band).where("col < 15")
    out = PA.contour_stamps(cells(spark, band), GRID, 8.0, 4.0, 0.7, 0.6, denoise=0, crumb_radius=6.0, crumb_share=0.8, region=region)
    reach = F.when(F.col("pass") == 1, F.col("radius") * 0.6).otherwise(4.8)
    covered = {(r.band, r.row, r.col) for r in PA.covered_cells(out, "band", GRID, reach).collect()}
    rows = out.collect()
    assert {(int(band[r, c]), int(r), int(c)) for r, c in np.argwhere(band >= 0) if c < 15} <= covered
    assert all(r.col < 15 and r.value == 100 + 10 * r.band for r in rows) and {r["pass"] for r in rows} == {1, 2}
    assert PA.contour_stamps(cells(spark, band).limit(0), GRID).count() == 0


def test_values_of_the_nearest_cells_square_by_square(spark):
    raster = spark.createDataFrame([(0, 0, 1.0), (5, 3, 2.0), (3, 5, 3.0), (19, 23, None)], "row int, col int, h double")
    sites = spark.createDataFrame([(1, 0, 0), (2, 4, 4), (3, 1, 1), (4, 19, 23), (5, 3, 0)], "site int, row int, col int")
    assert {tuple(r) for r in TI.nearest_values(sites, raster, "site", 10).collect()} == {(1, 1.0), (2, 3.0), (3, 1.0), (4, 0.0), (5, 1.0)}


def test_pruned_stamps_are_those_of_the_loop(spark):
    rng = np.random.default_rng(6)
    weights, flatten = [], []
    for _ in range(60):
        r, c, n = rng.integers(0, 8, 3)
        at = [(r + i) * 16 + c + j for i in range(n // 2 + 1) for j in range(n // 2 + 1)]
        weights.append((np.array(at if n < 7 else [], int), rng.choice([0.0, 0.0005, 0.4, 0.97, 1.0, 1.0], len(at) if n < 7 else 0)))
        flatten.append(bool(rng.random() < 0.7))
    hits = [(k, int(a) // 16, int(a) % 16, float(w)) for k, (at, ws) in enumerate(weights) for a, w in zip(at, ws)]
    stamps = spark.createDataFrame([(k, 0 if f else 1) for k, f in enumerate(flatten)], "seq long, tool int")
    got = {r.seq: r.keep for r in PR.pruned(stamps, spark.createDataFrame(hits, "seq long, row int, col int, w double")).collect()}
    want = K.prune(weights, flatten, 256)
    assert [got[k] for k in range(60)] == want and 5 < sum(want) < 55
    assert PR.pruned(stamps.limit(0), spark.createDataFrame([], "seq long, row int, col int, w double")).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_hole_numbers_are_those_of_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    refs = [None if x < 0 else int(x) for x in rng.choice([-1, 0, 0, 0, 0, 2, 3, 7, 9, 12, 15, 40], 60, p=[0.05] + [0.15] * 4 + [0.05] * 7)]
    rows = [(k, r, 3, [(float(k), 0.0)] * (1 if k % 11 == 5 else 3)) for k, r in enumerate(refs)]
    known, last = set(), {}
    for k, r, _, pts in rows:
        if len(pts) >= 2:
            n = -1 if r is None else len(known) + 1 if r == 0 else r
            known.add(n)
            last[n] = k
    df = spark.createDataFrame(rows, "seq long, ref int, par int, pts array<struct<x: double, z: double>>").repartition(3)
    assert {r.hole: r.seq for r in OB.ordered_holes(df).collect()} == last
