"""Hotspots found window by window against the loop that takes the deepest place of the whole raster, one after the other."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from greensward.functions import kernels as K
from greensward.operators import refine as RE
from greensward.operators import stamps as ST
from greensward.operators.grid import Grid
from greensward.sources import adapters as A

NO_STAMPS = "seq long, x double, z double, scale_x double, scale_z double, value double, brush int, rotation double, tool int"


def far(flagged, cell_z, cell_x):
    other = np.argwhere(~flagged)
    out = np.zeros(flagged.shape)
    for r, c in np.argwhere(flagged):
        out[r, c] = np.sqrt(((other[:, 0] - r) * cell_z) ** 2 + ((other[:, 1] - c) * cell_x) ** 2).min(initial=np.inf)
    return out


def in_order(error, height, grid, how):
    """(row, col, side, radius) one after the other, distances measured anew each time."""
    done, out = np.isnan(error), []
    error = np.nan_to_num(error)
    rr, cc = np.indices(error.shape)
    while True:
        sides = [(s * error > how.tolerance) & ~done for s in (1, -1)]
        depth = [far(f, grid.cell_z, grid.cell_x) for f in sides]
        k = 0 if depth[0].max() >= depth[1].max() else 1
        r, c = np.unravel_index(np.argmax(depth[k]), error.shape)
        deep = depth[k][r, c]
        if deep < how.least_cells * min(grid.cell_z, grid.cell_x) or deep <= 0:
            return out
        apart = np.sqrt(((rr - r) * grid.cell_z) ** 2 + ((cc - c) * grid.cell_x) ** 2)
        radius = min(max(deep, how.smallest), how.largest)
        known = ~np.isnan(height)
        done[r, c] = True
        x, z = grid.min_x + (cc[known] + 0.5) * grid.cell_x, grid.min_z + (rr[known] + 0.5) * grid.cell_z
        square = (x - (grid.min_x + (c + 0.5) * grid.cell_x)) ** 2 + (z - (grid.min_z + (r + 0.5) * grid.cell_z)) ** 2
        if (square <= min(how.largest, radius * how.widest) ** 2).sum() < how.least_points:
            continue
        while how.planar is not None and radius > how.smallest:
            near = square <= radius * radius
            if near.sum() < how.least_points or RE.plane_rms(x[near], z[near], height[known][near]) <= how.planar:
                break
            radius = max(radius * how.shrink, how.smallest)
        done |= sides[k] & (apart <= radius * how.claim)
        out.append((int(r), int(c), 1 - 2 * k, round(float(radius), 9)))


def ground(seed, shape, smooth=2):
    rng = np.random.default_rng(seed)
    h = rng.normal(size=shape)
    for _ in range(smooth):
        h = K.relax(h, np.ones(shape, bool), 1, 0.0)
    h = h / h.std() * 4
    h[rng.random(shape) < 0.04] = np.nan
    return h


def table(spark, h):
    return spark.createDataFrame([(int(r), int(c), float(h[r, c])) for r, c in np.argwhere(~np.isnan(h))], "row int, col int, h double")


@pytest.mark.parametrize(
    ("seed", "tile", "halo", "more"),
    [
        (1, 8, 4, {}),
        (2, 8, 8, {"claim": 0.5}),
        (3, 16, 8, {"planar": 1.5, "smallest": 2.0, "largest": 9.0}),
        (4, 5, 2, {"least_points": 9, "least_cells": 2.0}),
    ],
)
def test_windows_find_what_the_loop_finds(spark, seed, tile, halo, more):
    h = ground(seed, (26, 34))
    grid = Grid(26, 34, 5.0, -3.0, 5.0 + 34 * 3.0, -3.0 + 26 * 2.0)
    how = RE.Refinement(**{"tolerance": 1.0, "smallest": 3.0, "largest": 6.0, **more})
    got = RE.hotspots(spark.createDataFrame([], NO_STAMPS), table(spark, h), grid, grid, A.brush_profiles(spark), how, tile=tile, halo=halo)
    rows = sorted(got.collect(), key=lambda r: r.hotspot)
    want = in_order(-h, h, grid, how)
    assert [(r.row, r.col, r.side, round(r.radius, 9)) for r in rows] == want and len(want) > 8
    assert [r.hotspot for r in rows] == list(range(1, len(rows) + 1))
    for r in rows:  # a stamp of its own lowers the error there
        assert r.x == pytest.approx(5.0 + (r.col + 0.5) * 3.0) and r.rms is not None and r.brush in (8, 9, 10, 54)


def test_windows_alone_agree_with_the_loop_on_many_rasters():
    """The rounds of windows without Spark: rows of each window as the operators make them."""
    for seed in range(12):
        rng = np.random.default_rng(seed)
        shape = tuple(int(n) for n in rng.integers(6, 22, 2))
        h = ground(seed, shape, int(rng.integers(0, 4)))
        grid = Grid(*shape, 0.0, 0.0, shape[1] * 2.0, shape[0] * (3.0 if seed % 2 else 2.0))
        how = RE.Refinement(tolerance=float(rng.choice([0.5, 2.0])), smallest=2.0, largest=float(rng.choice([3.0, 5.0])), claim=float(rng.choice([1.0, 0.6])), least_points=int(rng.choice([0, 6])))
        tile, halo, known = int(rng.integers(3, 9)), int(rng.integers(1, 7)), []
        rr, cc = np.nonzero(~np.isnan(h))
        points = grid.min_x + (cc + 0.5) * grid.cell_x, grid.min_z + (rr + 0.5) * grid.cell_z, h[rr, cc]
        while True:
            found = []
            for i in range((shape[0] - 1) // tile + 1):
                for j in range((shape[1] - 1) // tile + 1):
                    near = (rr >= i * tile - halo) & (rr < (i + 1) * tile + halo) & (cc >= j * tile - halo) & (cc < (j + 1) * tile + halo)
                    frame = pd.DataFrame({"tile_row": i, "tile_col": j, "row": rr[near], "col": cc[near], "error": -h[rr[near], cc[near]], "done": False, "side": np.nan, "depth": np.nan, "claim": np.nan})
                    told = pd.DataFrame([(i, j, r, c, np.nan, True, s, d, (q or 0.0) * how.claim) for r, c, s, d, q, *_ in known], columns=frame.columns)
                    if len(frame):
                        found += RE.sides(pd.concat([frame, told]) if len(told) else frame, tuple(p[near] for p in points), (1, -1), grid, how, tile, halo)
            here = [f for f in found if f[0] is not None]
            known += here
            if len(here) == len(found):
                break
            halo = halo if here else 2 * halo
        got = sorted(((r, c, s, round(q, 9)) for r, c, s, _, q, *_ in known if q is not None))
        assert got == sorted(in_order(-h, h, grid, how)), seed


def test_an_area_without_edges_is_one_window(spark):
    grid = Grid(20, 20, 0.0, 0.0, 40.0, 40.0)
    h = np.full((20, 20), 5.0)
    h[0, 0] = 0.0
    how = RE.Refinement(tolerance=1.0, smallest=4.0, largest=8.0)
    got = RE.hotspots(spark.createDataFrame([], NO_STAMPS), table(spark, h), grid, grid, A.brush_profiles(spark), how, tile=4, halo=1)
    assert [(r.row, r.col, r.side, round(r.radius, 9)) for r in sorted(got.collect(), key=lambda r: r.hotspot)] == in_order(-h, h, grid, how)


def residual(spark, stamps, raster, grid):
    now = ST.render(grid, stamps, A.brush_profiles(spark)).withColumnRenamed("h", "now")
    return raster.join(now, ["row", "col"], "left").select(F.sqrt(F.avg(F.pow(F.coalesce("now", F.lit(0.0)) - F.col("h"), F.lit(2)))).alias("rms")).first().rms


@pytest.mark.parametrize("rebuild", [False, True])
def test_passes_come_nearer_to_the_ground(spark, rebuild):
    h = ground(7, (24, 24), 6)
    fine, coarse = Grid(24, 24, 0.0, 0.0, 48.0, 48.0), Grid(12, 12, 0.0, 0.0, 48.0, 48.0)
    raster, none = table(spark, h), spark.createDataFrame([], NO_STAMPS)
    how = RE.Refinement(tolerance=0.8, smallest=4.0, largest=9.0, claim=0.6)
    out = RE.refined(none, raster, fine, coarse, A.brush_profiles(spark), how, passes=2, decay=0.7, tile=6, halo=4, rebuild=rebuild)
    seq = sorted(r.seq for r in out.collect())
    assert seq == list(range(1, len(seq) + 1)) and len(seq) > 20
    assert residual(spark, out, raster, fine) < 0.75 * residual(spark, none, raster, fine)
    few = RE.refined(none, raster, fine, coarse, A.brush_profiles(spark), how, most=3, tile=6, halo=4, rebuild=rebuild)
    assert few.count() == 3


def test_nothing_to_refine(spark):
    grid = Grid(4, 4, 0.0, 0.0, 8.0, 8.0)
    none = spark.createDataFrame([], NO_STAMPS)
    how = RE.Refinement(tolerance=1.0)
    for raster in (table(spark, np.zeros((4, 4))), table(spark, np.full((4, 4), np.nan))):
        for rebuild in (False, True):
            assert RE.hotspots(none, raster, grid, grid, A.brush_profiles(spark), how, rebuild=rebuild).count() == 0
    masked = RE.hotspots(none, table(spark, np.full((4, 4), 9.0)), grid, grid, A.brush_profiles(spark), how, mask=table(spark, np.zeros((4, 4))).where("row = 0"))
    assert {r.row for r in masked.collect()} == {0}


def test_numbers_follow_the_order(spark):
    rows = spark.createDataFrame([(k * 37 % 101, k) for k in range(101)], "a int, b int").repartition(5)
    got = RE.numbered(rows, "n", F.desc("a"), F.col("b")).collect()
    assert {(r.a, r.n) for r in got} == {(a, 101 - a) for a in range(101)}


@pytest.mark.parametrize("tile", [4, 64])
def test_a_mask_of_the_whole_raster_has_no_deepest_cell(spark, tile):
    grid = Grid(rows=9, cols=9, max_x=90.0, max_z=90.0)
    whole = grid.cells(spark).withColumn("band", F.lit(1))
    assert RE.deepest_first(whole, grid, 20.0, "band", tile=tile, halo=2).count() == 0
    assert RE.deepest_first(whole.where("row > 0"), grid, 20.0, "band", tile=tile, halo=2).count() > 0
