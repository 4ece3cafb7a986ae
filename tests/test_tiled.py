"""Tiled operators against the kernels on whole arrays, with tiles so small that much crosses their borders."""

import numpy as np
import pytest

from greensward.functions import kernels as K
from greensward.operators import staging as ST
from greensward.operators import tiled as TI
from greensward.operators.grid import Grid


def grid(rows, cols):
    return Grid(rows, cols, 0.0, 0.0, cols * 3.0, rows * 2.0)


def table(spark, h):
    return spark.createDataFrame([(int(r), int(c), float(h[r, c])) for r, c in np.argwhere(~np.isnan(h))], "row int, col int, h double")


def array(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.select("row", "col", name).collect():
        if r[2] is not None:
            assert np.isnan(out[r.row, r.col])
            out[r.row, r.col] = r[2]
    return out


def holes(seed, shape, share):
    rng = np.random.default_rng(seed)
    return np.where(rng.random(shape) < share, np.nan, rng.random(shape) * 10)


@pytest.mark.parametrize("eight", [False, True])
def test_components_equal_labels_of_the_whole_array(spark, eight):
    h = holes(1, (23, 31), 0.42)
    got = array(TI.components(table(spark, h), grid(23, 31), 4, eight), "label", h.shape)
    assert (np.nan_to_num(got) == K.labels(~np.isnan(h), eight)).all()
    snake = np.full((16, 16), np.nan)  # one component that crosses every border, again and again
    snake[::2], snake[1::4, -1], snake[3::4, 0] = 1, 1, 1
    got = array(TI.components(table(spark, snake), grid(16, 16), 4), "label", snake.shape)
    assert set(got[~np.isnan(snake)]) == {1}


def test_no_cells_have_no_components(spark):
    assert TI.components(table(spark, np.full((3, 3), np.nan)), grid(3, 3)).count() == 0
    assert ST.smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_smallest_reachable_of_a_long_chain(spark):
    order = np.random.default_rng(2).permutation(300).tolist()
    edges = spark.createDataFrame([(a, b) for a, b in zip(order[:-1], order[1:])] + [(500, 501), (7, 7)], "a long, b long")
    assert {tuple(r) for r in ST.smallest_reachable(edges).collect()} == {(k, 0) for k in range(300)} | {(500, 500), (501, 500)}


@pytest.mark.parametrize("radius", [0, 1, 2])
def test_denoised_equals_the_kernel(spark, radius):
    h = holes(3, (24, 20), 0.7)
    got = {tuple(r) for r in TI.denoised(table(spark, h), grid(24, 20), radius, 5).collect()}
    assert got == {(int(r), int(c)) for r, c in np.argwhere(K.denoised(~np.isnan(h), radius))}


@pytest.mark.parametrize("share", [0.03, 0.5])
def test_nearest_sites_equal_brute_force(spark, share):
    on = np.random.default_rng(4).random((19, 26)) < share
    sites, g = np.argwhere(on), grid(19, 26)
    df = spark.createDataFrame([(int(r), int(c)) for r, c in sites], "row int, col int")
    for r in TI.nearest_sites(df, g, rows_at_once=4).collect():
        square = ((sites[:, 0] - r.row) * 2.0) ** 2 + ((sites[:, 1] - r.col) * 3.0) ** 2
        k = int(np.argmin(square))
        assert (r.near_row, r.near_col) == tuple(sites[k]) and r.d == pytest.approx(square[k] ** 0.5)


def test_distances_equal_the_kernel_and_are_null_without_empty_cells(spark):
    h = holes(5, (21, 17), 0.1)
    got = array(TI.distances(table(spark, h), grid(21, 17)), "d", h.shape)
    assert np.allclose(np.nan_to_num(got), K.distance_transform(~np.isnan(h), (2.0, 3.0)))
    full = TI.distances(table(spark, np.ones((3, 4))), grid(3, 4)).collect()
    assert len(full) == 12 and all(r.d is None for r in full)


def test_nearest_filled_up_to_a_distance(spark):
    h = np.full((3, 9), np.nan)
    h[1, 0] = 5.0
    got = array(TI.nearest_filled(table(spark, h), grid(3, 9), 6.1), "h", h.shape)
    assert (got[:, :3] == 5).sum() == 7 and np.isnan(got[:, 3:]).all()  # (0, 2) and (2, 2) are 6.3 m off


def test_relaxation_in_tiles_equals_relaxation_of_the_whole(spark):
    h = holes(6, (30, 26), 0.6)
    free = np.isnan(h)
    start = np.where(free, 5.0, h)
    df = spark.createDataFrame([(r, c, float(start[r, c]), bool(~free[r, c])) for r in range(30) for c in range(26)], "row int, col int, h double, known boolean")
    got = array(TI.relaxed(df, grid(30, 26), 12, 0.0, tile=8, halo=4), "h", h.shape)
    assert np.allclose(got, K.relax(start, free, 12, 0.0), atol=1e-12)


def test_finer_keeps_corners_and_equals_the_kernel(spark):
    h = np.random.default_rng(7).random((5, 5))
    got = array(TI.finer(table(spark, h), grid(5, 5), grid(9, 9)), "h", (9, 9))
    assert np.allclose(got, K.finer(h, 9))


def test_gaps_settle_to_the_mean_of_their_neighbours(spark):
    h = holes(8, (50, 40), 0.5)
    h[10:30, 5:25] = np.nan
    out = TI.gap_filled(table(spark, h), grid(50, 40), rounds=2000, tolerance=1e-7, smallest=8, tile=16, halo=16)
    got, known = array(out, "h", h.shape), ~np.isnan(h)
    assert (got[known] == h[known]).all() and {(r.row, r.col) for r in out.where("known").collect()} == {(r, c) for r, c in np.argwhere(known)}
    assert np.abs(K.relax(got, ~known, 1, 0.0) - got).max() < 1e-6
    assert got.min() >= np.nanmin(h) and got.max() <= np.nanmax(h)


def test_rasters_without_data_or_gaps(spark):
    none = TI.gap_filled(table(spark, np.full((4, 4), np.nan)), grid(4, 4)).collect()
    assert len(none) == 16 and all(r.h is None and not r.known for r in none)
    h = np.random.default_rng(9).random((4, 4))
    assert (array(TI.gap_filled(table(spark, h), grid(4, 4)), "h", h.shape) == h).all()
