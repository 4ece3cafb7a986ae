"""Crowns found in tiles against the kernel on the whole raster."""

import numpy as np
import pytest

from greensward.functions import kernels as K
from greensward.operators import crowns as CR
from greensward.operators.grid import Grid


def forest(seed, n):
    """Heights of cones on sloping ground."""
    rng = np.random.default_rng(seed)
    rr, cc = np.indices((n, n)).astype(float)
    ground, top = 100 + 0.2 * rr + 0.1 * cc, np.zeros((n, n))
    for r, c, h, w in zip(rng.uniform(2, n - 3, 45), rng.uniform(2, n - 3, 45), rng.uniform(3, 18, 45), rng.uniform(2, 5, 45)):
        top = np.maximum(top, h * np.clip(1 - np.hypot(rr - r, cc - c) / w, 0, None))
    return ground, ground + top + rng.uniform(0, 0.02, (n, n))


def table(spark, h):
    return spark.createDataFrame([(int(r), int(c), float(h[r, c])) for r, c in np.argwhere(~np.isnan(h))], "row int, col int, h double")


@pytest.mark.parametrize(("seed", "tile"), [(1, 16), (2, 11)])
def test_crowns_at_borders_of_tiles_are_found_once(spark, seed, tile):
    ground, canopy = forest(seed, 48)
    grid = Grid(48, 48, 10.0, 20.0, 10.0 + 48 * 1.5, 20.0 + 48 * 1.5)
    want = K.detect_trees(ground, canopy, 1.5)
    got = CR.trees(table(spark, ground), table(spark, canopy), grid, tile=tile).collect()
    rows = sorted((round((r.z - 20) / 1.5 - 0.5, 6), round((r.x - 10) / 1.5 - 0.5, 6), round(r.radius, 6), round(r.height, 6)) for r in got)
    assert rows == sorted(tuple(round(v, 6) for v in w) for w in want) and len(rows) > 15


def test_gaps_errors_and_bare_ground(spark):
    ground, canopy = forest(4, 32)
    grid = Grid(32, 32, 0.0, 0.0, 48.0, 48.0)
    holes = np.where(np.random.default_rng(5).random((32, 32)) < 0.2, np.nan, ground)
    wrong = np.where(np.random.default_rng(6).random((32, 32)) < 0.02, 900.0, canopy)
    height = {(r.row, r.col): r.h for r in CR.canopy_height(table(spark, holes), table(spark, wrong), grid, rounds=1000, tolerance=1e-7).collect()}
    assert len(height) == 1024 and 0 <= min(height.values()) and max(height.values()) < 20
    found = CR.trees(table(spark, holes), table(spark, wrong), grid).collect()
    assert 8 < len(found) and all(0 < r.x < 48 and 3.5 <= r.height < 20 for r in found)
    assert CR.trees(table(spark, ground), table(spark, ground), grid).count() == 0
    assert CR.trees(table(spark, ground), table(spark, np.full((32, 32), np.nan)), grid).count() == 0
