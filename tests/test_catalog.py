"""Every query with SQL gives the SQL's result on the smallest tables; the others run and keep their invariants."""

import os

import pytest

from greensward.plans.catalog import QUERIES, SQL, ground, tiles
from greensward.sources import adapters as A

from .oracle import connect, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    same(QUERIES[name](spark, SF), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    df = QUERIES[name](spark, SF)
    assert df.count() > 0 and not any("nan" in str(r).lower() for r in df.limit(50).collect())


def test_tiles_hold_all_of_the_ground(spark):
    got = {(r.raster // 2 * 50 + r.row, r.raster % 2 * 50 + r.col): r.h for r in tiles(spark, SF).collect()}
    assert got == {(r.row, r.col): r.h for r in ground(spark, SF).collect()}


def test_trees_come_from_all_points_and_their_own_heights(spark):
    got = QUERIES["tree_detect"](spark, SF).collect()
    assert {r.raster for r in got} == set(range(16)) and len({round(r.height, 3) for r in got}) > 20


def test_clipped_areas_equal_areas_of_strips(spark):
    def area(ring):
        """The diamond's part in the box, by the heights of many thin strips."""
        cx, cz, rad = ring[1].x, ring[0].z, ring[0].x - ring[1].x
        step, total = 2 * rad / 20_000, 0.0
        for i in range(20_000):
            x = cx - rad + (i + 0.5) * step
            if 200 <= x <= 1800:
                half = rad - abs(x - cx)
                total += max(0.0, min(1800, cz + half) - max(200, cz - half)) * step
        return total

    got, full = [QUERIES[q](spark, "/root/testdata/sf0.01").collect() for q in ("clipped_areas", "clip_area")]
    rings = {r.poly: r.ring for r in A.polygons(spark, "/root/testdata/sf0.01").collect()}
    want = {p: a for p, ring in rings.items() if (a := area(ring)) > 0}
    assert {r.poly for r in got} == set(want) and len(got) > len(full)
    assert all(r.area == pytest.approx(want[r.poly], rel=1e-4, abs=1e-2) for r in got)


def test_heights_are_fitted_to_the_ground_that_earlier_stamps_made(spark):
    got, in_order, stamps = QUERIES["height_fit"](spark, SF).collect(), QUERIES["height_fit_in_order"](spark, SF).collect(), A.stamps(spark, SF).collect()
    target, tool, value = {r.seq: r.target for r in in_order}, {r.seq: r.tool for r in stamps}, {r.seq: r.value for r in got}
    assert value == pytest.approx({r.seq: r.value for r in in_order}, abs=1e-5)
    fitted = [k for k in value if target[k] is not None]
    assert all(value[k] == target[k] for k in fitted if not tool[k]) and any(value[k] < target[k] - 100 for k in fitted if tool[k])
