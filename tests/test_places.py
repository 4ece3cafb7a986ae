"""What joins by place do with many rows at one place: looked up once, dealt to many tasks, never broadcast; the results are those of plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from greensward.operators import fitting as FI
from greensward.operators import objects as OB
from greensward.operators import placement as PL
from greensward.operators import raster as RA
from greensward.operators import spatial as SP
from greensward.operators.grid import Grid, sample_mean
from greensward.sources import adapters as A

RING = "poly long, ring array<struct<x:double,z:double>>"
SQUARE = [(10.0, 10.0), (30.0, 10.0), (30.0, 30.0), (10.0, 30.0)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sites_at_one_place_get_the_same_mean_without_a_broadcast(spark):
    grid = Grid(rows=5, cols=5, max_x=50.0, max_z=50.0)
    raster = grid.cells(spark).withColumn("h", (F.col("row") * 5 + F.col("col")).cast("double")).hint("merge")
    sites = spark.createDataFrame([(1, 25.0, 25.0), (2, 25.0, 25.0), (3, 900.0, 25.0), (4, None, 25.0)], "site long, x double, z double")
    got = sample_mean(sites, raster, grid, "site", F.lit(10.0), 3)
    assert "Broadcast" not in plan(got)
    assert sorted(map(tuple, got.collect())) == [(1, 5, 12.0), (2, 5, 12.0), (3, 0, None), (4, 0, None)]


def test_heights_of_trees_are_rounded_as_doubles(spark, tmp_path):
    spark.createDataFrame([(1, 2.0), (3, 6.0), (4, 1382.0)], "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r.tree: r.tags["pga_tree_height"] for r in A.trees(spark, str(tmp_path)).collect()}
    want = {k: str(np.floor((v / 400.0 + 2) * 100 + 0.5) / 100) for k, v in ((1, 2.0), (3, 6.0), (4, 1382.0))}
    assert got == want


@pytest.mark.parametrize(("buffer", "keys"), [(3.0, {1, 2, 3}), (-3.0, {1, 2})])
def test_points_at_one_place_are_tested_once(spark, buffer, keys):
    points = spark.createDataFrame([(1, 20.0, 20.0), (2, 20.0, 20.0), (3, 8.0, 20.0), (4, 5.0, 20.0)], "p long, x double, z double")
    polygons = spark.createDataFrame([(7, SQUARE)], RING)
    held = SP.in_polygons(points, polygons, "p")
    assert "Broadcast" not in plan(held) and {r.p for r in held.collect()} == {1, 2}
    assert {r.p for r in SP.within_buffer(points, polygons, "p", buffer).collect()} == keys


def test_nearest_segments_in_steps_of_reach(spark):
    rng = np.random.default_rng(3)
    ends = rng.uniform(0, 300, (30, 2))
    lines = [(k, *a, *(a + d)) for k, (a, d) in enumerate(zip(ends, rng.uniform(-60, 60, (30, 2))))]
    lines += [(k + 100, *line) for k, *line in lines] + [(50, 5.0, 5.0, 5.0, 5.0)]
    places = rng.uniform(-100, 400, (60, 2))
    points = spark.createDataFrame([(i, float(x), float(z)) for i, (x, z) in enumerate(np.vstack((places, places[:5])))], "p long, x double, z double")
    got = SP.nearest_segment(points, spark.createDataFrame([(int(k), *map(float, v)) for k, *v in lines], "s long, x1 double, z1 double, x2 double, z2 double"), "p", "s", 100.0)
    want = {}
    for i, (x, z) in enumerate(np.vstack((places, places[:5]))):
        best = (np.inf, 0)
        for k, x1, z1, x2, z2 in lines:
            length = (x2 - x1) ** 2 + (z2 - z1) ** 2
            t = max(0.0, min(1.0, ((x - x1) * (x2 - x1) + (z - z1) * (z2 - z1)) / length)) if length else 0.0
            best = min(best, (float(np.hypot(x - x1 - t * (x2 - x1), z - z1 - t * (z2 - z1))), k))
        if best[0] <= 100:
            want[i] = (best[1], round(best[0], 6))
    assert {r.p: (r.s, round(r.distance, 6)) for r in got.collect()} == want


def test_relocated_trees_go_by_places_as_a_plain_loop_moves_them(spark, monkeypatch):
    rng = np.random.default_rng(5)
    ends = rng.uniform(0, 120, (60, 2))
    lines = [tuple(map(float, (*a, *(a + d)))) for a, d in zip(ends, rng.uniform(-40, 40, (60, 2)))]
    lines += lines[:9] + [(150.0, 150.0, 150.0, 150.0), (200.0, 0.0, 200.0, 20.0), (203.0, 0.0, 203.0, 20.0)]
    places = [*map(tuple, rng.uniform(-5, 125, (80, 2)).tolist()), (150.0, 151.0), (201.0, 10.0), (202.85, 10.0), (900.0, 900.0)]
    trees = [(i, *places[i % len(places)]) for i in range(10 * len(places))] + [(9999, None, 1.0), (9998, 1.0, None)]
    sizes, cut = [], OB.cut

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(OB, "cut", counted)
    segments = spark.createDataFrame([(k, *line) for k, line in enumerate(lines)], "path long, x1 double, z1 double, x2 double, z2 double")
    got = OB.relocated(spark.createDataFrame(trees, "tree long, x double, z double"), segments).collect()

    def goes(x, z):
        moved = 0
        for _ in range(8):
            best = (np.inf,)
            for x1, z1, x2, z2 in lines:
                dx, dz = x2 - x1, z2 - z1
                length = dx * dx + dz * dz
                t = max(0.0, min(1.0, ((x - x1) * dx + (z - z1) * dz) / length)) if length else 0.0
                best = min(best, (float(np.hypot(x - x1 - t * dx, z - z1 - t * dz)), (x1, z1, x2, z2), t))
            if best[0] >= 2.85 or best[1][:2] == best[1][2:]:
                break
            (x1, z1, x2, z2), t = best[1:]
            dx, dz = x2 - x1, z2 - z1
            length = np.hypot(dx, dz)
            push = 2.9 if (x - x1) * -dz + (z - z1) * dx >= 0 else -2.9
            x, z, moved = x1 + t * dx - dz / length * push, z1 + t * dz + dx / length * push, moved + 1
        return round(x, 6), round(z, 6), moved

    want = {p: goes(*p) for p in places}
    assert {r.tree: (r.x and round(r.x, 6), r.z and round(r.z, 6), r.moved) for r in got} == {i: want[x, z] if x and z else (x, z, 0) for i, x, z in trees}
    assert len(got) == len(trees) and {0, 1, 8} <= {m for *_, m in want.values()}
    assert max(sizes) <= len(places) + 2 and sizes[-1] < sizes[0] and not spark.sparkContext._jsc.getPersistentRDDs()


def test_trees_at_one_place_are_moved_clear_once(spark, monkeypatch):
    sizes, cut = [], FI.cut

    def counted(df):
        out = cut(df)
        sizes.append(out.count())
        return out

    monkeypatch.setattr(FI, "cut", counted)
    segments = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 50.0), (2, 4.0, 0.0, 4.0, 50.0)], "path long, x1 double, z1 double, x2 double, z2 double")
    places = [(1.0, 25.0), (5.0, 20.0), (90.0, 20.0)]
    trees = [(i, *places[i % 3]) for i in range(90)] + [(90, None, 1.0)]
    got = {r.tree: tuple(r)[1:] for r in FI.moved_clear(spark.createDataFrame(trees, "tree long, x double, z double"), segments, spark.createDataFrame([(9.0, 9.0)], "x double, z double")).collect()}
    want = [(-2.9, 25.0, 1, 2.85), (6.9, 20.0, 1, 2.85), (90.0, 20.0, 0, 2.85)]
    assert got == {i: want[i % 3] for i in range(90)} | {90: (None, 1.0, 0, 2.85)}
    assert max(sizes) <= 2 * len(places) and not spark.sparkContext._jsc.getPersistentRDDs()


def test_balls_by_cells_hold_the_points_of_balls(spark):
    rng = np.random.default_rng(4)
    rows = [(float(x), float(z), float(v)) for x, z, v in rng.uniform(0, 60, (3000, 3))]
    points = spark.createDataFrame(rows + [(30.0, 20.0, None)], "x double, z double, v double")
    probes = spark.createDataFrame([(1, 30.0, 30.0), (2, 30.0, 30.0), (3, 1.0, 59.0), (4, 500.0, 0.0)], "k long, x double, z double")
    got = {r.k: (r.n, round(r["mean"], 6)) for r in PL.ball_means(points, probes, "k", 10.0, "v").collect()}
    want = {r.k: (r.n, round(r.m, 6)) for r in PL.in_ball(points, probes, "k", 10.0).groupBy("k").agg(F.count("*").alias("n"), F.avg("v").alias("m")).collect()}
    assert got == want and set(got) == {1, 2, 3}


def test_polygons_of_one_file_are_packed_in_many_tasks(spark):
    polygons = spark.createDataFrame([(k, SQUARE) for k in range(40)], RING).coalesce(1)
    got = RA.packed_circles(polygons, 4.0)
    assert got.withColumn("task", F.spark_partition_id()).select("task").distinct().count() > 1 and got.select("poly").distinct().count() == 40


def test_what_a_full_flatten_stamp_lies_over_waits_for_nothing(spark, monkeypatch):
    grid = Grid(rows=5, cols=5, max_x=50.0, max_z=50.0)
    raster = grid.cells(spark).withColumn("h", F.lit(7.0))
    rows = [(k, 25.0, 25.0, 20.0, 20.0, 1.0, 72, 0.0, 1 - k % 2) for k in range(1, 25)]
    stamps = spark.createDataFrame(rows, "seq long, x double, z double, scale_x double, scale_z double, value double, brush int, rotation double, tool int")
    calls, cut = [], FI.cut
    monkeypatch.setattr(FI, "cut", lambda df: calls.append(1) or cut(df))
    got = {r.seq: round(r.value, 6) for r in FI.fitted_in_order(stamps, raster, grid, A.brush_profiles(spark)).collect()}
    assert got == {k: 7.0 if k % 2 else 0.0 for k in range(1, 25)} and len(calls) < 15


def test_a_long_chain_of_raise_stamps_takes_few_rounds(spark, monkeypatch):
    grid = Grid(rows=20, cols=20, max_x=200.0, max_z=200.0)
    raster = grid.cells(spark).withColumn("h", 50.0 + F.col("row") + 0.5 * F.col("col")).cache()
    where = lambda k: (60.0 + 1.3 * (k % 50), 60.0 + 7.0 * (k % 9))
    rows = [(k, *where(k), 20.0 + k % 3 * 10, 20.0 + k % 3 * 10, 4.0, (8, 9, 54)[k % 3], 0.0, int(k % 17 > 0)) for k in range(1, 121)]
    rows += [(121, 9000.0, 9000.0, 20.0, 20.0, 4.0, 8, 0.0, 1), (122, None, 60.0, 20.0, 20.0, 4.0, 8, 0.0, 1), (123, 100.0, 80.0, 60.0, 60.0, 4.0, 8, 0.0, 1)]
    kind = "seq long, x double, z double, scale_x double, scale_z double, value double, brush int, rotation double, tool int"
    calls, cut = [], FI.cut
    monkeypatch.setattr(FI, "cut", lambda df: calls.append(1) or cut(df))
    fit = lambda **how: {r.seq: (r.target, r.value) for r in FI.fitted_in_order(spark.createDataFrame(rows, kind), raster, grid, A.brush_profiles(spark), **how).collect()}
    got = fit()
    assert len(calls) < 10 and set(got) == {r[0] for r in rows}
    cells = [(r.row, r.col, r.h) for r in raster.collect()]
    weight, done = {8: lambda r: 1 - r, 9: lambda r: min(1.0, (1 - r) / 0.75), 54: lambda r: min(1.0, (1 - r) / 0.9)}, []
    for seq, x, z, scale, _, old, brush, _, tool in rows:
        near = [] if x is None else [h for r, c, h in cells if np.hypot((c + 0.5) * 10 - x, (r + 0.5) * 10 - z) <= scale]
        value, cur = old, 0.0
        if len(near) >= 3:
            for px, pz, reach, v, kernel, raises in done:
                if (r := np.hypot(x - px, z - pz) / reach) <= 1:
                    at = r * 255
                    i = min(254, int(at))
                    w = kernel(i / 255) + (kernel((i + 1) / 255) - kernel(i / 255)) * (at - i)
                    cur = cur + v * w if raises else cur + (v - cur) * w
            value = np.mean(near) - cur if tool else np.mean(near)
        assert got[seq][1] == pytest.approx(value, abs=1e-7)
        if x is not None:
            done.append((x, z, scale, value, weight[brush], tool))
    assert got[121] == got[122] == (None, 4.0)
    calls.clear()
    assert fit(links=800) == got and len(calls) > 10


def test_what_lies_over_a_stamp_without_a_value_has_none(spark):
    grid = Grid(rows=5, cols=5, max_x=50.0, max_z=50.0)
    kind = "seq long, x double, z double, scale_x double, scale_z double, value double, brush int, rotation double, tool int"
    before = spark.createDataFrame([(-2, 25.0, 25.0, 20.0, 20.0, None, 8, 0.0, 1), (-1, 5.0, 5.0, 9.0, 9.0, 3.0, 8, 0.0, 1)], kind)
    stamps = spark.createDataFrame([(1, 25.0, 25.0, 20.0, 20.0, 1.0, 8, 0.0, 1), (2, 5.0, 5.0, 9.0, 9.0, 1.0, 8, 0.0, 1), (3, 25.0, 25.0, 20.0, 20.0, 1.0, 72, 0.0, 0), (4, 25.0, 25.0, 20.0, 20.0, 1.0, 8, 0.0, 1)], kind)
    raster = grid.cells(spark).withColumn("h", F.lit(7.0))
    got = {r.seq: r.value for r in FI.fitted_in_order(stamps, raster, grid, A.brush_profiles(spark), before, least=1).collect()}
    assert got == {1: None, 2: 4.0, 3: 7.0, 4: 0.0}
