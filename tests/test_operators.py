"""Hand-computed cases of operators."""

import math

import pytest
from pyspark.sql import functions as F

from greensward.functions import geometry as G
from greensward.operators import features as FE
from greensward.operators import grid as GR
from greensward.operators import objects as OB
from greensward.operators import raster as RA
from greensward.operators import spatial as SP
from greensward.operators import stamps as ST
from greensward.sources import adapters as A

SF = "/root/testdata/sf0.001"
GRID = GR.Grid(rows=2, cols=2, max_x=10.0, max_z=10.0)


def rows(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def test_edges_of_the_grid(spark):
    pts = spark.createDataFrame([(10.0, 10.0, 5.0, 2), (10.01, 1.0, 7.0, 2), (0.0, 0.0, 1.0, 8)], "x double, z double, elevation double, classification int")
    assert rows(GR.ground(pts, GRID), "row", "col", "h") == [(0, 0, 1.0), (1, 1, 5.0)]
    veg = pts.withColumn("classification", F.lit(5))
    assert rows(GR.canopy(veg, GRID), "row", "col", "h") == [(0, 0, 1.0), (0, 1, 7.0), (1, 1, 5.0)]


def test_window_shifts_but_never_shrinks():
    assert GR.select_window((0, 0, 100, 100), 40, (5, 95)) == (0, 60, 40, 100)
    with pytest.raises(ValueError):
        GR.select_window((0, 0, 10, 10), 11)


def test_flat_terrain_is_one_band(spark):
    flat = spark.createDataFrame([(0, 0, 5.0), (0, 1, 5.0), (1, 0, None)], "row int, col int, h double")
    assert rows(GR.with_bands(flat, 2.0), "row", "col", "band") == [(0, 0, 0), (0, 1, 0)]
    assert GR.contour_levels(0, 10, 4) == [4, 8] and GR.contour_levels(0, 3, 4) == []


def test_extent_of_mixed_systems_fails(spark):
    tiles = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0, 5), ("b", 1.0, 0.0, 2.0, 1.0, 6)], "crs string, min_x double, min_y double, max_x double, max_y double, point_count long")
    assert rows(GR.merged_extent(tiles.where("crs = 'a'")), "min_x", "max_x", "point_count") == [(0.0, 1.0, 5)]
    with pytest.raises(Exception, match="different coordinate systems"):
        GR.merged_extent(tiles).collect()


def stamps(spark, *given):
    return spark.createDataFrame([(i, 0, *g) for i, g in enumerate(given)], "seq long, layer int, x double, z double, scale_x double, scale_z double, value double, brush int, rotation double, tool int")


def test_order_of_stamps_matters(spark):
    p = A.brush_profiles(spark)
    at = spark.createDataFrame([(0, 5.0, 5.0)], "k int, x double, z double")
    a, b = (5.0, 5.0, 10.0, 10.0, 3.0, 10, 0.0, 0), (6.0, 5.0, 10.0, 10.0, 9.0, 8, 0.0, 0)
    height = lambda *s: ST.fold(ST.effects(at, stamps(spark, *s), p, ["k"]), ["k"]).first().h
    w = 0.9
    assert height(a) == pytest.approx(3.0)
    assert height(a, b) == pytest.approx(3.0 + (9.0 - 3.0) * w, abs=1e-6)
    assert height(b, a) == pytest.approx(3.0)
    raised = (5.0, 5.0, 10.0, 10.0, 2.0, 10, 0.0, 1)
    assert height(a, raised) == pytest.approx(5.0) and height(raised, a) == pytest.approx(3.0)


def test_edge_of_a_stamp_and_rotated_square(spark):
    p = A.brush_profiles(spark)
    at = spark.createDataFrame([(0, 15.0, 5.0), (1, 15.1, 5.0), (2, 5.0, 8.0)], "k int, x double, z double")
    assert rows(ST.effects(at, stamps(spark, (5.0, 5.0, 10.0, 10.0, 1.0, 8, 0.0, 0)), p, ["k"]).where("k < 2"), "k", "w") == [(0, 0.0)]
    square = lambda rotation: [r[0] for r in rows(ST.effects(at, stamps(spark, (5.0, 5.0, 2.0, 10.0, 1.0, 72, rotation, 0)), p, ["k"]), "k")]
    assert square(0.0) == [2] and square(90.0) == [0]


def test_blocks_compose_to_the_fold(spark):
    hits = spark.createDataFrame([(0, i, i % 3 == 2, float(i), 0.1 + 0.2 * (i % 4)) for i in range(20)], "k int, seq long, r boolean, value double, w double").withColumn("tool", F.col("r").cast("int"))
    assert ST.compose_blocks(ST.affine_blocks(hits, ["k"], 7), ["k"]).first().h == pytest.approx(ST.fold(hits, ["k"]).first().h)


def test_hex_lattice_counts(spark):
    assert ST.hex_lattice(spark, GR.Grid()).count() == 516
    assert ST.hex_lattice(spark, GR.Grid()).where("x < 0 OR x > 2000").count() == 24


def test_shift_fails_over_the_span(spark):
    s = stamps(spark, (5.0, 5.0, 10.0, 10.0, 400.0, 10, 0.0, 0))
    wide = spark.createDataFrame([(0, 0, 0.0), (0, 1, 300.0)], "row int, col int, h double")
    with pytest.raises(Exception, match="275"):
        ST.shifted_to_zero(wide, s).collect()


def test_old_entries_get_scales(spark):
    old = spark.createDataFrame([(1.0, 2.0, 7.0)], "x double, z double, radius double")
    assert rows(ST.migrated(old), "scale_x", "scale_z", "rotation", "tool") == [(7.0, 7.0, 0.0, 0)]


def test_unknown_golf_value_stops_the_search(spark):
    tags = [{"golf": "x", "building": "yes"}, {"building": "yes"}, {"highway": "path", "foot": "no"}, {"highway": "trunk"}, {"golf": "hole"}, {}]
    got = FE.classified(spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "osm_id long, tags map<string,string>"))
    assert rows(got, "osm_id", "kind") == [(0, None), (1, "building"), (2, None), (3, None), (4, "hole"), (5, None)]


def test_clipping_and_area(spark):
    p = spark.createDataFrame([(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]), (2, [(9.0, 9.0), (9.5, 9.0), (9.5, 9.5)])], "poly long, ring array<struct<x:double,z:double>>")
    c = FE.clipped_rings(p, (1.0, 1.0, 9.0, 3.0)).withColumn("area", SP.ring_area(F.col("ring")))
    assert rows(c, "poly", "area") == [(1, 6.0)]


def test_projections(spark):
    one = spark.range(1).select(F.lit(48.137).alias("lat"), F.lit(11.575).alias("lon"))
    e, n = one.select(*FE.transverse_mercator(F.col("lat"), F.col("lon"), 9.0)).first()
    assert (e, n) == pytest.approx((691565.6, 5334764.2), abs=60)
    e0, n0 = one.select(*FE.transverse_mercator(F.lit(0.0), F.lit(9.0), 9.0)).first()
    assert (e0, n0) == pytest.approx((500000.0, 0.0), abs=1e-6)
    e1, n1 = one.select(*FE.lambert_conformal(F.lit(46.5), F.lit(3.0), 44.0, 49.0, 46.5, 3.0, 700000.0, 6600000.0)).first()
    assert (e1, n1) == pytest.approx((700000.0, 6600000.0), abs=1e-6)


def test_points_near_each_other_are_merged(spark):
    line = [(0.0, 0.0), (0.1, 0.0), (5.0, 0.0), (5.0, 5.0), (0.2, 0.1)]
    df = spark.createDataFrame([(line,)], "p array<struct<x:double,z:double>>")
    assert [tuple(p) for p in df.select(G.without_near_points(F.col("p"), F.lit(True))).first()[0]] == [(0.0, 0.0), (5.0, 0.0), (5.0, 5.0)]
    same = spark.createDataFrame([([(0.0, 0.0), (0.1, 0.0)],)], "p array<struct<x:double,z:double>>")
    assert len(same.select(G.without_near_points(F.col("p"), F.lit(False))).first()[0]) == 2


def test_circle_of_four_waypoints_is_round(spark):
    pts, handle = G.circle_ring(0.0, 0.0, 10.0)
    w = spark.createDataFrame([(pts,)], "p array<struct<x:double,z:double>>").select(G.waypoints(F.col("p"), F.lit(handle), G.is_clockwise(F.col("p")), F.lit(False), None)).first()[0]
    a, b = w[0], w[1]
    mid = [0.125 * a.waypoint[i] + 0.375 * a.pointTwo[i] + 0.375 * b.pointOne[i] + 0.125 * b.waypoint[i] for i in (0, 1)]
    assert math.hypot(*mid) == pytest.approx(10.0, abs=0.01)


def test_tiers_and_counts(spark):
    assert G.tier_radii(10, 8, 0.9) == [10, 9, 8] and G.tier_radii(5, 5, 0.5) == [5]
    assert spark.range(1).select(G.cluster_count(F.lit(1.0), F.lit(10.0))).first()[0] == 1


def test_numbers_of_holes(spark):
    pts = [(0.0, 0.0), (10.0, 0.0)]
    h = spark.createDataFrame([(1, 5, 4, pts), (2, 0, 3, pts), (3, 5, 5, pts), (4, None, 3, pts), (5, 0, 3, pts), (6, 1, 3, pts[:1])], "seq long, ref int, par int, pts array<struct<x:double,z:double>>")
    assert rows(OB.ordered_holes(h), "hole", "seq") == [(-1, 4), (2, 2), (4, 5), (5, 3)]


def test_relocated_trees_leave_the_path(spark):
    seg = spark.createDataFrame([(1, 0.0, 0.0, 100.0, 0.0)], "path long, x1 double, z1 double, x2 double, z2 double")
    trees = spark.createDataFrame([(1, 50.0, 1.0), (2, 50.0, -1.0), (3, 50.0, 9.0)], "tree long, x double, z double")
    got = rows(OB.relocated(trees, seg, rounds=2), "tree", "x", "z", "moved")
    assert [(t, m) for t, _, _, m in got] == [(1, 1), (2, 1), (3, 0)]
    assert got[0][2] == pytest.approx(2.9) and got[1][2] == pytest.approx(-2.9)


def test_layers_stop_at_a_gap(spark):
    from greensward.streaming.layers import latest, without_gap

    log = spark.createDataFrame([(1, 1), (2, 2), (4, 3)], "layer int, idx long")
    assert rows(without_gap(log), "layer") == [(1,), (2,)]
    assert rows(latest(log), "layer", "idx") == [(4, 3)]


def test_layers_as_a_stream(spark, tmp_path):
    from greensward.streaming.layers import follow, merged_state

    src = str(tmp_path / "src")
    seen = []
    for k in (1, 2):
        spark.createDataFrame([(0, 0.5, float(k))], "cell int, a double, b double").write.mode("append").parquet(src)
        stream = spark.readStream.schema("cell int, a double, b double").parquet(src)
        follow(stream, lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.b for r in seen) == [1.0, 2.0]
    state = spark.createDataFrame([(0, 0.5, 1.0), (1, 1.0, 0.0)], "cell int, a double, b double")
    newer = spark.createDataFrame([(0, 0.5, 2.0)], "cell int, a double, b double")
    assert rows(merged_state(state, newer, ["cell"]), "cell", "a", "b") == [(0, 0.25, 2.5), (1, 1.0, 0.0)]


def test_stamps_of_large_bands_take_the_nearest_value(spark):
    grid = GR.Grid(rows=160, cols=160, max_x=1600.0, max_z=1600.0)
    at = grid.cells(spark).where("(row + col) % 2 = 0 OR row < 5 OR col < 5").select("row", "col", F.lit(0).alias("band"), (F.col("row") * 1000.0 + F.col("col")).alias("h"))
    got = RA.contour_stamps(at, grid, candidates=20).collect()
    gaps = [r for r in got if (int(r.z / 10) + int(r.x / 10)) % 2 and min(r.z, r.x) > 60]
    assert gaps and all(abs(r.value // 1000 - int(r.z / 10)) + abs(r.value % 1000 - int(r.x / 10)) == 1 for r in gaps)
