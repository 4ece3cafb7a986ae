"""Files of a project: round trips, defaults, merges."""

import json

import pytest
from pyspark.sql import functions as F

from greensward.operators import stamps as ST
from greensward.operators.grid import Grid
from greensward.sources import project as P


def test_points_rasters_and_masks_come_back(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    points = spark.createDataFrame([(1.5, 2.5, 300.25, 2), (3.0, 4.0, 301.0, 5)], "x double, z double, elevation double, classification int")
    P.save_points(points, at("points"), crs="EPSG:26910", origin_x=500.0)
    back, meta = P.load_points(spark, at("points"))
    assert sorted(back.collect()) == sorted(points.collect()) and meta == P.POINT_DEFAULTS | {"crs": "EPSG:26910", "origin_x": 500.0}
    spark.createDataFrame([("x",)], "crs string").write.mode("overwrite").parquet(at("points") + "/meta")  # an older cache
    assert P.load_points(spark, at("points"))[1] == P.POINT_DEFAULTS | {"crs": "x"}

    raster = spark.createDataFrame([(0, 0, 1.1), (0, 1, None), (1, 1, 2.5)], "row int, col int, h double")
    P.save_raster(raster, Grid(rows=2, cols=2, max_x=20.0, max_z=20.0), at("raster"))
    cells, grid = P.load_raster(spark, at("raster"))
    assert {(r.row, r.col): r.h for r in cells.collect()} == {(0, 0): pytest.approx(1.1, abs=1e-6), (0, 1): None, (1, 1): 2.5} and (grid.rows, grid.max_x) == (2, 20.0)

    P.save_mask(None, spark, at("mask"))
    assert P.load_mask(spark, at("mask")).count() == 0
    P.save_mask(spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)])], "poly long, ring array<struct<x:double,z:double>>"), spark, at("mask"))
    assert P.load_mask(spark, at("mask")).first().ring[1].x == 1.0

    trees = spark.createDataFrame([(1.0, 2.0, {"a": "b"}), (3.0, 4.0, {})], "x double, z double, tags map<string,string>")
    P.save_objects(trees, at("trees"))
    assert sorted((r.x, r.z, r.tags) for r in P.load_objects(spark, at("trees")).collect()) == [(1.0, 2.0, {"a": "b"}), (3.0, 4.0, {})]


def test_documents_keep_what_is_not_given(spark, tmp_path):
    path = str(tmp_path / "layers.json")
    P.merge_document(path, other=[1], water=["old"])
    stamps = spark.createDataFrame([(2, 1100.0, 900.0, 30.0, 30.0, 5.0, 8, 0.0, 0), (1, 1000.0, 1000.0, 20.0, 20.0, 4.0, 73, 0.0, 1)], "seq long, x double, z double, scale_x double, scale_z double, value double, brush int, rotation double, tool int")
    P.write_user_layers(path, ST.exported(stamps))
    got = json.load(open(path))
    assert got["other"] == [1] and got["water"] == ["old"] and [e["type"] for e in got["terrainHeight"]] == [73, 8] and got["terrainHeight"][1]["position"]["x"] == 100.0
    assert P.merge_document(path, water=None) == got
    array = str(tmp_path / "holes.json")
    assert P.write_array(array, stamps.select("seq", F.struct("x", "z").alias("p")), "seq", "p") == 2
    assert json.load(open(array)) == [{"x": 1000.0, "z": 1000.0}, {"x": 1100.0, "z": 900.0}]


def test_catalog_and_themes(spark, tmp_path):
    path = tmp_path / "catalog.json"
    path.write_text(json.dumps({"categories": [{"id": 1, "description": "Trees", "cluster_radius": 4.0, "entries": [{"type": 3, "theme": "alpine", "path": "a/b/Pine", "spacing": 2.0}, {"type": 4, "theme": "all", "path": "Oak"}]}, {"id": 2, "description": "Rocks", "entries": []}]}))
    kinds, entries = P.load_catalog(spark, str(path))
    assert sorted((r.category, r.description, r.cluster_radius) for r in kinds.collect()) == [(1, "Trees", 4.0), (2, "Rocks", None)]
    assert sorted((r.type, r.label, r.spacing) for r in entries.collect()) == [(3, "Pine", 2.0), (4, "Oak", None)]
    themes = {1: "Alpine", 2: "Desert"}
    assert [P.resolve_theme(v, themes) for v in ("2", "aLPINE", 7, None)] == [2, 1, 7, None]
    with pytest.raises(ValueError, match="no theme"):
        P.resolve_theme("moon", themes)
