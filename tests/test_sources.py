import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from greensward.operators import features as FE
from greensward.operators.grid import merged_extent
from greensward.sources import container, las, maps


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(1)
    for i, name in enumerate(("a.las", "b.LAS")):
        x, z, e = rng.random((3, 50)) * 100 + i * 100
        (tmp_path / name).write_bytes(las.encoded(x, z, e, np.full(50, 2 + i)))
    got = las.points(spark, str(tmp_path), origin=(10.0, 0.0))
    assert got.count() == 100 and got.where("classification = 3").count() == 50
    extent = merged_extent(las.manifest(spark, str(tmp_path)).withColumn("crs", F.lit("x"))).first()
    assert extent.point_count == 100 and extent.max_x == pytest.approx(got.agg(F.max("x")).first()[0] + 10, abs=0.01)
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        las.files(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        las.header(b"\0" * 400)


def test_osm_extract(spark, tmp_path):
    path = tmp_path / "m.xml"
    path.write_text(
        '<osm><node id="1" lat="48.0" lon="11.0"/><node id="2" lat="48.001" lon="11.0"><tag k="natural" v="tree"/></node>'
        '<way id="7"><nd ref="1"/><nd ref="2"/><tag k="golf" v="hole"/></way><way id="8"><nd ref="1"/><nd ref="99"/></way></osm>'
    )
    x, z = FE.transverse_mercator(F.col("lat"), F.col("lon"), 11.0)
    nodes = maps.osm_nodes(spark, str(path)).select("node", x.alias("x"), z.alias("z"), "tags")
    ways = maps.osm_ways(spark, str(path))
    assert nodes.where("tags['natural'] = 'tree'").count() == 1
    made = FE.assembled(ways, nodes).join(FE.classified(ways), "osm_id").collect()
    assert [(r.osm_id, r.kind, len(r.pts)) for r in made] == [(7, "hole", 2)]
    assert made[0].pts[1].z - made[0].pts[0].z == pytest.approx(111.2, abs=0.2)


def test_features_round_trip(spark, tmp_path):
    rows = [(1, "green", {"golf": "green"}, False, "Polygon", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]), (2, "path", {}, True, "LineString", [(0.0, 0.0), (5.0, 5.0)])]
    df = spark.createDataFrame(rows, "osm_id long, kind string, tags map<string,string>, mask boolean, geom_type string, pts array<struct<x:double,z:double>>")
    (tmp_path / "f.json").write_text(maps.features_json(df).first().json)
    got = maps.read_features(spark, str(tmp_path / "f.json")).orderBy("osm_id").collect()
    assert [(r.osm_id, r.kind, r.tags, r.mask, r.geom_type, [tuple(p) for p in r.pts]) for r in got] == rows
    assert json.loads(maps.features_json(df.limit(0)).first().json)["features"] == []


def test_container_round_trip(spark, tmp_path):
    outer, inner = {"name": "x", "version": 3}, {"CourseDescription": {"height": [1, 2], "none": [], "é": "ü"}, "Thumbnail": {"a": 1}}
    raw = container.packed(outer, inner)
    assert container.unpacked(raw) == (outer, inner) and container.packed(*container.unpacked(raw)) == raw
    assert container.nodes(inner["CourseDescription"]) == {"height": [1, 2]}
    (tmp_path / "a.course").write_bytes(raw)
    got = {r.name: json.loads(r.json) for r in container.read_containers(spark, str(tmp_path / "a.course")).collect()}
    assert got == inner


def test_layer_files(spark, tmp_path):
    stamp = {"x": 1.0, "z": 2.0, "scale_x": 3.0, "scale_z": 4.0, "value": 5.0, "brush": 8}
    old = {"x": 1.0, "z": 2.0, "radius": 9.0, "value": 5.0, "brush": 8}
    for n, s in ((1, [old]), (2, [stamp, stamp]), (4, [stamp])):
        container.write_layer(str(tmp_path), n, "hex", {"pitch": 50}, "2024-01-01T00:00:00", s)
    got = container.read_layers(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.layer, r.idx, r.scale_x) for r in got] == [(1, 0, 9.0), (2, 0, 3.0), (2, 1, 3.0)]
    with pytest.raises(FileExistsError):
        container.write_layer(str(tmp_path), 1, "x", {}, "", [])
