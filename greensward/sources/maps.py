"""Map extracts in OSM XML and features in GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TAGS = "array<struct<_k:string,_v:string>>"


def _tags(df: DataFrame) -> DataFrame:
    pairs = F.transform(F.coalesce("tag", F.array().cast(TAGS)), lambda t: F.struct(t["_k"], t["_v"]))
    return df.withColumn("tags", F.map_from_entries(pairs)).drop("tag")


def osm_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(node, lat, lon, tags)."""
    raw = spark.read.format("xml").option("rowTag", "node").schema(f"_id long, _lat double, _lon double, tag {TAGS}").load(path)
    return _tags(raw).select(F.col("_id").alias("node"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), "tags")


def osm_ways(spark: SparkSession, path: str) -> DataFrame:
    """(osm_id, node_ids, tags)."""
    raw = spark.read.format("xml").option("rowTag", "way").schema(f"_id long, nd array<struct<_ref:long>>, tag {TAGS}").load(path)
    return _tags(raw).select(F.col("_id").alias("osm_id"), F.col("nd._ref").alias("node_ids"), "tags")


FEATURES = "features array<struct<type:string,properties:struct<osm_id:long,kind:string,mask:boolean,tags:map<string,string>>,geometry:struct<type:string,coordinates:string>>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(osm_id, kind, tags, mask, geom_type, pts) of polygons (outer ring, open) and lines; a missing mask is false."""
    rows = spark.read.schema(FEATURES).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = rows.select("f.properties.*", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("c"))
    ring = F.get(F.from_json("c", "array<array<array<double>>>"), F.lit(0))
    pairs = F.when(F.col("geom_type") == "Polygon", F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(F.from_json("c", "array<array<double>>"))
    pts = F.transform(pairs, lambda p: F.struct(p[0].alias("x"), p[1].alias("z")))
    return at.select("osm_id", "kind", "tags", F.coalesce("mask", F.lit(False)).alias("mask"), "geom_type", pts.alias("pts"))


def features_json(features: DataFrame) -> DataFrame:
    """One row, json: the features as a FeatureCollection, ordered by osm_id. For exports of one map, which fit a row."""
    pair = lambda p: F.array(p["x"], p["z"])
    line = F.transform("pts", pair)
    ring = F.array(F.concat(line, F.array(pair(F.get(F.col("pts"), F.lit(0))))))
    coordinates = F.when(F.col("geom_type") == "Polygon", F.to_json(ring)).otherwise(F.to_json(line))
    props = F.to_json(F.struct("osm_id", "kind", "mask", "tags"))
    text = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":{"type":"'), F.col("geom_type"), F.lit('","coordinates":'), coordinates, F.lit("}}"))
    each = features.select("osm_id", text.alias("t")).agg(F.transform(F.array_sort(F.collect_list(F.struct("osm_id", "t"))), lambda s: s["t"]).alias("all"))
    return each.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join("all", ","), F.lit("]}")).alias("json"))
