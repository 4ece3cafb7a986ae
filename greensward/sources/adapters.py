"""Terrain inputs derived from the relational test tables: points, stamps, ways, polygons, trees, holes, layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(x, z, elevation, classification) in a square of 2000 m."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("CAST((l_orderkey * 7919 + l_linenumber * 104729) % 200000 AS double) / 100.0").alias("x"),
        F.expr("CAST((l_partkey * 6271 + l_suppkey * 3571 + l_linenumber * 1009) % 200000 AS double) / 100.0").alias("z"),
        F.expr("200.0D + l_quantity * 2 + l_extendedprice / 1000.0D").alias("elevation"),
        F.expr("CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 5 ELSE 1 END").alias("classification"),
    )


def stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, layer, x, z, scale_x, scale_z, value, brush, rotation, tool); seq is the order of application."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        k.alias("seq"),
        (k % 4).cast("int").alias("layer"),
        ((k * 7919 % 200000) / 100.0).alias("x"),
        ((k * 6271 % 200000) / 100.0).alias("z"),
        (20.0 + 10.0 * (k % 8)).alias("scale_x"),
        (20.0 + 10.0 * (k * 3 % 8)).alias("scale_z"),
        (F.when(k % 3 == 2, F.col("c_acctbal") / 5000.0).otherwise(F.col("c_acctbal") / 97.0)).alias("value"),
        F.expr("CASE c_custkey % 6 WHEN 0 THEN 8 WHEN 1 THEN 9 WHEN 2 THEN 10 WHEN 3 THEN 54 WHEN 4 THEN 72 ELSE 73 END").alias("brush"),
        (15.0 * (k % 5)).alias("rotation"),
        F.expr("CAST(c_custkey % 3 = 2 AS int)").alias("tool"),
    )


#: Brush, shape, share of the radius at full weight. Analytic profiles of our own.
BRUSHES = ((8, "circle", 0.0), (9, "circle", 0.25), (10, "circle", 0.5), (15, "square", 0.8), (54, "circle", 0.1), (72, "square", 0.9), (73, "circle", 0.4), (74, "square", 0.9))


def brush_profiles(spark: SparkSession) -> DataFrame:
    """(brush, shape, w): 256 weights from the centre to the edge."""
    rows = spark.createDataFrame(list(BRUSHES), "brush int, shape string, plateau double")
    return rows.select("brush", "shape", F.expr("transform(sequence(0, 255), i -> least(1.0D, (1 - i / 255.0D) / (1 - plateau)))").alias("w"))


def brush_images(spark: SparkSession) -> DataFrame:
    """(brush, side, pixels, offset_x, offset_z): round images of 16 x 16 pixels with the profiles' plateaus; one is off the middle."""
    rows = spark.createDataFrame(list(BRUSHES), "brush int, shape string, plateau double")
    level = "floor(255 * greatest(0.0D, least(1.0D, (1 - sqrt((i div 16 - 7.5D) * (i div 16 - 7.5D) + (i % 16 - 7.5D) * (i % 16 - 7.5D)) / 8) / (1 - plateau))))"
    off = lambda share: F.when(F.col("brush") == 54, share).otherwise(0.0)
    return rows.select("brush", F.lit(16).alias("side"), F.expr(f"transform(sequence(0, 255), i -> CAST({level} AS double))").alias("pixels"), off(0.0625).alias("offset_x"), off(-0.03125).alias("offset_z"))


def way_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(osm_id, tags): a map of tags that reaches every branch of the way classifier."""
    golf = ["green", "tee", "bunker", "fairway", "driving_range", "rough", "water_hazard", "lateral_water_hazard", "cartpath", "path", "clubhouse", "hole", "pin"]
    highway = ["service", "residential", "footway", "cycleway", "path", "proposed", "tertiary", "track", "steps"]
    natural = ["wood", "water", "fell", "sand", "heath"]
    k = F.col("p_partkey")

    def pick(values: list[str], by: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (by % len(values) + 1).cast("int"))

    def only(name: str, when: Column, value: Column) -> Column:
        return F.when(when, F.create_map(F.lit(name), value)).otherwise(F.create_map().cast("map<string,string>"))

    kind = k % 16
    tags = F.map_concat(
        only("golf", kind.isin(0, 1, 2, 3), pick(golf, F.expr("p_partkey div 16"))),
        only("highway", kind.isin(4, 5), pick(highway, F.expr("p_partkey div 16"))),
        only("natural", kind == 6, pick(natural, F.expr("p_partkey div 16"))),
        only("waterway", kind == 7, F.lit("stream")),
        only("building", kind == 8, F.lit("yes")),
        only("landuse", kind == 9, F.when(k % 32 < 16, "flowerbed").otherwise("grass")),
        only("amenity", kind == 10, F.lit("parking")),
        only("leisure", kind == 11, F.lit("golf_course")),
        only("pga_scatter", kind == 12, F.lit("1")),
        only("area:highway", kind == 13, F.lit("footway")),
        only("area", F.col("p_size") % 2 == 0, F.lit("yes")),
        only("service", F.col("p_size") % 3 == 0, F.lit("driveway")),
        only("golf_cart", F.col("p_size") % 5 == 0, F.lit("yes")),
        only("foot", F.col("p_size") % 7 == 0, F.lit("no")),
    )
    return table(spark, sf_dir, "part").select(k.alias("osm_id"), tags.alias("tags"))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(poly, kind, ring): diamonds about suppliers, off the grid; ring is open, in order."""
    k = F.col("s_suppkey")
    x, z, r = (k * 7919 % 190000) / 100.0 + 50.0137, (k * 6271 % 190000) / 100.0 + 50.0291, 15.0 + (k % 9) * 7.0

    def corner(dx: Column, dz: Column) -> Column:
        return F.struct((x + dx).alias("x"), (z + dz).alias("z"))

    zero = F.lit(0.0)
    kind = F.expr("CASE s_suppkey % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'wood' WHEN 2 THEN 'bunker' ELSE 'building' END")
    return table(spark, sf_dir, "supplier").select(k.alias("poly"), kind.alias("kind"), F.array(corner(r, zero), corner(zero, r), corner(-r, zero), corner(zero, -r)).alias("ring"))


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree, x, z, tags): some heights are missing, some can't be parsed."""
    k = F.col("c_custkey")
    height = F.when(k % 11 == 0, "tall").otherwise((F.round((F.abs(F.col("c_acctbal")) / 400.0 + 2) * 100) / 100).cast("string"))
    tags = F.when(k % 7 == 0, F.create_map().cast("map<string,string>")).when(
        k % 5 == 0, F.create_map(F.lit("pga_tree_height"), height, F.lit("pga_tree_type"), F.lit("conifer"))
    ).otherwise(F.create_map(F.lit("pga_tree_height"), height, F.lit("pga_tree_radius"), F.lit("3.5")))
    return table(spark, sf_dir, "customer").select(k.alias("tree"), ((k * 104729 % 200000) / 100.0).alias("x"), ((k * 3571 % 200000) / 100.0).alias("z"), tags.alias("tags"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, i, x, z): polylines of four vertices about suppliers."""
    k = F.col("s_suppkey")
    rows = table(spark, sf_dir, "supplier").select(k.alias("path"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    p, i = F.col("path"), F.col("i")
    return rows.select("path", "i", (((p * 3571 % 180000) / 100.0) + i * 31.7 + (p % 3) * i * 2.5).alias("x"), (((p * 7919 % 180000) / 100.0) + (i * i) * 11.3).alias("z"))


def holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, ref, par, pts): ref null or 0 at times; 1 to 5 points."""
    k = F.col("o_orderkey")
    pts = F.transform(F.sequence(F.lit(0).cast("long"), k % 5), lambda i: F.struct((k % 1000 + i * 10.0).alias("x"), (k % 777 + i * i * 3.0).alias("z")))
    ref = F.when(k % 13 == 0, None).otherwise((k % 20).cast("int"))
    return table(spark, sf_dir, "orders").select(k.alias("seq"), ref.alias("ref"), F.expr("try_cast(substring(o_orderpriority, 1, 1) AS int)").alias("par"), pts.alias("pts"))


def layer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(layer, idx, step, value): an append-only log; one layer number is left out."""
    e = table(spark, sf_dir, "events")
    layer = F.expr("CAST(event_id % 12 AS int) + CASE WHEN event_id % 12 >= 9 THEN 2 ELSE 1 END")
    return e.select(layer.alias("layer"), F.col("event_id").alias("idx"), F.col("event_type").alias("step"), F.col("value"))
