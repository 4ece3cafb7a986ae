"""A project's files: cached points, rasters and masks as Parquet, object lists, documents that are merged or replaced, the asset catalog."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grid import Grid

#: What older caches of points don't hold yet, and what they mean by that.
POINT_DEFAULTS = {"crs": "", "origin_x": 0.0, "origin_y": 0.0, "horizontal_unit_factor": 1.0, "vertical_unit_factor": 1.0, "vertical_unit_source": "assumed"}


def save_points(points: DataFrame, path: str, **meta: str | float) -> None:
    """points (x, z, elevation, classification) and one row of what is known of their coordinates."""
    points.write.mode("overwrite").parquet(f"{path}/points")
    known = POINT_DEFAULTS | meta
    points.sparkSession.createDataFrame([tuple(known.values())], ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in known.items())).write.mode("overwrite").parquet(f"{path}/meta")


def load_points(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """The points and what is known of them; what an older cache lacks has its default."""
    meta = spark.read.parquet(f"{path}/meta").first()
    return spark.read.parquet(f"{path}/points"), POINT_DEFAULTS | ({k: v for k, v in meta.asDict().items() if v is not None} if meta else {})


def save_raster(raster: DataFrame, grid: Grid, path: str) -> None:
    """(row, col, h) with heights in single precision, and the grid."""
    raster.select("row", "col", F.col("h").cast("float").alias("h")).write.mode("overwrite").parquet(f"{path}/cells")
    at = [(grid.rows, grid.cols, grid.min_x, grid.min_z, grid.max_x, grid.max_z)]
    raster.sparkSession.createDataFrame(at, "rows int, cols int, min_x double, min_z double, max_x double, max_z double").write.mode("overwrite").parquet(f"{path}/grid")


def load_raster(spark: SparkSession, path: str) -> tuple[DataFrame, Grid]:
    cells = spark.read.parquet(f"{path}/cells").withColumn("h", F.col("h").cast("double"))
    return cells, Grid(**spark.read.parquet(f"{path}/grid").first().asDict())


def save_mask(areas: DataFrame | None, spark: SparkSession, path: str) -> None:
    """The mask's areas (poly, ring); none at all for no mask."""
    if areas is None:
        areas = spark.createDataFrame([], "poly long, ring array<struct<x:double,z:double>>")
    areas.select("poly", "ring").write.mode("overwrite").parquet(path)


def load_mask(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_objects(objects: DataFrame, path: str) -> None:
    """(x, z, tags) as lines of JSON."""
    objects.select("x", "z", "tags").write.mode("overwrite").json(path)


def load_objects(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("x double, z double, tags map<string,string>").json(path)


def load_catalog(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Categories (category, description, cluster_radius) and entries (category, type, theme, path, spacing, label) of a JSON catalog
    {"categories": [{"id", "description", "cluster_radius"?, "entries": [{"type", "theme", "path", "spacing"?}]}]}; a label is the path's last part."""
    entry = "struct<type:int,theme:string,path:string,spacing:double>"
    raw = spark.read.option("multiLine", True).schema(f"categories array<struct<id:int,description:string,cluster_radius:double,entries:array<{entry}>>>").json(path)
    kinds = raw.select(F.explode("categories").alias("c"))
    entries = kinds.select(F.col("c.id").alias("category"), F.explode("c.entries").alias("e")).select("category", "e.*")
    return kinds.select(F.col("c.id").alias("category"), "c.description", "c.cluster_radius"), entries.withColumn("label", F.substring_index("path", "/", -1))


def resolve_theme(value: str | int | None, themes: dict[int, str]) -> int | None:
    """A theme by number or, whatever its case, by name; an error for a name that isn't known."""
    if value is None or isinstance(value, int):
        return value
    if value.strip().isdigit():
        return int(value)
    for number, name in themes.items():
        if name.lower() == value.strip().lower():
            return number
    raise ValueError(f"no theme {value!r}")


def read_document(path: str) -> dict:
    """A JSON object; empty where there is no file yet."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def merge_document(path: str, **values: object) -> dict:
    """Replace the given keys of a document and leave all others; a value of None changes nothing."""
    known = read_document(path) | {k: v for k, v in values.items() if v is not None}
    partial = f"{path}.part"
    with open(partial, "w", encoding="utf-8") as f:
        json.dump(known, f, indent=2)
    os.replace(partial, path)
    return known


def nested(rows: DataFrame, order: str, value: str) -> list:
    """The column `value` as JSON values, in the order of `order`: a document's array, which one file holds, so it is read row by row."""
    lines: Iterable = rows.select(order, F.to_json(F.struct(F.col(value).alias("v"))).alias("j")).orderBy(order).toLocalIterator()
    return [json.loads(r.j).get("v") for r in lines]


def write_user_layers(path: str, stamps: DataFrame | None = None, water: DataFrame | None = None) -> dict:
    """Replace the height entries (seq, entry) or the water entries of the user layers; what isn't given stays as it is in the file."""
    given = {"terrainHeight": stamps, "water": water}
    return merge_document(path, **{k: nested(df, "seq", "entry") for k, df in given.items() if df is not None})


def write_array(path: str, rows: DataFrame, order: str, value: str) -> int:
    """Overwrite a document that is one array: splines, holes or placed objects; how many there are."""
    made = nested(rows, order, value)
    partial = f"{path}.part"
    with open(partial, "w", encoding="utf-8") as f:
        json.dump(made, f)
    os.replace(partial, path)
    return len(made)
