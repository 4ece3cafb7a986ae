"""Course files: gzip of UTF-16 JSON whose named values are base64 of gzip of UTF-16 JSON; and layer files."""

from __future__ import annotations

import base64
import gzip
import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def unpacked(raw: bytes) -> tuple[dict[str, Any], dict[str, Any]]:
    """(outer document without the packed values, the packed documents by name)."""
    outer = json.loads(_text(gzip.decompress(raw)))
    inner = {k: json.loads(_text(gzip.decompress(base64.b64decode(v)))) for k, v in outer.get("binaryData", {}).items()}
    return {k: v for k, v in outer.items() if k != "binaryData"}, inner


def packed(outer: dict[str, Any], inner: dict[str, Any]) -> bytes:
    """The inverse; inner documents have a byte order mark, the outer has none, and times are left out so that equal contents give equal bytes."""
    data = {k: base64.b64encode(gzip.compress(b"\xff\xfe" + json.dumps(v, separators=(",", ":")).encode("utf-16-le"), mtime=0)).decode() for k, v in sorted(inner.items())}
    return gzip.compress(json.dumps({**outer, "binaryData": data}, separators=(",", ":")).encode("utf-16-le"), mtime=0)


def _text(raw: bytes) -> str:
    return raw.decode("utf-16-le").removeprefix("﻿")


def nodes(document: dict[str, Any]) -> dict[str, Any]:
    """The non-empty lists and objects of a document, which are files of their own when it is taken apart."""
    return {k: v for k, v in document.items() if isinstance(v, (list, dict)) and v}


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, json): the packed documents of each container."""

    def run(frames):
        import pandas as pd

        for f in frames:
            rows = [(p, name, json.dumps(doc)) for p, raw in zip(f["path"], f["content"]) for name, doc in unpacked(bytes(raw))[1].items()]
            yield pd.DataFrame(rows, columns=["path", "name", "json"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, name string, json string")


LAYER = "step string, parameters map<string,string>, timestamp string, stamps array<struct<x:double,z:double,scale_x:double,scale_z:double,radius:double,value:double,brush:int,rotation:double,tool:int>>"


def read_layers(spark: SparkSession, folder: str) -> DataFrame:
    """(layer, idx, seq, stamp columns) of files stamps_N.json, older ones with one radius included, up to the first missing N."""
    from ..operators.stamps import migrated
    from ..streaming.layers import without_gap

    raw = spark.read.schema(LAYER).option("multiLine", True).json(f"{folder}/stamps_*.json").withColumn("layer", F.regexp_extract(F.input_file_name(), r"stamps_(\d+)\.json$", 1).cast("int"))
    rows = raw.select("layer", F.posexplode("stamps").alias("idx", "s")).select("layer", "idx", "s.*")
    return migrated(without_gap(rows)).withColumn("seq", F.col("layer").cast("long") * 2**32 + F.col("idx"))


def write_layer(folder: str, layer: int, step: str, parameters: dict[str, Any], timestamp: str, stamps: list[dict[str, Any]]) -> str:
    """One layer file; a layer that exists is never written over."""
    path = f"{folder}/stamps_{layer}.json"
    with open(path, "x", encoding="utf-8") as f:
        json.dump({"step": step, "parameters": {k: str(v) for k, v in parameters.items()}, "timestamp": timestamp, "stamps": stamps}, f)
    return path
