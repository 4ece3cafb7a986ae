"""Point clouds in uncompressed LAS files (public format, versions 1.0 to 1.4), as a manifest of headers and as points."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = 375


def header(raw: bytes) -> dict:
    """Fields of the public header block that locate and scale the points."""
    if raw[:4] != b"LASF":
        raise ValueError("no LAS file")
    minor = raw[25]
    offset, _, form, length, count = struct.unpack_from("<IIBHI", raw, 96)
    if form & 0x80 or form & 0x40:
        raise ValueError("compressed points (LAZ) aren't read")
    scale, shift = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    max_x, min_x, max_y, min_y, max_z, min_z = struct.unpack_from("<6d", raw, 179)
    if minor >= 4 and not count:
        (count,) = struct.unpack_from("<Q", raw, 247)
    return {"offset": offset, "form": form, "length": length, "count": count, "scale": scale, "shift": shift, "min_x": min_x, "max_x": max_x, "min_y": min_y, "max_y": max_y, "min_z": min_z, "max_z": max_z}


def decoded(raw: bytes) -> pd.DataFrame:
    """x, z (north), elevation and classification of all points of a file."""
    h = header(raw)
    rows = np.frombuffer(raw, np.uint8, h["count"] * h["length"], h["offset"]).reshape(h["count"], h["length"])
    xyz = rows[:, :12].copy().view("<i4").astype(float) * h["scale"] + h["shift"]
    kind = rows[:, 16] if h["form"] >= 6 else rows[:, 15] & 31
    return pd.DataFrame({"x": xyz[:, 0], "z": xyz[:, 1], "elevation": xyz[:, 2], "classification": kind.astype(np.int32)})


def files(spark: SparkSession, folder: str) -> DataFrame:
    """The tiles of a folder, their names ending in .las in either case; an error if there are none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.[lL][aA][sS]").load(folder)
    if found.select("path").limit(1).count() == 0:
        raise FileNotFoundError(f"no LAS files in {folder}")
    return found


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """(path, min_x, min_y, max_x, max_y, point_count) from the headers."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            heads = [header(bytes(b)) for b in f["head"]]
            yield pd.DataFrame({"path": f["path"], **{c: [h[c] for h in heads] for c in ("min_x", "min_y", "max_x", "max_y")}, "point_count": [h["count"] for h in heads]})

    heads = files(spark, folder).select("path", F.substring("content", 1, HEADER).alias("head"))
    return heads.mapInPandas(run, "path string, min_x double, min_y double, max_x double, max_y double, point_count long")


def points(spark: SparkSession, folder: str, horizontal: float = 1.0, vertical: float = 1.0, origin: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """All points in metres from the origin; a file is a task, so tiles should be of a size that fits one."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for raw in f["content"]:
                yield decoded(bytes(raw))

    from ..operators.grid import to_metres

    raw = files(spark, folder).select("content").mapInPandas(run, "x double, z double, elevation double, classification int")
    return to_metres(raw, horizontal, vertical, origin)


def encoded(x: np.ndarray, z: np.ndarray, elevation: np.ndarray, classification: np.ndarray, scale: float = 0.001) -> bytes:
    """A LAS 1.2 file with points of format 0, for tests and exchange."""
    n = len(x)
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", bytes((1, 2))
    struct.pack_into("<HIIBHI", head, 94, 227, 227, 0, 0, 20, n)
    struct.pack_into("<6d", head, 131, scale, scale, scale, 0, 0, 0)
    if n:
        struct.pack_into("<6d", head, 179, x.max(), x.min(), z.max(), z.min(), elevation.max(), elevation.min())
    rows = np.zeros((n, 20), np.uint8)
    rows[:, :12] = np.rint(np.stack((x, z, elevation), 1) / scale).astype("<i4").view(np.uint8).reshape(n, 12)
    rows[:, 15] = classification
    return bytes(head) + rows.tobytes()
