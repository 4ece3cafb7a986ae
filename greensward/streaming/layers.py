"""Numbered layers as an append-only log, as a table or as a stream of files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def without_gap(log: DataFrame) -> DataFrame:
    """Rows of layers 1, 2, ... up to the first number that is missing. Only distinct numbers are ordered, which are few."""
    numbers = log.select("layer").distinct().withColumn("k", F.row_number().over(W.orderBy("layer")))
    return log.join(F.broadcast(numbers.where("layer = k").select("layer")), "layer", "left_semi")


def latest(log: DataFrame) -> DataFrame:
    """The last row of the highest layer."""
    return log.agg(F.max_by(F.struct(*log.columns), F.struct("layer", "idx")).alias("r")).where("r IS NOT NULL").select("r.*")


def follow(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch of newly appended layers to sink once; stops when all that is there is done."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merged_state(state: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b): the map h -> a h + b so far, followed by that of a newer block of layers."""
    s, n = state.select(*keys, F.col("a").alias("sa"), F.col("b").alias("sb")), blocks.select(*keys, F.col("a").alias("na"), F.col("b").alias("nb"))
    a, b = F.coalesce("na", F.lit(1.0)), F.coalesce("nb", F.lit(0.0))
    return s.join(n, keys, "full").select(*keys, (F.coalesce("sa", F.lit(1.0)) * a).alias("a"), (F.coalesce("sb", F.lit(0.0)) * a + b).alias("b"))
