"""Tables written to the shared folder, where plans are cut, and the components of a graph, which need that."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where it is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, computed once: plans stay short, and a lost executor costs nothing."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(node, least) for each node of undirected edges (a, b): the smallest node that can be reached.

    In a round each node takes the smallest label beside it, hands it on to the node its own label names, and follows its label one step, so
    that long chains take few rounds. Only minima per node are shuffled."""
    both = cut(edges.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*").distinct())
    if both.isEmpty():
        return both.select(F.col("a").alias("node"), F.col("b").alias("least"))
    label = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("least")))
    while True:
        beside = both.join(label.select(F.col("node").alias("b"), "least"), "b").groupBy(F.col("a").alias("node")).agg(F.min("least").alias("seen"))
        here = label.join(beside, "node").select("node", "least", F.least("least", "seen").alias("to"))
        handed = here.select("node", "to").unionByName(here.select(F.col("least").alias("node"), "to")).groupBy("node").agg(F.min("to").alias("least"))
        up = handed.select(F.col("node").alias("least"), F.col("least").alias("up"))
        after = cut(handed.join(up, "least", "left").select("node", F.least("least", F.coalesce("up", "least")).alias("least")))
        if after.join(label.withColumnRenamed("least", "before"), "node").where("least <> before").isEmpty():
            return after
        label = after


def running_sum(rows: DataFrame, name: str, value: Column, *order: Column) -> DataFrame:
    """rows with name: the sum of whole numbers (value) up to and with each row in this order. Rows are dealt by range and summed within, and only the
    sums of ranges, a row per task, are summed in one place."""
    ranged = cut(rows.withColumn(name, value.cast("long")).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    before = ranged.groupBy("_part").agg(F.sum(name).alias("_sum")).withColumn("_before", F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)))
    here = F.sum(name).over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return ranged.withColumn(name, here).join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def numbered(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """rows with name: 1, 2, ... in this order, which no task sorts alone."""
    return running_sum(rows, name, F.lit(1), *order)
