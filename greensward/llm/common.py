"""What the operators of this subpackage share: tables, staging in the shared folder, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Memo(dict):
    """What a Python worker remembers between batches: bounded, and only that of the operator at work is kept, since Spark
    reuses workers for one operator after another. Two generations: what hasn't been asked for while `most` / 2 others were is forgotten."""

    at_work: Memo | None = None

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most
        self.old: dict = {}

    def __missing__(self, key):
        value = self[key] = self.old[key]
        return value

    def forget(self) -> int:
        """Drop all; how much there was."""
        n = len(self) + len(self.old)
        self.clear()
        self.old = {}
        return n

    def take_turn(self) -> None:
        """Before each batch: forget what other operators remembered, and the older generation if the younger is full."""
        if Memo.at_work is not self:
            if Memo.at_work is not None and Memo.at_work.forget() > 10_000:
                give_back()
            Memo.at_work = self
        if len(self) > self.most // 2:
            self.old = dict(self)
            self.clear()


def give_back() -> None:
    """Return memory that is free within this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 2000 rows and 8 MB from now on: the JVM and the Python worker hold each batch more than once, and texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def text_runs(column: pa.Array, size: int = 2_000_000) -> Iterator[list[str]]:
    """The texts of a column in order, nulls as empty, in runs of about so many bytes; a longer text is a run of its own. A batch is never held
    as Python strings all at once."""
    length = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = run = 0
    for i, n in enumerate(length.tolist()):
        if i > start and run + n > size:
            yield [t or "" for t in column.slice(start, i - start).to_pylist()]
            start, run = i, 0
        run += n
    if start < len(length):
        yield [t or "" for t in column.slice(start).to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; one of our own only where it is unset and all run in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps now; it waits for the driver to collect garbage otherwise."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(df: DataFrame) -> None:
    """Delete the files of a staged table."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for parent in {unquote(f.rsplit("/", 1)[0]) for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def with_columns_renamed_apart(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Drop columns of df that clash with the result columns `names`, ignoring case."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the undirected edges (src, dst); component is the smallest node reachable.

    Each round the smallest label among a node's neighbours' and its own goes to the node and to the node its label names (the root), then
    labels are followed once (label of the label), until nothing changes: roots merge and paths halve, so long chains take few rounds. Only
    min-aggregates and equi-joins are used, so a node with very many neighbours is pre-aggregated before the shuffle. Each round is written to
    the shared folder. Nulls and self loops are ignored.
    """
    both = (
        edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
    )
    both = staged(both.distinct(), "edges")
    labels = staged(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("component")), "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("component").alias("c")), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("c").alias("c"))
        )
        offers = labels.join(near, "node").select("node", "component", F.least("component", "c").alias("c")).select(
            F.explode(F.array(F.struct("node", "c", F.col("component").alias("before")), F.struct(F.col("component").alias("node"), "c", F.lit(None).alias("before")))).alias("o")
        )
        hooked = staged(offers.groupBy("o.node").agg(F.min("o.c").alias("component"), F.max("o.before").alias("before")), "hooked")
        up = hooked.select(F.col("node").alias("component"), F.col("component").alias("up"))
        jumped = hooked.join(up, "component", "left").select("node", F.least("component", "up").alias("component"), "before")
        after = staged(jumped, "labels")
        changed = after.where("component <> before").limit(1).count()
        remove(labels)
        remove(hooked)
        labels = after
        if not changed:
            remove(both)
            return labels.select("node", "component")
