"""Stamps that later ones wholly overwrite.

From the newest back, a stamp goes if in every cell it matters in the later flatten stamps that stay leave almost nothing of it. What stays decides, so stamps wait for
later ones; but bounds settle most at once. In a cell the shares left by the later stamps known to stay bound what is left of it from above, those by all not known to go
from below. A stamp goes as soon as the upper bound is low enough in all its cells, and stays as soon as the lower one is too high in one. The newest open stamp
can always be settled, and stamps that don't meet are settled side by side: cells are the only groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .staging import cut
from .stamps import RAISE


def pruned(stamps: DataFrame, hits: DataFrame, tolerance: float = 1e-3, eps: float = 1e-3) -> DataFrame:
    """(seq, keep) of stamps (seq, tool), given the cells they reach, hits (seq, row, col, w). A stamp that matters (w over eps) in no cell stays."""
    cells = cut(hits.select("seq", "row", "col", "w").join(stamps.select("seq", (F.col("tool") != RAISE).alias("flatten")), "seq"))
    matters = cells.where(F.col("w") > eps).select("seq").distinct().withColumn("open", F.lit(True))
    state = cut(stamps.select("seq").join(matters, "seq", "left").select("seq", F.when(F.col("open"), F.lit(None)).otherwise(True).alias("keep")))
    later = W.partitionBy("row", "col").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1)
    left = F.when(F.col("flatten"), 1 - F.col("w")).otherwise(1.0)
    while not state.where("keep IS NULL").isEmpty():
        met = cells.join(state, "seq").where("keep IS NULL OR keep")
        high = F.coalesce(F.product(F.when(F.col("keep"), left).otherwise(1.0)).over(later), F.lit(1.0))
        low = F.coalesce(F.product(left).over(later), F.lit(1.0))
        bounds = met.select("seq", "keep", "w", high.alias("high"), low.alias("low")).where(F.col("keep").isNull() & (F.col("w") > eps))
        settled = bounds.groupBy("seq").agg(F.when(F.max("low") > tolerance, True).when(F.max("high") <= tolerance, False).alias("now"))
        state = cut(state.join(settled, "seq", "left").select("seq", F.coalesce("keep", "now").alias("keep")))
    return state
