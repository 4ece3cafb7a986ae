"""URL verdicts by rules and, where none fits, by trust and distrust spread over the host graph.

Trust is a personalised PageRank from hosts whose pages the allow rules fit: a host gives its value to the hosts it links to, by their share of
its links. Distrust is the same on the reversed graph, from hosts whose pages the block rules fit: a host gives its value to the hosts that link
to it, by their share of the links it gets (distrust_by="target", as the query takes it), or by the share of their own links that lead to it
(distrust_by="source"). A host starts with the share of its pages that such rules fit, one without pages with the rule of
its path /. Edges are links between hosts, counted per pair before anything is joined. A host is blocked where its distrust reaches
`threshold` and exceeds its trust. Values are carried on until none moves by more than `settled`, which damping brings about in at most
log(settled) / log(damping) rounds; there is no cap. DataFrame operations only.

Defined results: a null url, or one without ://, has an empty host and path and no rule; its host "" takes part like
any other; null html has no links; what reaches a host without links ends there; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The contract's rules: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
MOST_RULES = 500
LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'>\s]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    host, path = (F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit("")) for k in (1, 2))
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null; rules are a small parameter, folded into one CASE."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight, back): links of html from host to another host; weight is their share of the source's links, back that of the links
    the target gets."""
    links = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(LINK), F.lit(1)))).alias("to"))
    pairs = links.select(F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    out, into = (pairs.groupBy(side).agg(F.sum("n").alias(f"of_{side}")) for side in ("src", "dst"))
    return pairs.join(out, "src").join(into, "dst").select("src", "dst", (F.col("n") / F.col("of_src")).alias("weight"), (F.col("n") / F.col("of_dst")).alias("back"))


def spread(edges: DataFrame, start: DataFrame, source: str, target: str, weight: str, damping: float, settled: float) -> DataFrame:
    """(host, value): value = (1 - damping) * start + damping * what comes over the edges from source to target."""
    if not 0 <= damping < 1 or settled <= 0:
        raise ValueError("damping must be under 1 and settled over 0")
    base = start.select("host", ((1 - damping) * F.col("start")).alias("base"))
    now = staged(base.select("host", F.col("base").alias("value")), "rank")
    while True:
        came = edges.join(now.select(F.col("host").alias(source), "value"), source).groupBy(F.col(target).alias("host")).agg(F.sum(F.col(weight) * F.col("value")).alias("came"))
        after = base.join(came, "host", "full").select("host", (F.coalesce("base", F.lit(0.0)) + damping * F.coalesce("came", F.lit(0.0))).alias("value"))
        after = staged(after, "rank")
        moved = after.join(now.withColumnRenamed("value", "before"), "host", "left").agg(F.max(F.abs(F.col("value") - F.coalesce("before", F.lit(0.0))))).first()[0]
        remove(now)
        now = after
        if (moved or 0.0) <= settled:
            return now


def judge_urls(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
    damping: float = 0.85, settled: float = 1e-6, threshold: float = 0.075,
    distrust_by: str = "source",
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page."""
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    ruled = parts.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    hosts = staged(
        ruled.groupBy("host").agg(
            F.avg(F.expr("CAST(fit.verdict <=> 'allow' AS int)")).alias("allowed"), F.avg(F.expr("CAST(fit.verdict <=> 'block' AS int)")).alias("blocked")
        ),
        "hosts",
    )
    edges = staged(host_edges(parts), "edges")
    only_linked = edges.select(F.col("dst").alias("host")).distinct().join(hosts, "host", "left_anti").withColumn("v", rule_of(F.col("host"), F.lit("/"), rules)["verdict"])
    only_linked = only_linked.select("host", F.expr("CAST(v <=> 'allow' AS double)").alias("allowed"), F.expr("CAST(v <=> 'block' AS double)").alias("blocked"))
    starts = staged(hosts.unionByName(only_linked), "starts")
    trust = spread(edges, starts.select("host", F.col("allowed").alias("start")), "src", "dst", "weight", damping, settled)
    distrust = spread(edges, starts.select("host", F.col("blocked").alias("start")), "dst", "src", {"target": "back", "source": "weight"}[distrust_by], damping, settled)
    scores = hosts.select("host").join(trust.withColumnRenamed("value", "trust"), "host", "left").join(distrust.withColumnRenamed("value", "distrust"), "host", "left").na.fill(0.0)
    scores = staged(scores, "scores")
    for used in (hosts, edges, starts, trust, distrust):
        remove(used)
    judged = F.when((F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")), "block").otherwise("allow")
    return (
        ruled.drop("html")
        .join(scores, "host", "left")
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", judged).alias("verdict"), "trust", "distrust")
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), RULES, distrust_by="target")
