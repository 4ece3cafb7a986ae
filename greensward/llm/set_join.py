"""Exact self-join of word-shingle sets by Jaccard similarity, with skipping by set relations, and its components.

1. Equal sets are one class (pre-aggregated by a 128-bit digest of the set), so exact copies cost one row.
2. Each class puts the first tokens of its set, in one global order, into index lists. Tokens that many sets hold stand last
   in that order, so shared passages stay out of the prefixes.
3. Lists are cut into blocks by size class and position. A block's leader is its member with the foremost position.
   Each member is compared with one leader, and leaders of neighbouring blocks with each other; components of these
   links are families.
   Before sets are compared pairs are dropped whose parity bits (512 per set, 4096 more for large ones) differ in more places than linked sets can.
4. A set's answers are then derived from its leader's: pairs within a family are joined already and never made; for two
   sets that know their overlap with the same leader, |x|-based bounds decide most of the rest. The foremost 64 members of a block (heads)
   are compared with all members of other families in the list, of blocks whose sizes and positions allow the overlap, and families are
   joined by the links found. Only then the members of longer blocks that aren't heads are compared with each other, if they are still of
   different families: a large group of near copies is one family by then for the most part.

Two sets link when 100 |x & y| >= 90 |x | y| (general: percent). Every pair of different families that may link is
compared, so components are those of all links. Shingles and words are 64-bit hashes.

Defined results: texts without words have an empty set and link with nothing; fewer words than a shingle are one
shingle; null texts are empty; repeated rows are copies; rows with a null id link like any other and are labelled by the smallest id
reachable, null if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import connected_components, release, remove, staged, table, text_runs
from .decontaminate import windows, words_of

MOST_BROADCAST = 1_000_000  # ids of 8 bytes
BIG_FROM = 1200  # tokens; sets of so many have 4096 parity bits besides


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; short texts are one shingle."""
    words = words_of(text)
    h = windows(words, min(size, len(words))) if len(words) else words
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(h ^ (h >> np.uint64(32)))


def digest(tokens: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(tokens.tobytes())


def prefix_length(n: int, percent: int) -> int:
    """Tokens of which a linked set must share one: n - ceil(percent n / 100) + 1."""
    return n + (-percent * n) // 100 + 1


def parity_bits(tokens: np.ndarray, bits: int = 512) -> np.ndarray:
    """For each of so many places whether an odd number of tokens falls on it: two sets differ in at least as many tokens as their bits do."""
    odd = np.bincount((tokens >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def as_long(tokens: np.ndarray) -> np.ndarray:
    return tokens.view(np.int64)


def indexed_sets(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(doc_id, n, sig, head, bits, big) of each row; head is a little more of the tokens of smallest hash than a prefix needs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [described(shingles(t, size)) for run in text_runs(batch.column(1)) for t in run]
            n, sig, heads, bits, big = zip(*made) if made else ((),) * 5
            arrays = [pa.array(n, pa.int64()), pa.array(sig, pa.binary()), long_lists(heads), long_lists(bits), pa.array(big, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n", "sig", "head", "bits", "big"])

    def described(s: np.ndarray) -> tuple:
        head = as_long(s[: prefix_length(len(s), percent) * 5 // 4 + 1].copy() if len(s) else s)
        return len(s), digest(s), head, parity_bits(s), parity_bits(s, 4096) if len(s) >= BIG_FROM else None

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(sets, f"doc_id {kind}, n long, sig binary, head array<long>, bits array<long>, big array<long>")


def long_lists(arrays: Sequence[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays) if arrays else [], pa.int64()))


def with_prefixes(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, classes: DataFrame, several: DataFrame, frequent_from: int, most_frequent: int) -> DataFrame:
    """(cid, n, prefix, again): the first tokens of each class in the global order, frequent tokens last. Where a head holds too few others,
    again is true and the prefix comes from the text, read once more."""
    top = several.where(F.col("c") > frequent_from).orderBy(F.desc("c"), "token").limit(most_frequent)  # at most most_frequent numbers, which only set the order
    frequent = np.sort(top.select("token").toArrow()["token"].to_numpy().view(np.uint64))
    late = docs.sparkSession.sparkContext.broadcast(frequent)

    def first(s: np.ndarray, n: int, whole: bool) -> np.ndarray | None:
        k, last = prefix_length(n, percent), late.value
        if len(last):
            common = last[np.minimum(np.searchsorted(last, s), len(last) - 1)] == s
            if not whole and len(s) < n and (~common).sum() < k:
                return None
            s = np.concatenate((s[~common][:k], s[common][:k]))
        return as_long(s[:k])

    def of_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [first(np.array(h, np.int64).view(np.uint64), n, False) for h, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.list_(pa.int64()))], ["cid", "n", "prefix"])

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(c, len(s), first(s, len(s), True)) for t, c, sig in zip(*(batch.column(k).to_pylist() for k in range(3))) if digest(s := shingles(t, size)) == sig]
            yield pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["cid", "n", "prefix"])

    heads = staged(classes.select("cid", "head", "n").mapInArrow(of_heads, "cid long, n long, prefix array<long>"), "heads")
    again = heads.where("prefix IS NULL").select("cid")
    read = texts_of(docs, id_col, text_col, size, classes, again).mapInArrow(of_texts, "cid long, n long, prefix array<long>")
    read = read.groupBy("cid").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    out = staged(heads.where("prefix IS NOT NULL").withColumn("again", F.lit(False)).unionByName(read.withColumn("again", F.lit(True))), "prefixes")
    remove(heads)
    return out


def texts_of(docs: DataFrame, id_col: str, text_col: str, size: int, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(text, cid, sig): texts of rows with the classes' smallest ids; a row is of the class only if its set has the digest sig. Classes
    without any id are found among the rows without one, by their digest."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = [digest(shingles(t, size)) for run in text_runs(batch.column(0)) for t in run]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sig, pa.binary())], ["text", "sig"])

    wanted = classes.join(ids, "cid", "left_semi").select("cid", "sig", F.col("least").alias("doc_id"))
    named = wanted.where("doc_id IS NOT NULL")
    if ids.count() <= MOST_BROADCAST:
        named = F.broadcast(named)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = rows.join(named, "doc_id").select("text", "cid", "sig")
    if not wanted.where("doc_id IS NULL").limit(1).count():
        return found
    nameless = rows.where("doc_id IS NULL").select("text").mapInArrow(signed, "text string, sig binary").join(wanted.where("doc_id IS NULL").select("cid", "sig"), "sig")
    return found.unionByName(nameless.select("text", "cid", "sig"))


def sets_of(docs: DataFrame, id_col: str, text_col: str, size: int, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(cid, tokens): the sets of the classes in ids, made again from their texts. Rows that repeat an id and text give a set once a partition;
    the answers of such copies are equal."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            made = []
            for text, cid, sig in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if cid not in done and digest(s := shingles(text, size)) == sig:
                    done.add(cid)
                    made.append((cid, s.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary())], ["cid", "tokens"])

    made = texts_of(docs, id_col, text_col, size, classes, ids).mapInArrow(sets, "cid long, tokens binary")
    return staged(made, "sets")


def by_bits(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose parity bits don't differ in more places than linked sets of their sizes can differ in tokens."""
    a, b = (classes.select(F.col("cid").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"b{c}"), F.col("big").alias(f"big{c}")) for c in ("x", "y"))
    apart = "aggregate(zip_with(bigx, bigy, (p, q) -> bit_count(p ^ q)), 0, (s, v) -> s + v)"
    near_big = F.expr(f"bigx IS NULL OR bigy IS NULL OR {apart} <= nx + ny - 2 * ceil({percent} * (nx + ny) / {100 + percent})")
    return pairs.join(a, "x").join(b, "y").where(near_bits("bx", "by", "nx", "ny", percent) & near_big).select(*pairs.columns)


def near_bits(bx: str, by: str, nx: str, ny: str, percent: int) -> Column:
    apart = " + ".join(f"bit_count({bx}[{i}] ^ {by}[{i}])" for i in range(8))
    return F.expr(f"{apart} <= {nx} + {ny} - 2 * ceil({percent} * ({nx} + {ny}) / {100 + percent})")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y, na, nb, common) of the pairs (x, y)."""

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [compared(p, q) for p, q in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([m[k] for m in made], pa.int64()) for k in range(3))], ["x", "y", "na", "nb", "common"])

    def compared(p: pa.Scalar, q: pa.Scalar) -> tuple[int, int, int]:
        a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (p, q))  # views of the batch
        return len(a), len(b), len(np.intersect1d(a, b, assume_unique=True))

    joined = pairs.join(sets.select(F.col("cid").alias("x"), F.col("tokens").alias("a")), "x").join(sets.select(F.col("cid").alias("y"), F.col("tokens").alias("b")), "y")
    return joined.select("x", "y", "a", "b").mapInArrow(common, "x long, y long, na long, nb long, common long")


def joinable(nx: Column | str, ny: Column | str, common: str, percent: int) -> Column:
    return F.expr(f"100 * ({common}) >= {percent} * ({nx} + {ny} - ({common}))")


def need(nx: str, ny: str, percent: int) -> str:
    """SQL: the least overlap of linked sets of these sizes."""
    return f"ceil({percent} * ({nx} + {ny}) / {100 + percent})"


def fits(nx: str, px: str, ny: str, py: str, percent: int) -> str:
    """SQL: whether sets of these sizes that share a token at these positions, and none before, can link."""
    return f"least({nx} - {px}, {ny} - {py}) >= {need(nx, ny, percent)} AND 100 * least({nx}, {ny}) >= {percent} * greatest({nx}, {ny})"


def pairs_within(small: DataFrame, large: DataFrame, percent: int) -> DataFrame:
    """(x, y, sure): x of small and y of large, y no smaller, in one list and of different families, that may link; sure: they do link by what
    both know of one leader. Both have (token, blk, cid, n, pos, fam, lead, o, nl, bits): overlap o with a leader of size nl."""
    enough = need("x_n", "y_n", percent)
    front = small.where(f"pos <= n - {need('n', 'n', percent)}")  # positions that a set's token can have in a link with one no smaller
    x = front.select("token", F.explode(F.array("blk", F.col("blk") + 1)).alias("blk"), *[F.col(c).alias(f"x_{c}") for c in ("cid", "n", "pos", "fam", "lead", "o", "nl", "bits")])
    y = large.select("token", "blk", *[F.col(c).alias(f"y_{c}") for c in ("cid", "n", "pos", "fam", "lead", "o", "bits")])
    same_lead = "x_lead <=> y_lead AND x_lead IS NOT NULL"
    possible = (
        f"x_fam <> y_fam AND (x_n < y_n OR (x_n = y_n AND x_cid < y_cid)) AND {fits('x_n', 'x_pos', 'y_n', 'y_pos', percent)}"
        f" AND NOT ({same_lead} AND least(x_o, y_o) + least(x_n - x_o, y_n - y_o) < {enough})"
    )
    sure = F.expr(f"coalesce({same_lead} AND x_o + y_o - x_nl >= {enough}, false)").alias("sure")
    return x.join(y, ["token", "blk"]).where(F.expr(possible) & near_bits("x_bits", "y_bits", "x_n", "y_n", percent)).select(F.col("x_cid").alias("x"), F.col("y_cid").alias("y"), sure)


def links_of(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, classes: DataFrame) -> DataFrame:
    """(src, dst): the pairs (x, y, sure) that link; those not sure are compared by their sets."""
    pairs = staged(pairs.distinct(), "pairs")
    rest = staged(by_bits(pairs.where("NOT sure").select("x", "y"), classes, percent), "rest")
    known = sets_of(docs, id_col, text_col, size, classes, rest.select(F.col("x").alias("cid")).union(rest.select(F.col("y").alias("cid"))).distinct())
    links = overlaps(rest, known).where(joinable("na", "nb", "common", percent)).select("x", "y").union(pairs.where("sure").select("x", "y"))
    links = staged(links.select(F.col("x").alias("src"), F.col("y").alias("dst")), "links")
    for used in (pairs, rest, known):
        remove(used)
    return links


def star(parts: DataFrame) -> DataFrame:
    """(src, dst) that hold the components of parts together."""
    return parts.where("node <> component").select(F.col("node").alias("src"), F.col("component").alias("dst"))


def with_family(members: DataFrame, parts: DataFrame) -> DataFrame:
    """members with fam, their component or themselves, as far as their list holds more than one."""
    of = members.drop("fam").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("fam", F.coalesce("component", "cid")).drop("component")
    of = staged(of, "members")
    mixed = of.groupBy("token").agg(F.min("fam").alias("f"), F.max("fam").alias("g")).where("f <> g").select("token")
    out = staged(of.join(mixed, "token", "left_semi"), "open")
    remove(of)
    return out


def similar_sets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, frequent_from: int = 30, most_frequent: int = 500_000, heads: int = 64
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    indexed = staged(indexed_sets(docs, id_col, text_col, size, percent), "indexed")
    whole = indexed.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("head").alias("head"), F.first("bits").alias("bits"), F.first("big").alias("big"))
    whole = staged(whole.withColumn("cid", F.monotonically_increasing_id()), "classes")
    rows = staged(indexed.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sig")).alias("sig")), "rows")
    remove(indexed)
    release(docs.sparkSession)
    several = staged(whole.select(F.explode("head").alias("token")).groupBy("token").agg(F.count("*").alias("c")).where("c > 1"), "several")
    prefixes = with_prefixes(docs, id_col, text_col, size, percent, whole, several, frequent_from, most_frequent)
    classes = staged(whole.drop("head"), "classes")
    remove(whole)
    release(docs.sparkSession)

    # Index lists: only tokens of two classes or more matter. Block of a set: its size class, a little wider than the ratio of linked sizes.
    blk = F.expr(f"CAST(floor(ln(n) / ln(100.0 / {percent} * 1.001)) AS int)").alias("blk")
    kept = several.select("token").union(prefixes.where("again").select(F.explode("prefix").alias("token")))
    postings = prefixes.select("cid", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("pos", "token")).join(kept, "token", "left_semi")
    shared = staged(postings.select("token", blk, "cid", "n", "pos"), "postings")
    remove(several)
    remove(prefixes)
    release(docs.sparkSession)

    # Leaders, and each member's one.
    leaders = staged(shared.groupBy("token", "blk").agg(F.min(F.struct("pos", "cid", "n")).alias("lead"), F.count("*").alias("c")), "leaders")
    follow = (
        shared.join(leaders.where("c > 1").select("token", "blk", "lead"), ["token", "blk"])
        .where("cid <> lead.cid").where(fits("n", "pos", "lead.n", "lead.pos", percent))
        .groupBy(F.col("cid").alias("x"), F.col("lead.cid").alias("y")).agg(F.count("*").alias("c"))
        .groupBy("x").agg(F.max(F.struct("c", F.col("y").alias("y"))).alias("best")).select("x", "best.y")
    )
    a, b = leaders.select("token", "blk", F.col("lead").alias("p")), leaders.select("token", (F.col("blk") - 1).alias("blk"), F.col("lead").alias("q"))
    beside = a.join(b, ["token", "blk"]).where("p.cid <> q.cid").where(fits("p.n", "p.pos", "q.n", "q.pos", percent)).select(F.expr("greatest(p.cid, q.cid)").alias("x"), F.expr("least(p.cid, q.cid)").alias("y"))
    first = staged(by_bits(follow.union(beside).distinct(), classes, percent), "pairs")
    known = sets_of(docs, id_col, text_col, size, classes, first.select(F.col("x").alias("cid")).union(first.select(F.col("y").alias("cid"))).distinct())
    answers = staged(overlaps(first, known), "answers")
    for used in (known, first, leaders):
        remove(used)
    family = connected_components(answers.where(joinable("na", "nb", "common", percent)).select(F.col("x").alias("src"), F.col("y").alias("dst")))
    release(docs.sparkSession)

    # Lists that hold several families: pairs that sizes, positions and the leaders' answers leave open.
    told = answers.groupBy("x").agg(F.max(F.struct("common", "y", "nb")).alias("t")).select(F.col("x").alias("cid"), F.col("t.y").alias("lead"), F.col("t.common").alias("o"), F.col("t.nb").alias("nl"))
    open_ = with_family(shared, family).join(told, "cid", "left").join(classes.select("cid", "bits"), "cid")
    open_ = staged(open_, "open")
    remove(shared)
    long_ = open_.groupBy("token", "blk").agg(F.count("*").alias("c")).where(f"c > {heads}").select("token").distinct()
    long_ = staged(long_, "long")
    of_long = open_.join(long_, "token", "left_semi")
    foremost = of_long.withColumn("k", F.row_number().over(Window.partitionBy("token", "blk").orderBy("pos", "cid"))).where(f"k <= {heads}").drop("k")
    foremost = staged(foremost, "heads")
    others = staged(of_long.join(foremost.select("token", "blk", "cid"), ["token", "blk", "cid"], "left_anti"), "others")
    release(docs.sparkSession)
    with_heads = pairs_within(open_.join(long_, "token", "left_anti").unionByName(foremost), open_, percent).union(pairs_within(others, foremost, percent))
    found = links_of(with_heads, docs, id_col, text_col, size, percent, classes)
    parts = connected_components(star(family).union(found))
    for used in (open_, long_, foremost, found, family, answers):
        remove(used)
    release(docs.sparkSession)

    rest = with_family(others, parts)
    found = links_of(pairs_within(rest, rest, percent), docs, id_col, text_col, size, percent, classes)
    joined = connected_components(star(parts).union(found))

    named = staged(classes.select("cid", "sig", "least").join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    out = rows.join(named.join(least, "component").select("sig", "component_id"), "sig", "left")
    out = staged(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    for used in (rows, classes, others, rest, found, parts, joined, named):
        remove(used)
    return out


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """docs without those whose group has a smaller id. Of rows that repeat an id and text one stays; rows without an id are only held against each other, by equal text."""
    parts = similar_sets(docs, id_col, text_col, size, percent)
    gone = parts.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    left = docs.join(gone, id_col, "left_anti")
    again = parts.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias(id_col))
    single = left.where(f"{id_col} IS NOT NULL").join(again, id_col, "left_anti")
    return single.unionByName(left.where(f"{id_col} IS NULL").dropDuplicates([text_col])).unionByName(left.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col]))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS s FROM w),
t AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM s),
l AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.t = b.t AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
r AS (SELECT doc_id AS v, doc_id AS c FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, c.component_id FROM s JOIN (SELECT v, min(c) AS component_id FROM r GROUP BY v) c ON c.v = s.doc_id
"""
