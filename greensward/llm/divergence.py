"""How far the sources of a language differ in their words, by integer codes of a sorted dictionary.

A term is a run of letters in the sense of bytes: A-Z and a-z, and everything beyond ASCII; only A-Z are lower-cased. Where documents are read,
each Arrow batch is coded as integers and counted per (language, source, term) with the number of documents. Spark sums those rows, sorts
them by range of (language, term) and codes them again, now for good: of each run of terms those in at least `least_docs` documents of the language
become a sorted array, a chunk of the dictionary, in which `searchsorted` finds an id. Chunks are numbered in the order of ranges, so (chunk, id)
is the order of the terms' UTF-8 and ties need no strings. A group's counts in a chunk are made dense by `bincount`; groups of a language meet in
blocks, chunk by chunk, and only sums leave a task. Nothing is broadcast and no task holds more than a chunk for two blocks of groups.

Shares and divergences are integers (see `share` and `divergence`), so results don't depend on the order of sums.

Defined results: null text, language and source count as ''; a group without terms has the shares of counts of 0; where no term of a language is
kept, its pairs have 0 and there are no term rows; a language with one source has no pairs; repeated rows are documents of their own; an empty table
gives no rows; other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, staged, table, text_runs

TERMS = 8192  # of a chunk
BLOCK = 32  # groups that meet as one block, on average
ROWS = 200_000  # sorted rows that are coded at once
UNIT = 10**9

_byte = np.arange(256)
_upper = (_byte >= 0x41) & (_byte <= 0x5A)
IN_TERM = _upper | (_byte >= 0x61) & (_byte <= 0x7A) | (_byte >= 0x80)
LOWER = np.where(_upper, _byte + 32, _byte).astype(np.uint8)


def coded(data: bytes) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each term in data: where it starts, and its place in the array of different terms."""
    raw = np.frombuffer(data, np.uint8)
    inside = np.concatenate([[False], IN_TERM[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    letters = LOWER[raw[inside[1:-1]]]
    terms = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
    return starts, terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary


def pieces(data: bytes, size: int) -> Iterator[bytes]:
    """Data in pieces of about so many bytes, cut behind bytes that no term holds."""
    at = 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and IN_TERM[data[end - 1]]:
            end += 1
        yield data[at:end]
        at = end


def counted(texts: list[str], group: np.ndarray, size: int) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(group, term, occurrences, documents) of the texts, each text of the group beside it."""
    raw = [t.encode() for t in texts]
    if len(raw) == 1 and len(raw[0]) > 2 * size:  # a very long text, in pieces
        parts = [(terms, np.bincount(code, minlength=len(terms))) for _, code, terms in map(coded, pieces(raw[0], size))]
        whole = pa.table({"t": pa.concat_arrays([t for t, _ in parts]), "n": np.concatenate([n for _, n in parts])}).group_by("t").aggregate([("n", "sum")])
        n = whole["n_sum"].to_numpy()
        return np.full(len(n), group[0]), whole["t"].combine_chunks(), n, np.ones(len(n), np.int64)
    starts, code, terms = coded(b"\0".join(raw))
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), starts, side="right")
    width = max(1, len(terms))
    key, n = np.unique(doc * width + code, return_counts=True)
    key, back = np.unique(group[key // width] * width + key % width, return_inverse=True)
    return key // width, terms.take(pa.array(key % width)), np.bincount(back, n, len(key)).astype(np.int64), np.bincount(back, minlength=len(key))


def term_counts(docs: DataFrame, size: int = 8_000_000) -> DataFrame:
    """(lang, source, term, n, docs) summed over all of docs (lang, source, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            at = 0
            for run in text_runs(batch.column(2), size):
                g, term, n, d = counted(run, group[at : at + len(run)], size)
                at += len(run)
                for i in range(0, len(g), 50_000):
                    part = slice(i, i + 50_000)
                    which = [c.dictionary.take(pa.array(k)) for c, k in ((lang, g[part] // len(source.dictionary)), (source, g[part] % len(source.dictionary)))]
                    yield pa.RecordBatch.from_arrays([*which, term[i : i + 50_000].cast(pa.string()), pa.array(n[part]), pa.array(d[part])], ["lang", "source", "term", "n", "docs"])

    rows = docs.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


CHUNKS = "lang string, chunk long, source string, width int, terms array<string>, ids array<int>, counts array<long>"


def chunked(rows: pa.Table, least_docs: int, width: int) -> Iterator[dict]:
    """The chunks of one language's rows (term, source, n, docs), which are sorted by term: a row for each source, and one of the whole with the terms."""
    code = rows["term"].combine_chunks().dictionary_encode()
    at, n = code.indices.to_numpy().astype(np.int64), rows["n"].to_numpy()
    kept = np.flatnonzero(np.bincount(at, rows["docs"].to_numpy(), len(code.dictionary)) >= least_docs)
    if not len(kept):
        return
    source = rows["source"].combine_chunks().dictionary_encode()
    group = source.indices.to_numpy().astype(np.int64)
    ids = np.searchsorted(kept, at)
    held = (ids < len(kept)) & (kept[np.minimum(ids, len(kept) - 1)] == at)
    ids, group, n = ids[held], group[held], n[held]
    terms = code.dictionary.take(pa.array(kept))
    for first in range(0, len(kept), width):
        here = slice(first, first + width)
        inside = (ids >= first) & (ids < first + width)
        i, g, c = ids[inside] - first, group[inside], n[inside]
        found = terms[here].to_pylist()
        yield {"source": None, "width": len(found), "terms": found, "ids": range(len(found)), "counts": dense(i, c, len(found))}
        order = np.lexsort((i, g))
        for part in np.split(order, np.flatnonzero(np.diff(g[order])) + 1):
            yield {"source": source.dictionary[g[part[0]]].as_py(), "width": len(found), "terms": None, "ids": i[part], "counts": c[part]}


def dense(ids: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """The vector with these counts at these ids; counts under 2 ** 53 are exact."""
    return np.bincount(ids, counts, width).astype(np.int64)


def coded_chunks(counts: DataFrame, least_docs: int, width: int = TERMS) -> DataFrame:
    """Counts sorted by range of (lang, term) and coded: rows CHUNKS, source null for the whole language."""
    kind = pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("source", pa.string()), ("width", pa.int32()), ("terms", pa.list_(pa.string())), ("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32

        def of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal chunk
            lang = rows["lang"].combine_chunks().dictionary_encode()
            at = np.searchsorted(lang.indices.to_numpy(), np.arange(len(lang.dictionary) + 1))
            for k, name in enumerate(lang.dictionary.to_pylist()):
                for row in chunked(rows.slice(at[k], at[k + 1] - at[k]), least_docs, width):
                    chunk += row["source"] is None
                    yield pa.RecordBatch.from_pylist([row | {"lang": name, "chunk": chunk}], kind)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS:
                rows = pa.Table.from_batches(held)
                last = rows.slice(n - 1)
                same = np.asarray(pc.and_(pc.equal(rows["term"], last["term"][0]), pc.equal(rows["lang"], last["lang"][0])))
                whole = int(same.argmax())  # the last term may go on
                if whole:
                    yield from of(rows.slice(0, whole))
                    held, n = rows.slice(whole).to_batches(), n - whole
        if n:
            yield from of(pa.Table.from_batches(held))

    rows = counts.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    return rows.select("lang", "term", "source", "n", "docs").mapInArrow(encode, CHUNKS)


def share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(10**9 * count / total) for 0 <= count <= total < 2 ** 53, by long division in steps of 1000, which fit 64 bits."""
    whole, rest = np.divmod(count, total)
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digit
    return 1 + whole


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)**2 / (p + q)) for shares up to 10**9 + 1, whose squares fit 64 bits."""
    return (p - q) ** 2 // (p + q)


FOUND = "lang string, chunk long, id int, source string, item string, value long"


def met(rows: pa.Table, top: int) -> pa.Table:
    """Two blocks of a language's groups in a chunk: divergence of each pair, named once, and each group's `top` terms where a block meets itself."""
    rows = rows.to_pydict()
    a, b, width = rows["a"][0], rows["b"][0], rows["width"][0]
    whole = [k for k, s in enumerate(rows["source"]) if s is None]
    groups = [k for k, s in enumerate(rows["source"]) if s is not None]

    def shares(k: int) -> tuple[np.ndarray, np.ndarray]:
        counts = dense(np.array(rows["ids"][k] or [], np.int64), np.array(rows["counts"][k] or [], np.int64), width)
        return counts, share(counts + 2, rows["total"][k] + 2 * rows["kept"][k])

    counts, p = (np.array(x).reshape(len(groups), width) for x in (zip(*map(shares, groups)) if groups else ([], [])))
    found = []
    name, block = [rows["source"][k] for k in groups], np.array([rows["block"][k] for k in groups])
    for i in range(len(groups)):
        others = np.arange(i + 1, len(groups)) if a == b else np.flatnonzero(block == b) if block[i] == a else np.zeros(0, int)
        for j, value in zip(others, divergence(p[others], p[i]).sum(axis=1), strict=True):
            first, second = sorted((name[i], name[j]), key=str.encode)
            found.append({"source": first, "item": second, "value": int(value)})
    for k in whole:
        _, q = shares(k)
        for i in range(len(groups)):
            ids = np.flatnonzero((counts[i] > 0) & (p[i] > q))
            value = divergence(p[i][ids], q[ids])
            found += [{"source": name[i], "id": int(ids[x]), "item": rows["terms"][k][ids[x]], "value": int(value[x])} for x in np.lexsort((ids, -value))[:top]]
    out = [{"lang": rows["lang"][0], "chunk": rows["chunk"][0]} | f for f in found]
    return pa.Table.from_pylist(out, pa.schema([("lang", pa.string()), ("chunk", pa.int64()), ("id", pa.int32()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())]))


def source_divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10, width: int = TERMS, block: int = BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` compares a group with each other source of its language over all kept terms, part `term`
    names the up to `top` terms that set a group off most from its language."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    chunks = staged(coded_chunks(staged(term_counts(docs), "term-counts"), least_docs, width), "term-chunks")
    number = F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)
    totals = chunks.where("source IS NOT NULL").groupBy("lang", "source").agg(F.sum(number).alias("total"))
    langs = chunks.where("source IS NULL").groupBy("lang").agg(F.sum(number).alias("total"), F.sum("width").cast("long").alias("kept"))
    of_lang = docs.select("lang", "source").distinct()
    blocks = of_lang.groupBy("lang").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    groups = of_lang.join(totals, ["lang", "source"], "left").join(langs.select("lang", "kept"), "lang", "left").join(blocks, "lang")
    groups = staged(
        groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept"), "blocks", F.expr("cast(pmod(xxhash64(source), blocks) AS int)").alias("block")), "term-groups"
    )

    each = groups.join(chunks.where("source IS NULL").select("lang", "chunk", "width"), "lang").join(chunks.where("source IS NOT NULL").select("lang", "chunk", "source", "ids", "counts"), ["lang", "chunk", "source"], "left")
    every = F.expr("sequence(0, blocks - 1)")
    meeting = each.withColumn("x", F.explode(every)).select(
        "lang", "chunk", F.least("block", "x").alias("a"), F.greatest("block", "x").alias("b"), "source", "total", "kept", "block", "width", F.lit(None).cast("array<string>").alias("terms"), "ids", "counts"
    )
    whole = chunks.where("source IS NULL").join(langs, "lang").join(blocks, "lang").withColumn("x", F.explode(every)).select(
        "lang", "chunk", F.col("x").alias("a"), F.col("x").alias("b"), "source", "total", "kept", F.lit(-1).alias("block"), "width", "terms", "ids", "counts"
    )
    found = staged(meeting.unionByName(whole).groupBy("lang", "chunk", "a", "b").applyInArrow(lambda rows: met(rows, top), FOUND), "term-divergence")

    sums = found.where("id IS NULL").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))).alias("p")).select("lang", "p.*")
    none = groups.where("kept = 0")  # not a term to sum over
    zero = none.select("lang", "source").join(none.select("lang", F.col("source").alias("item")), "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    by = Window.partitionBy("lang", "source")
    pairs = both.unionByName(zero).withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "item"))).withColumn("part", F.lit("pair"))
    terms = found.where("id IS NOT NULL").withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "chunk", "id"))).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    names = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(names).unionByName(terms.select(names))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return source_divergence(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
  w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
  per_doc AS (SELECT r, lang, source, term, count(*) AS c FROM w GROUP BY ALL),
  kept AS (SELECT lang, term FROM per_doc GROUP BY lang, term HAVING count(*) >= 10),
  v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
  n AS (SELECT lang, source, term, sum(c) AS n FROM per_doc JOIN kept USING (lang, term) GROUP BY lang, source, term),
  groups AS (SELECT DISTINCT lang, source FROM d),
  total AS (SELECT g.lang, g.source, coalesce(sum(n.n), 0) AS total FROM groups g LEFT JOIN n ON n.lang = g.lang AND n.source = g.source GROUP BY 1, 2),
  p AS (SELECT t.lang, t.source, k.term, coalesce(n.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n.n, 0)::HUGEINT + 2)) // (t.total::HUGEINT + 2 * v.v) AS p
    FROM total t JOIN kept k ON k.lang = t.lang JOIN v ON v.lang = t.lang LEFT JOIN n ON n.lang = t.lang AND n.source = t.source AND n.term = k.term),
  lang_total AS (SELECT lang, sum(n) AS total FROM n GROUP BY lang),
  lang_n AS (SELECT lang, term, sum(n) AS n FROM n GROUP BY lang, term),
  q AS (SELECT l.lang, l.term, 1 + (1000000000::HUGEINT * (l.n::HUGEINT + 2)) // (t.total::HUGEINT + 2 * v.v) AS q FROM lang_n l JOIN lang_total t USING (lang) JOIN v USING (lang)),
  sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
  pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
  terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - q.q) * (p.p - q.q) // (p.p + q.q) AS value FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE p.n > 0 AND p.p > q.q),
  ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
    UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM terms) WHERE rank <= 10)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked
"""
