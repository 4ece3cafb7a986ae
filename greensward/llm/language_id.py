"""The language of a text: the one whose raw-content dictionary lets zstandard encode the text in the fewest bytes.

Learning reads at most `rows` rows of each language (those with the smallest hash of the id) and cuts them into sentences of at most 1000 bytes. Sentences
that rows of several languages hold are left out, and then those that dictionaries of the other half of the sentences take for another language: passages
are quoted across languages. A dictionary is filled with the sentences of the smallest hashes, each once, up to 16 kB, or an equal share of 16 MB where
there are over 1000 languages. That is all that is collected and sent to the tasks. A text is reduced to lower-case words with single spaces and encoded in blocks of 4 kB, so that the
dictionary counts for each part of a long text alike, with every language's dictionary. `score` takes each byte more than the best as one bit:
1 / sum(2 ** (best - bytes)). Where the second language needs less than `margin` more bytes than the best, the prediction isn't `reliable`.

Defined results: null text, text without a letter, and any text if nothing was learned are `und` with a score of 0; equal sizes go to the language that is
smaller as a string; rows without an id, language or letter aren't learned from, nor are languages all of whose sentences others hold too; repeated rows give a row each; columns named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, staged, table, with_columns_renamed_apart

NOT_WORD = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
SENTENCE = regex.compile(r"[^.!?\n]+")
PIECE = 1000
BLOCK = 4096
UNKNOWN = "und"
#: A search in hash chains without a model of costs: that model would price matches by the statistics of the text alone.
SEARCH = {"strategy": zstandard.STRATEGY_LAZY2, "min_match": 4, "search_log": 6, "target_length": 64, "window_log": 17, "chain_log": 17, "hash_log": 16}


def letters(text: str, size: int, slice_length: int = 1 << 20) -> Iterator[bytes]:
    """The words of a text in blocks of `size` bytes."""
    rest = b""
    for i in range(0, len(text), slice_length):
        rest += NOT_WORD.sub(" ", " " + text[i : i + slice_length].lower() + " ").encode()
        whole = len(rest) - len(rest) % size
        yield from (rest[k : k + size] for k in range(0, whole, size))
        rest = rest[whole:]
    if rest:
        yield rest


def sentences(text: str, most: int) -> list[tuple[int, bytes]]:
    """Hashes and letters of the different sentences of a text that have the smallest hashes, up to `most` bytes."""
    out, n = [], 0
    for h, piece in sorted((xxhash.xxh64_intdigest(b) >> 1, b) for b in {b for m in SENTENCE.finditer(text) for b in letters(m[0], PIECE) if b.strip()}):
        n += len(piece)
        if n > most:
            break
        out.append((h, piece))
    return out


def filled(pieces: DataFrame, size: int) -> dict[str, bytes]:
    """Of each language the pieces (lang, hash, piece) with the smallest hashes, up to `size` bytes."""
    length = F.sum(F.length("piece")).over(Window.partitionBy("lang").orderBy("hash", "piece").rowsBetween(Window.unboundedPreceding, 0))
    out: dict[str, bytes] = {}
    for row in pieces.withColumn("upto", length).where(F.col("upto") <= size).orderBy("lang", "upto").toLocalIterator():
        out[row.lang] = out.get(row.lang, b"") + bytes(row.piece)
    return out


def learned(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", rows: int = 400, size: int = 16_000, total: int = 16_000_000, held_out: bool = True) -> dict[str, bytes]:
    """A dictionary for each language; with held_out only from rows whose crc32 of the id as text isn't 1 modulo 3."""
    spark = docs.sparkSession
    known = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("id IS NOT NULL AND lang IS NOT NULL")
    if held_out:
        known = known.where("crc32(cast(id AS string)) % 3 <> 1")
    counts = known.groupBy("lang").count()
    langs = counts.count()
    size = min(size, total // max(1, langs))
    if size < PIECE:
        raise ValueError(f"{langs} languages don't fit into {total} bytes")
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / (1 << 40) * F.col("count")  # of a hash: by it about twice `rows` rows of a language go on to be sorted
    some = known.where(r"text rlike '\\p{L}'").join(F.broadcast(counts), "lang").where(share < 2 * rows)  # a row per language, at most `total` / 1000
    by_hash = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 40)), "id")
    chosen = some.select("lang", "id").distinct().withColumn("r", F.row_number().over(by_hash)).where(F.col("r") <= rows).select("lang", "id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = sentences(text, 2 * size)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array([h for h, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())], ["lang", "hash", "piece"])

    sample = known.join(F.broadcast(chosen), ["lang", "id"], "left_semi").select("lang", "text")  # at most `rows` rows of a language
    of_one = sample.mapInArrow(cut, "lang string, hash long, piece binary").groupBy("hash", "piece").agg(F.min("lang").alias("lang"), F.max("lang").alias("other")).where("lang = other")
    pieces = staged(of_one.select("lang", "hash", "piece"), "sentences")
    halves = spark.sparkContext.broadcast([filled(pieces.where(f"hash % 2 = {i}"), size) for i in (0, 1)])  # at most twice `total` bytes

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [Encoders(d) for d in halves.value]
        for batch in batches:
            others = [encoders[1 - h % 2] for h in batch.column("hash").to_pylist()]
            rows = zip(others, batch.column("lang").to_pylist(), batch.column("piece").to_pylist(), strict=True)
            yield batch.filter(pa.array([lang not in e.langs or e.closest([piece])[0] == lang for e, lang, piece in rows], pa.bool_()))

    return filled(pieces, size) | filled(pieces.mapInArrow(own, "lang string, hash long, piece binary"), size)


class Encoders:
    """A compressor for each language; sizes of texts in bytes."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.langs = sorted(dictionaries)
        how = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **SEARCH)
        self.encoders = []
        for lang in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=how)
            self.encoders.append(zstandard.ZstdCompressor(compression_params=how, dict_data=content))

    def closest(self, blocks: Iterable[bytes]) -> tuple[str, float, float]:
        """(language, score, by which share more bytes the second language needs)."""
        sizes = [0] * len(self.langs)
        for block in blocks:
            for k, encoder in enumerate(self.encoders):
                sizes[k] += len(encoder.compress(block))
        best, *others = sorted(sizes)
        score = 1 / sum(2.0 ** max(best - n, -100) for n in sizes)
        return self.langs[sizes.index(best)], score, others[0] / best - 1 if others else 1.0

    def predicted(self, text: str | None) -> tuple[str, float, float]:
        if not text or not self.langs or not LETTER.search(text):
            return UNKNOWN, 0.0, 0.0
        return self.closest(letters(text, BLOCK))


def predict_language(docs: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text", margin: float = 0.02) -> DataFrame:
    """docs with lang_pred, score and reliable; columns of these names are replaced."""
    names = ["lang_pred", "score", "reliable"]
    docs = with_columns_renamed_apart(docs, names)
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)  # at most `total` bytes
    t = docs.columns.index(text_col)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(sent.value)
        for batch in batches:
            found = [encoders.predicted(text.as_py()) for text in batch.column(t)]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] >= margin for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(predict, f"{schema}, lang_pred string, score double, reliable boolean")


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    found = predict_language(docs.select("doc_id", "text"), learned(docs))
    return found.select("doc_id", F.expr("coalesce(crc32(cast(doc_id AS string)) % 3 = 1, false)").alias("held_out"), "lang_pred", "score", "reliable")
