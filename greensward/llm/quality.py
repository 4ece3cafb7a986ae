"""Hashed n-gram logistic regression, trained with follow-the-regularised-leader updates.

A text is read as a stream of words. Each word gives three letters: its lower-case form, its shape (case, digits,
marks, length) and whether it, or the three words that end with it, stood in the text before. The 1- and 2-grams of
forms and the 1- to 3-grams of shapes with repetition are hashed into one weight vector; a text's feature is its share of all
n-grams of that kind, so a score is a sparse dot product that doesn't depend on the length.

Training reads at most `max_rows` labelled rows (those with the smallest hash of the id), hashed on the executors, and
runs FTRL-proximal on the driver over several passes in a seeded order. Scoring reads every whole text where it lies.

Defined results: null and empty texts have only the bias; rows without a label or with a null one aren't learned
from; repeated ids give a row each; no labels at all give a score of 0.5 for every row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, table, text_runs, with_columns_renamed_apart

BITS = 18
KINDS = 5
M1, M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    x = (a ^ (b + M1 + (a << np.uint64(6)))) * M2
    return x ^ (x >> np.uint64(29))


def shape(word: str) -> str:
    core = word.strip(".,;:!?\"'()")
    case = "0" if not core else "U" if core.isupper() and len(core) > 1 else "T" if core[0].isupper() else "l" if core.isalpha() else "x"
    marks = re.sub(r"[\w\s]", "", word)[:3]
    return f"{case}{'9' if any(c.isdigit() for c in word) else ''}{min(len(core), 20) // 3}{marks}"


class Hasher:
    """Texts to hashed n-grams: for each text its places in the weight vector and their values."""

    def __init__(self) -> None:
        self.memo = Memo()

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.memo.take_turn()
        for w in set(words):
            if w not in self.memo:
                self.memo[w] = (xxhash.xxh3_64_intdigest(w.lower().strip(".,;:!?\"'()")), xxhash.xxh3_64_intdigest(shape(w)))
        both = np.array([self.memo[w] for w in words], np.uint64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        form, kind = self._letters(words)
        n = len(words)
        two = mix(form[:-1], form[1:])
        three = mix(two[:-1], form[2:])
        again = np.zeros(n, np.uint64)
        again[1:] += (form[1:] == form[:-1]).astype(np.uint64)
        if n > 2:
            seen = np.ones(n - 2, bool)
            seen[np.unique(three, return_index=True)[1]] = False
            again[2:] += np.uint64(2) * seen.astype(np.uint64)
        kind = mix(kind, again)
        kind2 = mix(kind[:-1], kind[1:])
        grams = [form, two, kind, kind2, mix(kind2[:-1], kind[2:])]
        at = np.concatenate([((mix(g, np.uint64(i + 1)) >> np.uint64(64 - BITS)).astype(np.int64)) for i, g in enumerate(grams)])
        value = np.concatenate([np.full(len(g), 1 / max(1, len(g))) for g in grams])
        return at, value


def merged(at: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, back = np.unique(at, return_inverse=True)
    return at, np.bincount(back, value, len(at))


def ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, passes: int = 6, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.001, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias after FTRL-proximal passes over sparse rows."""
    size = 1 << BITS
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    rng = np.random.default_rng(seed)
    for _ in range(passes if len(rows) else 0):
        for r in rng.permutation(len(rows)):
            at, value = rows[r]
            at, value = np.append(at, size), np.append(value, 1.0)
            zi, ni = z[at], n[at]
            wi = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            p = 1 / (1 + np.exp(-np.clip(wi @ value, -35, 35)))
            g = (p - labels[r]) * value
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] += g - sigma * wi
            n[at] += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:-1], float(w[-1])


_hasher = Hasher()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4000, held_out: bool = True) -> tuple[np.ndarray, float]:
    """Weights from labelled rows; with held_out only from those whose crc32 of the id as text isn't 1 modulo 3."""
    known = labels.select(id_col, F.col(label_col).cast("double").alias("y")).where(f"{id_col} IS NOT NULL AND y IN (0, 1)")
    if held_out:
        known = known.where(F.expr(f"crc32(cast({id_col} AS string)) % 3 <> 1"))
    known = known.groupBy(id_col).agg(F.max("y").alias("y")).orderBy(F.xxhash64(id_col), id_col).limit(max_rows)
    sample = docs.select(id_col, text_col).join(F.broadcast(known), id_col)  # at most max_rows rows

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [merged(*_hasher.features(t)) for run in text_runs(batch.column(1)) for t in run]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([a.astype("<u4").tobytes() for a, _ in rows], pa.binary()), pa.array([v.astype("<f4").tobytes() for _, v in rows], pa.binary())], ["id", "y", "at", "value"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = sample.mapInArrow(hashed, f"id {kind}, y double, at binary, value binary").dropDuplicates(["id"]).toArrow().sort_by("id")
    rows = [(np.frombuffer(a.as_buffer(), "<u4"), np.frombuffer(v.as_buffer(), "<f4")) for a, v in zip(got["at"], got["value"])]  # views: the table is held once
    return ftrl(rows, got["y"].to_numpy())


def score_texts(docs: DataFrame, weights: np.ndarray, bias: float, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 on); columns of these names are replaced."""
    docs = with_columns_renamed_apart(docs, ["score", "predicted"])
    places = np.flatnonzero(weights)
    sparse = docs.sparkSession.sparkContext.broadcast((places, weights[places]))  # at most 2 ** BITS numbers
    t = docs.columns.index(text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << BITS)
        w[sparse.value[0]] = sparse.value[1]
        for batch in batches:
            s = np.array([bias + w[at] @ value for run in text_runs(batch.column(t)) for at, value in map(_hasher.features, run)], float)
            p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(score, f"{schema}, score double, predicted int")


def is_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    weights, bias = train(docs, table(spark, sf_dir, "labels"))
    return score_texts(docs, weights, bias).select("doc_id", F.expr("coalesce(crc32(cast(doc_id AS string)) % 3 = 1, false)").alias("held_out"), "score", "predicted")
