"""Benchmark passages in documents, by greedy string tiling with running Karp-Rabin matching.

Words are lower-cased (A-Z) runs without white space. Seeds are `least` consecutive words that a benchmark item and a document share.
Items are taken in blocks of bounded size; the sorted seed hashes of a block go to every task, so documents
are read where they lie and nothing is shuffled, however often a passage occurs. For each item that shares seeds with a document, tiles
are marked greedily: the longest match of words unmarked on both sides first, found by Karp-Rabin hashes of a
search length that starts long and falls to `least`. A document is contaminated by an item where tiles cover at least
`threshold` of its words, in whatever order they stand.

Items with fewer than `least` words have one seed, the whole item. Defined results: null and empty documents have no words and stay clean; null or
empty items match nothing; of items with equal coverage the smallest id is named; repeated rows are judged each.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Memo, table, text_runs, with_columns_renamed_apart

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


class Words:
    """Texts to arrays of 64-bit word hashes, remembering words."""

    def __init__(self) -> None:
        self.known = Memo(250_000)

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: only A-Z, and ASCII white space
        known = self.known
        known.take_turn()
        try:
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w)
            return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hash (modulo 2**64) of each n consecutive words, by doubling: that of 2 k words from two of k."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out, have, h, power, k, left = None, 0, words, BASE, 1, n
        while left:
            if left & 1:
                size = len(words) - have - k + 1
                part = h[have : have + size]
                out = part if out is None else out[:size] * power + part
                have += k
            left >>= 1
            if left:
                h = h[: len(h) - k] * power + h[k:]
                power, k = power * power, 2 * k
        return out ^ (out >> np.uint64(31))


def tiles(a: np.ndarray, b: np.ndarray, least: int, search: int = 32) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word arrays: (start in a, start in b, length), no word in two tiles, none shorter than least."""
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    found: list[tuple[int, int, int]] = []
    s = max(least, min(search, len(a), len(b)))
    while True:
        longest, matches = _scan(a, b, free_a, free_b, s)
        if longest > 2 * s:
            s = longest
            continue
        heap = [(-n, i, j) for i, j, n in matches]
        heapq.heapify(heap)
        while heap:
            n, i, j = heapq.heappop(heap)
            free = free_a[i : i - n] & free_b[j : j - n]
            if free.all():
                free_a[i : i - n] = free_b[j : j - n] = False
                found.append((i, j, -n))
            else:  # what longer tiles have left of it
                edges = np.flatnonzero(np.diff(np.concatenate(([0], free.astype(int), [0]))))
                for p, q in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    if q - p >= s:
                        heapq.heappush(heap, (p - q, i + p, j + p))
        if s == least:
            return found
        s = max(least, s // 2)


def _scan(a: np.ndarray, b: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, s: int) -> tuple[int, list[tuple[int, int, int]]]:
    """Maximal matches of at least s unmarked words; the longest, and all. Stops at a match over 2 s long."""
    longest, matches = 0, []
    if len(a) < s or len(b) < s:
        return longest, matches
    run_a, run_b = (np.convolve(f, np.ones(s, int), "valid") == s for f in (free_a, free_b))
    place: dict[int, list[int]] = defaultdict(list)
    hash_a, hash_b = windows(a, s), windows(b, s)
    for i in np.flatnonzero(run_a).tolist():
        place[int(hash_a[i])].append(i)
    for j in np.flatnonzero(run_b & np.isin(hash_b, np.fromiter(place, np.uint64, len(place)))):
        for i in place[int(hash_b[j])]:
            if i and j and free_a[i - 1] and free_b[j - 1] and a[i - 1] == b[j - 1]:
                continue  # part of a match that begins earlier
            if not (a[i : i + s] == b[j : j + s]).all():
                continue
            n = s
            while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                n += 1
            if n > longest:
                longest = n
                if n > 2 * s:
                    return longest, matches
            matches.append((i, int(j), n))
    return longest, matches


class Block:
    """A block of benchmark items with its seeds."""

    def __init__(self, ids: list[int], texts: list[str | None], least: int):
        to_words = Words()
        self.ids, self.least = ids, least
        self.items = [to_words(t) for t in texts]
        seeds: dict[int, set[int]] = defaultdict(set)
        self.short = {len(w) for w in self.items if 0 < len(w) < least}
        for k, w in enumerate(self.items):
            for h in windows(w, min(least, len(w))).tolist() if len(w) else []:
                seeds[h].add(k)
        self.seeds = dict(seeds)
        self.sorted = np.sort(np.fromiter(self.seeds, np.uint64, len(self.seeds)))

    def best(self, words: np.ndarray) -> tuple[float, int | None, int]:
        """(coverage, item id, tiles) of the item that the words cover most."""
        hits: dict[int, list[int]] = defaultdict(list)
        for n in {self.least, *self.short}:
            h = windows(words, n)
            if len(h) and len(self.sorted):
                at = np.minimum(np.searchsorted(self.sorted, h), len(self.sorted) - 1)
                for j in np.flatnonzero(self.sorted[at] == h):
                    for k in self.seeds[int(h[j])]:
                        hits[k].append(int(j))
        found = (0.0, None, 0)
        for k, places in hits.items():
            item = self.items[k]
            least = min(self.least, len(item))
            near = np.zeros(len(words) + 1, int)  # a match lies within the words of its seeds: only those are tiled
            np.add.at(near, np.array(places), 1)
            np.add.at(near, np.minimum(np.array(places) + least, len(words)), -1)
            inside = np.cumsum(near)[:-1] > 0
            kept = np.flatnonzero(inside)
            gap = np.concatenate(([0], np.cumsum(np.diff(kept) > 1)))
            part = np.zeros(len(kept) + gap[-1], np.uint64)  # a zero between parts: no word of an item is zero
            part[np.arange(len(kept)) + gap] = words[kept]
            t = tiles(item, part, least)
            coverage = sum(n for _, _, n in t) / len(item)
            if found[1] is None or (coverage, -self.ids[k]) > (found[0], -found[1]):
                found = (coverage, self.ids[k], len(t))
        return found


words_of = Words()


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 4, threshold: float = 0.6,
    block_items: int = 20_000, block_bytes: int = 64_000_000,
) -> DataFrame:
    """docs with contaminated, coverage, item_id (of the item covered most) and n_tiles; columns of these names are replaced.

    The benchmark is read in blocks of at most block_items distinct items and, but for the first of a block, block_bytes of text, ordered by id
    and text; each block is a pass over the documents' words.
    """
    added = ["contaminated", "coverage", "item_id", "n_tiles"]
    docs = with_columns_renamed_apart(docs, added)
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    names, t = docs.columns, docs.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", contaminated boolean, coverage double, item_id long, n_tiles int"

    out, last = None, None
    while True:
        after = items if last is None else items.where((F.col("i") > last.i) | ((F.col("i") == last.i) & (F.col("t") > last.t)))
        next_ = after.orderBy("i", "t").limit(block_items)
        so_far = Window.orderBy("i", "t").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sized = next_.withColumn("bytes", F.sum(F.octet_length("t")).over(so_far)).withColumn("place", F.row_number().over(Window.orderBy("i", "t")))
        found = sized.withColumn("n", F.count("*").over(Window.partitionBy())).where(f"bytes <= {block_bytes} OR place = 1")
        rows = sorted(found.collect(), key=lambda r: (r.i, r.t))  # a bounded block
        if out is not None and not rows:
            return out
        shared = docs.sparkSession.sparkContext.broadcast(Block([r.i for r in rows], [r.t for r in rows], least))
        first = out is None

        def judge(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best = [shared.value.best(words_of(x)) for run in text_runs(batch.column(t)) for x in run]
                if not first:
                    before = [(c or 0.0, i, n or 0) for c, i, n in zip(*(batch.column(len(names) + k).to_pylist() for k in (1, 2, 3)))]
                    best = [b if n[1] is None or n[0] <= b[0] else n for n, b in zip(best, before)]
                judged = [pa.array([b[0] >= threshold for b in best], pa.bool_()), *(pa.array([b[k] for b in best], kind) for k, kind in enumerate((pa.float64(), pa.int64(), pa.int32())))]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *judged], [*names, *added])

        out = (docs if first else out).mapInArrow(judge, schema)
        last = rows[-1] if rows else None
        if not rows or len(rows) == rows[0].n < block_items:
            return out


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark")).drop("text")
