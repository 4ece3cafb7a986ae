"""Token counts by rank-synchronous merging of batched pre-tokens (byte-level BPE).

A batch's distinct pre-tokens lie behind one another in one integer array (ragged rows by offsets). In each
round every row finds the lowest rank among its adjacent pairs and merges all places of that pair at once;
rows without a mergeable pair leave with the number of symbols that survive. No shuffle is involved: documents
are scored where they are read, and each Python worker keeps a bounded memo of pre-tokens it has counted.

Defined results: null and empty texts count 0 bytes and 0 tokens; a repeated doc_id gives a row each.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, table, text_runs

WHITE = r"\t-\r \x85\xa0  -     　"
#: The split of GPT-2 style byte-level vocabularies, with white space as Unicode's White_Space property.
SPLIT = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
NO_RANK = np.iinfo(np.int64).max
LONG = 4096


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in set(plain)):
        letters[chr(256 + i)] = b
    return letters


class RankMerger:
    """Counts the symbols that byte-pair merging leaves of each byte string."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError(f"{path}: SPLIT holds for byte-level vocabularies without a normaliser or pattern of their own")
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.first = np.zeros(256, np.int64)
        for letter, byte in byte_letters().items():
            self.first[byte] = vocab[letter]
        self.width = 1 + max(vocab.values())
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        key = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        self.split = regex.compile(SPLIT)
        self.apart = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo = Memo()

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        hit = self.key[at] == key
        return np.where(hit, self.rank[at], NO_RANK), self.made[at]

    def count_batch(self, words: list[bytes]) -> np.ndarray:
        """Symbols left of each byte string, all rows in step."""
        out = np.zeros(len(words), np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(sizes > LONG):
            out[i] = self._count_long(words[i])
        rows = np.flatnonzero((sizes > 0) & (sizes <= LONG))
        if not len(rows):
            return out
        symbols = self.first[np.frombuffer(b"".join([words[i] for i in rows]), np.uint8)]
        lengths = sizes[rows]
        while len(rows):
            row_of = np.repeat(np.arange(len(rows)), lengths)
            starts = np.cumsum(lengths) - lengths
            rank = np.full(len(symbols), NO_RANK)
            made = np.zeros(len(symbols), np.int64)
            inside = np.flatnonzero(row_of[:-1] == row_of[1:])
            rank[inside], made[inside] = self._look_up(symbols[inside], symbols[inside + 1])
            least = np.minimum.reduceat(rank, starts)
            going = least != NO_RANK
            out[rows[~going]] = lengths[~going]
            take = (rank == least[row_of]) & (rank != NO_RANK)
            at = np.flatnonzero(take)
            if len(at) > 1:  # of places that overlap (a run of one letter) every second stays
                run = np.concatenate(([0], np.cumsum(np.diff(at) != 1)))
                head = np.concatenate(([0], np.flatnonzero(np.diff(run)) + 1))
                at = at[(np.arange(len(at)) - head[run]) % 2 == 0]
            symbols[at] = made[at]
            keep = going[row_of]
            keep[at + 1] = False
            lengths = (lengths - np.bincount(row_of[at], minlength=len(rows)))[going]
            symbols, rows = symbols[keep], rows[going]
        return out

    def _count_long(self, word: bytes) -> int:
        """The same for one very long pre-token, in n log n: a heap of (rank, place) over a linked list."""
        symbol = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, made = self._look_up(np.array(symbol[:-1]), np.array(symbol[1:]))
        heap = [(int(r), i, symbol[i], symbol[i + 1], int(m)) for i, (r, m) in enumerate(zip(rank, made)) if r != NO_RANK]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def push(i: int) -> None:
            j = after[i]
            if j < n:
                pair = (symbol[i], symbol[j])
                if pair not in known:
                    r, m = self._look_up(np.array([pair[0]]), np.array([pair[1]]))
                    known[pair] = int(r[0]), int(m[0])
                r, m = known[pair]
                if r != NO_RANK:
                    heapq.heappush(heap, (r, i, *pair, m))

        left = n
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = m, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            left -= 1
            push(i)
            if before[i] >= 0:
                push(before[i])
        return left

    def count_texts(self, texts: list[str]) -> list[int]:
        """Tokens of each text; strings of special tokens inside a text count one each, as the library's default has it."""
        pieces: list[list[str]] = []
        extra = []
        for text in texts:
            if self.apart and any(s in text for s in self.special):
                parts = self.apart.split(text)
                extra.append(len(parts) // 2)
                pieces.append([w for part in parts[::2] for w in self.split.findall(part)])
            else:
                extra.append(0)
                pieces.append(self.split.findall(text))
        self.memo.take_turn()
        new = [w for w in set().union(*pieces) if w not in self.memo]
        if new:
            self.memo.update(zip(new, self.count_batch([w.encode() for w in new]).tolist()))
        get = self.memo.__getitem__
        return [e + sum(map(get, words)) for e, words in zip(extra, pieces)]


_mergers: dict[str, RankMerger] = {}


def merger(path: str) -> RankMerger:
    if path not in _mergers:
        _mergers[path] = RankMerger(path)
    return _mergers[path]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; other columns are not read."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = merger(path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.string()), "")
            n = [x for run in text_runs(texts) for x in m.count_texts(run)]
            tokens = pa.array(n, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
