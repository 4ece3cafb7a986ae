"""Sum-of-squares packing of tokenised documents into sequences of a fixed length.

Documents are tokenised where they are read; only (piece, length, checksum) rows are shuffled. They are dealt
evenly, by row number and not by any key, to groups whose number follows the number of documents, and each group
packs its pieces, longest first: a piece goes to the open gap, or to a new sequence, for which the sum over gaps
of the squared number of open sequences becomes smallest. A group holds some `group_rows` documents, so no task
grows with the input, and what a group wastes is about one unfilled sequence.

Defined results: null and empty texts are packed as their end token alone; repeated rows are packed each; ties
between gaps go to the smallest gap; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Memo, table, text_runs

#: The split of the vocabulary word_bpe_49k.json within a chunk without white space.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


#: Texts that the library encodes whole: control characters, letters beyond Latin, and the one below whose lower case is two characters.
OTHER = r"[\x00-\x08\x0e-\x1f\x{0130}\x{0250}-\x{10ffff}]"


class ChunkEncoder:
    """Token ids, as packed little-endian uint32, of whole texts by a vocabulary whose pre-tokens never hold white space and whose words end
    in tokens that no word has elsewhere.

    For texts of Latin letters below U+0250 the normaliser is plain lower-casing and white space only separates, so
    the ids of a text are those of its chunks between white space, and those of a chunk are those of its words, which
    are remembered. New words are encoded many at a time, joined by spaces, and told apart by the tokens that end words.
    All other texts, and those that may hold strings of special tokens, go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.path = path
        self.single = Tokenizer.from_file(path)  # for words that are normalised and split already
        self.single.normalizer = None
        self.single.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.marks = [t.content for t in self.single.get_added_tokens_decoder().values()]
        suffix, names = self.single.model.end_of_word_suffix, self.single.get_vocab()
        self.ends = np.zeros(max(names.values()) + 1, bool)
        self.ends[[i for name, i in names.items() if name.endswith(suffix)]] = True
        self.split = regex.compile(WORD)
        self.chunks = Memo(400_000)

    @cached_property
    def library(self):
        """The vocabulary as it is; loaded only where a text needs it."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.no_truncation()
        whole.no_padding()
        return whole

    def _by_library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(words), 4000):  # the library's results are large
            part = words[k : k + 4000]
            made = self.single.encode_batch_fast([" ".join(part[i : i + 400]) for i in range(0, len(part), 400)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, "<u4") for e in made])
            stop = (np.flatnonzero(self.ends[ids]) + 1) * 4
            if len(stop) != len(part):
                raise ValueError(f"{self.path}: words don't end in tokens of their own")
            raw = ids.tobytes()
            out += [raw[i:j] for i, j in zip([0, *stop[:-1].tolist()], stop.tolist())]
        return out

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        known = self.chunks
        known.take_turn()
        ids = list(map(known.get, chunks))
        words, compound = [], {}
        for i, found in enumerate(ids):
            if found is None:
                c = chunks[i]
                if c in known.old:
                    ids[i] = known[c]
                elif c.isalpha():
                    words.append(c)
                else:
                    compound[c] = self.split.findall(c)
        parts = {w for found in compound.values() for w in found if known.get(w) is None and w not in known.old}
        words += parts.difference(words)
        known.update(zip(words, self._encoded(words)))
        for c, found in compound.items():
            known[c] = b"".join([known[w] for w in found])
        return [known[c] if x is None else x for c, x in zip(chunks, ids)]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = pa.array(texts, pa.large_string())
        plain = pc.invert(pc.match_substring_regex(whole, OTHER)).to_numpy(zero_copy_only=False)
        plain &= np.array([not any(m in t for m in self.marks) for t in texts], bool)
        lower = pc.if_else(pa.array(plain), pc.utf8_lower(whole), "")
        # A mark after a letter and before white space is a word of its own anyway; apart from the letters there are fewer different chunks.
        parted = pc.utf8_split_whitespace(pc.replace_substring_regex(lower, r"(\pL)([.,;:!?])(\s|\z)", r"\1 \2\3"))
        coded = parted.values.dictionary_encode()
        at = coded.indices.to_numpy()
        ids = self._ids_of(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start = np.cumsum(size) - size
        flat, sizes = np.frombuffer(b"".join(ids), "<u4"), size[at]
        ends = np.cumsum(sizes)
        all_ids = flat[np.repeat(start[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate(([0], ends))[parted.offsets.to_numpy()]
        out = [all_ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
        rest = np.flatnonzero(~plain).tolist()
        for i, own in zip(rest, self._by_library([texts[i] for i in rest]) if rest else []):
            out[i] = own
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class SumOfSquares:
    """Bins of one capacity; place(size) gives (bin, offset)."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)  # open bins by gap
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.bins = 0

    def place(self, size: int) -> tuple[int, int]:
        """The rise of the sum of squares is 2 (count of the new gap - count of the old gap) + 2, without the terms of
        gaps that aren't open: a new bin has no old gap, a bin that gets full has no new one."""
        c, cap = self.count, self.capacity
        if size == cap:
            self.bins += 1
            return self.bins - 1, 0
        gaps = np.flatnonzero(c[size:]) + size
        best, rise = cap, 2 * int(c[cap - size]) + 1
        if len(gaps):
            rises = 2 * (c[gaps - size] - c[gaps]) + 2
            if gaps[0] == size:
                rises[0] = 1 - 2 * c[size]
            i = int(np.argmin(rises))
            if rises[i] < rise:
                best, rise = int(gaps[i]), int(rises[i])
        if best == cap:
            at, self.bins = (self.bins, 0), self.bins + 1
        else:
            at = self.open[best].pop()
            c[best] -= 1
        left = best - size
        if left:
            self.open[left].append((at[0], at[1] + size))
            c[left] += 1
        return at


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size, placed longest first."""
    bins, packer = np.zeros((2, len(sizes)), np.int64), SumOfSquares(capacity)
    for i in np.argsort(-sizes, kind="stable"):
        bins[:, i] = packer.place(int(sizes[i]))
    return bins[0], bins[1]


def pieces(docs: DataFrame, id_col: str, text_col: str, path: str, capacity: int, end_id: int) -> DataFrame:
    """The cut documents: (doc_id, piece, start, length, ids_crc32)."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            rows, n = [], 0
            for run in text_runs(batch.column(1), 8_000_000):
                for ids in enc.encode(run):
                    ids = memoryview(ids + end)
                    rows += [(n, k, s // 4, len(part := ids[s : s + 4 * capacity]) // 4, zlib.crc32(part)) for k, s in enumerate(range(0, len(ids), 4 * capacity))]
                    n += 1
            at, k, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(k.astype(np.int32)), *map(pa.array, (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, capacity: int = 4096, end_id: int = 1, group_rows: int = 3000
) -> DataFrame:
    """Each piece of each document with its sequence_id and offset."""
    path = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    groups = max(1, -(-docs.count() // group_rows))
    cut = pieces(docs, id_col, text_col, path, capacity, end_id)
    dealt = cut.withColumn("grp", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        bins, offset = pack(frame["length"].to_numpy(), capacity)
        return frame.assign(sequence_id=frame["grp"].to_numpy() * 2**32 + bins, offset=offset).drop(columns="grp")

    kind = docs.schema[id_col].dataType.simpleString()
    return dealt.groupBy("grp").applyInPandas(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
