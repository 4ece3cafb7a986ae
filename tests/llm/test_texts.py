"""Token counts, packing, quality and decontamination."""

import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from greensward.llm import decontaminate as D
from greensward.llm import packing as K
from greensward.llm import quality as Q
from greensward.llm import token_counts as T
from greensward.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ODD = [None, "", "a<|endoftext|>b <|endoftext|>", "aaaaaaa " * 3, " \n\n  x\t y", "日本語 123٣ ²", "x" * 9000 + "ab" * 3000, "\x1c\x1d a\x85b c", "don't we'll 'sx ''s",
       "ΟΔΟΣ İI ǅ é", "<|startoftext|>z", "word " * 30_000]


def frame(spark, texts, more="lang string, n_tokens string, offset int"):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in enumerate(texts)], f"doc_id long, text string, {more}").repartition(3)


def library(name, texts):
    return [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(spark):
    got = {r.doc_id: r for r in T.token_counts(frame(spark, ODD)).collect()}
    for i, ids in enumerate(library("byte_bpe_50k.json", ODD)):
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (len(ids), len((ODD[i] or "").encode()), len(ids) > 1024)
    assert T.token_counts(frame(spark, ODD).limit(0)).count() == 0


def test_count_query_equals_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = dict(zip([r.doc_id for r in docs], map(len, library("byte_bpe_50k.json", [r.text for r in docs]))))
    assert {r.doc_id: r.n_tokens for r in QUERIES["op1_token_counts"](spark, SF).collect()} == want


def test_long_words_by_heap_equal_the_arrays():
    m = T.merger(P.path("byte_bpe_50k.json"))
    rng = np.random.default_rng(1)
    for n in (2, 50, 900):
        word = bytes(rng.choice(np.frombuffer(b"abcdeth ", np.uint8), n))
        assert m._count_long(word) == m.count_batch([word])[0]


def check_packing(rows, texts, capacity=4096):
    ids = dict(enumerate([*x, 1] for x in library("word_bpe_49k.json", texts)))
    pieces = {}
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.length == len(part) and r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
        pieces.setdefault(r.doc_id, []).append(r)
    for i, want in ids.items():
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(want)
        assert all(r.length == capacity for r in own[:-1]) and [r.start for r in own] == [capacity * k for k in range(len(own))]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


def test_packing_is_whole_and_gapless(spark):
    check_packing(K.pack_documents(frame(spark, ODD)).collect(), ODD)
    assert K.pack_documents(frame(spark, ODD).limit(0)).count() == 0


def test_packing_query_is_tight(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    assert [r.doc_id for r in docs] == list(range(len(docs)))
    n, tokens = check_packing(QUERIES["op4_pack"](spark, SF).collect(), [r.text for r in docs])
    assert n <= -(-tokens // 4096) + 1


def test_sum_of_squares_takes_the_place_with_the_smallest_sum():
    rng, cap = np.random.default_rng(2), 20
    packer, levels = K.SumOfSquares(cap), {}
    for size in rng.integers(1, cap + 1, 300).tolist():
        before = dict(levels)

        def total(bin_, before=before, size=size):
            gaps = [cap - v for b, v in before.items() if b != bin_] + [cap - before.get(bin_, 0) - size]
            return sum(n * n for g, n in zip(*np.unique(gaps, return_counts=True)) if g)

        best = min(total(b) for b in [b for b, v in before.items() if v + size <= cap] + [len(before)])
        b, at = packer.place(size)
        assert at == before.get(b, 0) and total(b) == best
        levels[b] = at + size


def test_quality_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    test = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == q for p, q in test) / len(test) > 0.95


def test_quality_edges(spark):
    docs = frame(spark, ODD, "score string, predicted string, y int")
    labels = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int")
    w, b = Q.train(docs, labels)
    assert b == 0 and not w.any()
    out = Q.score_texts(docs, w, b)
    assert out.columns == ["doc_id", "text", "y", "score", "predicted"] and {r.score for r in out.collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    one, two = Q.train(docs, some, held_out=False), Q.train(docs.repartition(5), some, held_out=False)
    assert (one[0] == two[0]).all() and one[1] == two[1]


def brute_tiles(a, b, least):
    fa, fb, out = [True] * len(a), [True] * len(b), []
    while True:
        best, found = least - 1, []
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and fa[i + n] and fb[j + n] and a[i + n] == b[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j, n)]
        if not found:
            return out
        i, j, n = found[0]
        fa[i : i + n], fb[j : j + n] = [False] * n, [False] * n
        out.append((i, j, n))


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(4)
    for _ in range(150):
        a, b = (rng.integers(1, 4, rng.integers(0, 40)).astype(np.uint64) for _ in range(2))
        assert sorted(D.tiles(a, b, 3, 8)) == sorted(brute_tiles(a.tolist(), b.tolist(), 3))


def test_contamination(spark):
    item = " ".join(f"b{i}" for i in range(20))
    w = item.split()
    reordered = " ".join(w[10:] + ["zzz"] + w[:10])
    texts = ["clean words here " * 50, f"x y {item.upper()} z", reordered, " ".join(w[:8]), None, "", item, "short one"]
    docs = frame(spark, texts, "coverage string, item_id string, ITEM_TEXT int")
    bench = spark.createDataFrame([(7, item), (8, None), (9, ""), (3, item), (4, "short one"), (None, "clean words here")], "item_id long, text string")
    for block in (20_000, 1):
        got = {r.doc_id: r for r in D.contamination(docs, bench, block_items=block).collect()}
        assert [got[i].contaminated for i in range(8)] == [False, True, True, False, False, False, True, True]
        assert got[1].item_id == 3 and got[2].n_tiles == 2 and got[7].item_id == 4
    assert D.contamination(docs.limit(0), bench).count() == 0
    assert D.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_query_equals_substring_search(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet").collect(), [D.Words()(r.text).tobytes() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = {r.doc_id: r.contaminated for r in QUERIES["op7_decontaminate"](spark, SF).collect()}
    holds = {r.doc_id for r in docs if any(b in D.Words()(r.text).tobytes() for b in bench)}
    assert holds and holds <= {i for i, c in got.items() if c}
    assert sum(got.values()) <= len(holds) + 2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13])
def test_windows_tell_equal_runs(n):
    a = np.random.default_rng(1).integers(0, 3, 60).astype(np.uint64)
    h = D.windows(a, n)
    for i in range(len(h)):
        for j in range(len(h)):
            assert (h[i] == h[j]) == (a[i : i + n] == a[j : j + n]).all()


def test_items_of_one_id_are_all_read(spark):
    parts = [" ".join(f"{c}{i}" for i in range(9)) for c in "abcde"]
    docs = frame(spark, [f"x {p} y" for p in parts] + ["clean words of no item at all"])
    bench = spark.createDataFrame([(1, p) for p in parts[:4]] + [(1, parts[0])] * 3 + [(2, parts[4])], "item_id long, text string")
    for block in (1, 2, 3):
        got = {r.doc_id: (r.contaminated, r.item_id) for r in D.contamination(docs, bench, block_items=block).collect()}
        assert got == {**dict.fromkeys(range(4), (True, 1)), 4: (True, 2), 5: (False, None)}


def test_blocks_are_bounded_in_bytes(spark):
    items = spark.createDataFrame([(i, f"item {i} has words of its own like w{i} and v{i}") for i in range(7)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"before item {i} has words of its own like w{i} and v{i} after") for i in range(8)], "doc_id long, text string")
    for most in (1, 100, 10**6):
        got = {r.doc_id: (r.contaminated, r.item_id) for r in D.contamination(docs, items, block_bytes=most).collect()}
        assert {i: got[i] for i in range(7)} == {i: (True, i) for i in range(7)} and not (got[7][0] and got[7][1] == 7)
