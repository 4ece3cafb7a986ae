import random

import pytest

from greensward.llm import common as C
from greensward.llm import set_join as S
from greensward.llm.queries import QUERIES, SQL

from ..oracle import connect, same
from .brute import jaccard_components

SF = "/root/testdata/sf0.001"


def run(spark, texts, **more):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    got = S.similar_sets(df, **more).collect()
    return {r.doc_id: r.n_shingles for r in got}, {r.doc_id: r.component_id for r in got}


def families(seed, n, words=60, edits=4, vocabulary=400):
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(vocabulary)}" for _ in range(words + rng.randrange(40))] for _ in range(4)]
    out = {}
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(50)}"
        out[i] = " ".join(w)
    return out


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 3, 90), (2, 5, 80), (3, 3, 90)])
def test_families_equal_brute_force(spark, seed, size, percent):
    texts = families(seed, 120)
    want = jaccard_components(texts, size, percent)
    assert run(spark, texts, size=size, percent=percent, frequent_from=10) == want
    assert len(set(want[1].values())) > 4  # the case isn't trivial


def test_long_lists_go_through_heads_and_rest(spark):
    texts = families(11, 100, words=80, edits=8)
    assert run(spark, texts, frequent_from=10, heads=2) == jaccard_components(texts, 3, 90)


def test_rows_without_an_id_bridge(spark):
    words = [f"q{i}" for i in range(100)]
    edit = lambda *at: " ".join(f"e{i}" if i in at else w for i, w in enumerate(words))
    rows = [(1, edit(0, 99)), (None, edit(0)), (2, edit(0, 1, 2, 3)), (None, edit(0, 1, 2, 3, 4, 5)), (3, edit(50)), (None, "x y z")]
    plain = jaccard_components(dict(enumerate(t for _, t in rows)), 3, 90)[1]
    ids = [i for i, _ in rows]
    want = sorted((i is None, i or 0, min((j for k, j in enumerate(ids) if plain[k] == plain[n] and j is not None), default=0)) for n, i in enumerate(ids))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.component_id or 0) for r in S.similar_sets(df).collect())
    assert got == want and plain[0] == plain[2]


def test_shared_passage_links_nothing(spark):
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = {i: " ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) + " " + passage for i in range(60)}
    assert run(spark, texts, frequent_from=5) == jaccard_components(texts, 3, 90)


def test_edges(spark):
    long_text = " ".join(f"q{i % 5000}" for i in range(60_000))
    texts = {0: None, 1: "", 2: " \t\n ", 3: "one", 4: "ONE", 5: "one two", 6: "One\x0btwo", 7: "a b c", 8: "a b c a b c a b c", 9: long_text, 10: long_text + " tail", 11: "Été x y", 12: "été x y", 13: "a b c d"}
    n, parts = run(spark, texts)
    assert (n, parts) == jaccard_components(texts, 3, 90)
    assert n[0] == n[1] == n[2] == 0 and parts[4] == 3 and parts[6] == 5 and parts[10] == 9 and parts[12] == 12


def test_empty_table_repeats_nulls_and_clashing_columns(spark):
    schema = "doc_id long, text string, n long, component_id string, sig int, TEXT2 string"
    assert S.similar_sets(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "a b c d", 0, "z", 1, None), (1, "a b c d", 0, "z", 1, None), (2, "a b c d", 0, "z", 1, None), (None, "a b c d", 0, "z", 1, None), (None, "k l m", 0, "z", 1, None)]
    df = spark.createDataFrame(rows, schema)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in S.similar_sets(df).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, 1), (None, 1, None)], key=str)
    left = S.one_of_each_group(df)
    assert left.columns == ["doc_id", "text", "n", "component_id", "sig", "TEXT2"]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=str) == [(1, "a b c d"), (None, "a b c d"), (None, "k l m")]


def test_one_of_each_group_keeps_the_smallest(spark):
    texts = families(7, 80)
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, source string")
    parts = jaccard_components(texts, 5, 80)[1]
    assert sorted(r.doc_id for r in S.one_of_each_group(df).collect()) == sorted(set(parts.values()))


def test_query_equals_sql(spark):
    same(QUERIES["op3_jaccard"](spark, SF), connect(SF), SQL["op3_jaccard"])


def test_parity_bits_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(20):
        a = np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64))
        b = np.unique(np.concatenate((a[rng.random(len(a)) < 0.9], rng.integers(0, 2**63, 20, dtype=np.uint64))))
        apart = np.bitwise_count((S.parity_bits(a) ^ S.parity_bits(b)).view(np.uint64)).sum()
        assert apart <= len(np.setxor1d(a, b))


def test_prefix_length():
    assert [S.prefix_length(n, 90) for n in (1, 9, 10, 11, 100)] == [1, 1, 2, 2, 11]


def test_long_chains_settle_in_few_rounds(spark, monkeypatch):
    order = list(range(400))
    random.Random(5).shuffle(order)
    links = [*zip(order, order[1:]), (1000, 1001), (1002, 1001), (7, 7), (None, 3), (4, None)]
    taken, staged = [], C.staged
    monkeypatch.setattr(C, "staged", lambda df, name: (taken.append(name), staged(df, name))[1])
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(400), 0), 1000: 1000, 1001: 1000, 1002: 1000}
    assert taken.count("hooked") <= 12
