import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from greensward.llm import divergence as D
from greensward.llm import language_id as L
from greensward.llm import variants as V
from greensward.llm.queries import QUERIES, SQL

from ..oracle import connect, same
from .brute import divergences, misspelled_counts, near

SF, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["op11_divergence", "op12_variants"])
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, MORE), connect(MORE), SQL[name])


# 11: divergence of sources

SCHEMA = "doc_id long, Term string, text string, lang string, rank int, source string"


def frame(spark, rows):
    return spark.createDataFrame([(i, "x", t, lang, 1, source) for i, (lang, source, t) in enumerate(rows)], SCHEMA)


def found(df):
    return sorted((r.lang, r.source, r.part, r.item, r.value, r.rank) for r in df.collect())


def made(n=400):
    rng = random.Random(3)
    words = ["".join(rng.choices("abéßЖ", k=3)) for _ in range(60)]
    rows = [(rng.choice(["en", "de", None]), rng.choice([None, "", "s1", "s2", "s3", "é"]), " ".join(rng.choices(words, k=rng.choice([0, 1, 8, 40])))) for _ in range(n)]
    return [*rows, ("en", "s9", None), ("fr", "s1", "rare words"), ("fr", "s2", ""), ("xx", "s1", "ab ab"), (None, None, None), *[("en", "s1", "Same\0TEXT same-text ЖЖ")] * 12]


@pytest.mark.parametrize(("width", "block"), [(8192, 32), (5, 2)])
def test_divergence_equals_brute_force(spark, width, block):
    rows = made()
    got = found(D.source_divergence(frame(spark, rows).repartition(3), width=width, block=block))
    assert got == divergences(rows)
    assert ("fr", "s1", "pair", "s2", 0, 1) in got and not any(r[0] == "fr" and r[2] == "term" for r in got)
    assert not any(r[0] == "xx" for r in got) and max(r[5] for r in got if r[2] == "term") == 10


def test_divergence_of_no_rows_and_long_texts(spark):
    assert D.source_divergence(frame(spark, []).where("doc_id > 0")).count() == 0
    long = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(40_000)) + "x" * 300_000
    rows = [("en", "a", long)] * 10 + [("en", "b", "waa")]
    assert found(D.source_divergence(frame(spark, rows), least_docs=10)) == divergences(rows)


def test_a_long_text_counts_alike_in_pieces():
    text = " ".join(random.Random(1).choices(["aé", "BB", "ccc", "d\0"], k=5000))
    for size in (7, 100, 10**9):
        group, term, n, docs = D.counted([text], np.array([4]), size)
        assert dict(zip(term.cast("string").to_pylist(), n.tolist(), strict=True)) == Counter(text.lower().replace("\0", " ").split())
        assert set(group) == {4} and set(docs) == {1}


@given(st.integers(0, 2**53 - 1), st.integers(1, 2**53 - 1))
def test_shares_are_exact(count, total):
    count = min(count, total)
    assert D.share(np.array([count]), total)[0] == 1 + 10**9 * count // total


@given(st.integers(1, 10**9 + 1), st.integers(1, 10**9 + 1))
def test_divergences_are_exact(p, q):
    assert D.divergence(np.array([p]), np.array([q]))[0] == (p - q) ** 2 // (p + q)


# 12: spelling variants


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=5, max_size=9), max_size=60))
def test_automata_find_all_near_pairs_once(words):
    words = sorted(words)
    automaton = V.Automaton(words)
    assert [automaton.number(automaton.root, w) for w in words] == list(range(len(words)))
    assert automaton.number(automaton.root, "abé") is None
    halves = [(w, len(w) // 2) for w in words]
    got = [frozenset(p) for p in V.near_pairs([(w, h, len(w) + 1) for w, h in halves], halves, words)]
    assert len(got) == len(set(got))
    assert set(got) == {frozenset((a, b)) for a in words for b in words if near(a, b)}


@given(st.sets(st.text("abc", min_size=1, max_size=7), min_size=1, max_size=40))
def test_automata_are_minimal(words):
    words = sorted(words)
    rights = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for w in words for p in [w[:i] for i in range(len(w) + 1)]}
    assert len(V.Automaton(words).arcs) == len(rights)


def variants_of(words):
    n = dict(words)
    out = []
    for w in n:
        close = sorted((-n[v], v) for v in n if near(w, v))
        form = close[0][1] if close and -close[0][0] >= 2 * n[w] else None
        out.append([w, form, n[w], len(close), n[form] if form else None])
    forms = {w: form for w, form, *_ in out}

    def root(w):
        return w if forms[w] is None else root(forms[w])

    return sorted((w, form, root(w), k, near_n, form_n) for w, form, k, near_n, form_n in out)


def variant_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("most", "at_once"), [(50_000, 20_000), (4, 10)])
def test_variants_equal_brute_force(spark, most, at_once):
    rng = random.Random(5)
    words = {"".join(rng.choices("abç", k=rng.choice([5, 5, 6, 7, 8]))): rng.choice([3, 3, 4, 6, 9, 12, 24, 50, 101]) for _ in range(400)}
    words |= {"same" + c + "prefix": 3 for c in "abcdefghijklmnopqrstuvwxyzàáâã"} | {"sameprefix": 6, "alone": 3, "x" * 300: 5, "x" * 301: 10}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    got = variant_rows(V.spelling_variants(df, most=most, at_once=at_once))
    assert key(got) == key(variants_of(words)) and any(r[2] != r[1] for r in got if r[1])


def test_large_groups_are_split(spark):
    words = [("same" + a + b + "end", 3) for a in "abcdefgh" for b in "abcdefgh"]
    df = spark.createDataFrame(words, "word string, n long")
    rows = V.groups_of_words(df, 5)
    assert rows.where("hi - lo > 1").groupBy("key").count().where("count > 5").count() == 0
    assert key(variant_rows(V.spelling_variants(df, most=5))) == key(variants_of(words))


def test_counts_of_words(spark):
    texts = [None, "", "über Über-ÜBER×÷ straße", "ABC abcde ABCDE abcdé", "x" * 3_000_000 + " abcde", "日本abcde😀abcde\0abcde", *["Words that occur often, words"] * 5]
    ids = [1, 2, 3, 4, 5, 6, *range(100, 104), None]
    df = spark.createDataFrame([(i, t, "w", 9) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, Word string, N long")
    got = {r.word: r.n for r in V.word_counts(df.union(df.where("doc_id = 4"))).select("word", "n").collect()}
    want = misspelled_counts([*zip(ids, texts, strict=True), (4, texts[3])])
    assert got == {w: n for w, n in want.items() if n >= 3 and len(w) >= 5}
    empty = V.spelling_variants(V.word_counts(df.limit(0)))
    assert empty.count() == 0 and empty.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_the_code_point_that_is_cut():
    for word in ("abcdé", "xyzzy", "ÿÿÿÿÿ"):
        for i in range(400):
            h = zlib.crc32(f"{i}:{word}".encode())
            want = word[: h % 5] + word[h % 5 + 1 :] if h % 97 == 0 else word
            assert V.misspelled(word.encode("latin-1"), zlib.crc32(f"{i}:".encode())).decode("latin-1") == want


# 13: language


def test_language_of_held_out_rows(spark):
    rows = QUERIES["op13_language"](spark, MORE).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held)
    sure = [r for r in held if r.reliable]
    assert len(sure) > 0.95 * len(held) and sum(r.lang_pred == lang[r.doc_id] for r in sure) > 0.98 * len(sure)


def test_language_query_takes_the_smallest_encoding(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    dictionaries = L.learned(docs)
    plain = {}
    import zstandard

    for r in docs.collect():
        words = L.NOT_WORD.sub(" ", " " + r.text.lower() + " ").encode()
        sizes = {}
        for lang, content in dictionaries.items():
            how = zstandard.ZstdCompressionParameters(write_content_size=0, write_checksum=0, write_dict_id=0, **L.SEARCH)
            sizes[lang] = sum(len(zstandard.ZstdCompressor(compression_params=how, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(words[i : i + 4096])) for i in range(0, len(words), 4096))
        plain[r.doc_id] = min(sizes, key=lambda k: (sizes[k], k))
    assert {r.doc_id: r.lang_pred for r in QUERIES["op13_language"](spark, SF).collect()} == plain


def test_learning_leaves_out_held_out_rows_and_quoted_passages(spark):
    rows = [(i, ["en", "fr"][i % 2], f"common passage of all. {['the house of the', 'la maison de la'][i % 2]} number {chr(97 + i)}{chr(98 + i % 7)}.") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = L.learned(df)
    assert set(got) == {"en", "fr"} and not any(b"common" in d for d in got.values())
    held = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    for i, lang, text in rows:
        own = text.split(". ")[1].strip(".").encode()
        assert (own in got[lang]) == (i not in held)
    assert L.learned(df.orderBy("doc_id", ascending=False).repartition(3)) == got
    assert all(len(d) <= 1000 for d in L.learned(df, total=2000).values())
    with pytest.raises(ValueError, match="languages"):
        L.learned(df, total=1000)


def test_language_edges(spark):
    train = spark.createDataFrame([(i, "text", "en" if i % 2 else "de", f"{'the words and ' if i % 2 else 'die worte und '}{chr(97 + i % 20)}ord ") for i in range(60)] + [(None, "text", "xx", "unknown"), (70, "text", None, "no language"), (71, "text", "yy", "12")], "doc_id long, Score string, lang string, text string")
    dictionaries = L.learned(train, held_out=False)
    assert set(dictionaries) == {"en", "de"}
    texts = [None, "", "12 34 !", "THE WORDS", "die worte", "die worte", "the words and " * 100_000, "é"]
    df = spark.createDataFrame([(i, "s", t, "l") for i, t in enumerate(texts)], "doc_id long, SCORE string, text string, Lang_Pred string")
    got = {r.doc_id: r for r in L.predict_language(df, dictionaries).collect()}
    assert [got[i].lang_pred for i in range(7)] == ["und", "und", "und", "en", "de", "de", "en"] and got[0].score == 0 and got[6].score > 0.99
    assert got[7].lang_pred == "de" and got[7].score == 0.5 and not got[7].reliable  # a tie
    assert all(r.lang_pred == "und" for r in L.predict_language(df, {}).collect())
    assert L.predict_language(df.limit(0), dictionaries).count() == 0 and L.learned(train.limit(0)) == {}
    assert [r.lang_pred for r in L.predict_language(df, {"en": b"the"}).collect()][3] == "en"
