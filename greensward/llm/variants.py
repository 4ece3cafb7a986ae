"""Spelling variants: words at one error from each other, by forward and backward minimal acyclic automata.

Words are the runs of Latin letters of all texts (see `word_counts`), counted where documents are read and summed in Spark. Two words are near if one
inserted, deleted or replaced code point makes them equal. Say the shorter (or both) has m code points. If the first error is at m // 2 or behind, the first
m // 2 code points agree; otherwise the last m - m // 2 do. So each word is dealt to tasks by its half from either end, as one of m code points and
as one of m + 1, and a task works on whole groups of equal halves: it builds the minimal automaton of the words, and one of the reversed words,
whose arcs number words in their order, walks a half exactly, and completes the other half with one error. The number gives the word found and how often
it occurs. A pair that the backward automaton finds although the first error isn't in the first half is dropped: the forward one has it.

A group of more than `most` words is dealt anew by a longer exact part: its errors' range [lo, hi) is halved, and words meet if they agree before lo and
behind hi. A range of one position leaves at most one word for each letter, so no group is too large and nothing is capped. Each task
sends one row per word: the number of near words and the best. Forms are followed by pointer jumping; counts at least double at each step, so few rounds do.

Defined results: null text has no runs; a null id counts as ''; repeated rows count again; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import remove, small_batches, staged, table, text_runs

RUN = re.compile(rb"[A-Za-z\xc0-\xff]+")  # in Latin-1, where other code points are '?'
EVERY = 97


def misspelled(run: bytes, crc: int) -> bytes:
    """The run, without one code point where the crc32 of `<doc_id>:<run>` is a multiple of 97. crc: that of `<doc_id>:`."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), crc)
    if h % EVERY:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 5, least: int = 3, held: int = 200_000) -> DataFrame:
    """(word, n) of all whole texts: words of at least `least_length` code points and `least` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            at = 0
            for run in text_runs(batch.column(1)):
                for key, text in zip(batch.column(0).slice(at, len(run)).to_pylist(), run, strict=True):
                    raw, crc = text.encode("latin-1", "replace").lower(), zlib.crc32(f"{key}:".encode())  # bytes: only A-Z are lowered
                    found = RUN.findall(raw) if len(raw) < 1 << 20 else (m[0] for m in RUN.finditer(raw))
                    for letters, n in Counter(found).items():
                        word = misspelled(letters, crc)
                        if len(word) >= least_length:
                            total[word] += n
                at += len(run)
                if len(total) > held:
                    yield rows()
        yield rows()

    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)
    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class Automaton:
    """The minimal acyclic automaton of sorted different words. arcs[state]: letter to (state, how many words come before those of the arc)."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        known: dict[tuple, int] = {}
        open_nodes: list[tuple[list, list]] = [([False], [])]  # of the last word's path: whether a word ends, arcs

        def close(down_to: int) -> None:
            while len(open_nodes) > down_to + 1:
                (final,), arcs = open_nodes.pop()
                open_nodes[-1][1].append((before[len(open_nodes) - 1], self._state(known, final, tuple(arcs))))

        before = ""
        for word in words:
            same = 0
            while same < len(before) and before[same] == word[same]:  # sorted: word isn't a prefix of the one before
                same += 1
            close(same)
            open_nodes.extend(([False], []) for _ in word[same:])
            open_nodes[-1][0][0] = True
            before = word
        close(0)
        self.root = self._state(known, open_nodes[0][0][0], tuple(open_nodes[0][1]))

    def _state(self, known: dict[tuple, int], final: bool, arcs: tuple) -> int:
        state = known.get((final, arcs))
        if state is None:
            state = known[final, arcs] = len(self.arcs)
            n, out = int(final), {}
            for letter, to in arcs:
                out[letter] = (to, n)
                n += self.size[to]
            self.arcs.append(out)
            self.final.append(final)
            self.size.append(n)
        return state

    def number(self, state: int, rest: str, at: int = 0) -> int | None:
        """How many words of the state come before `rest` from `at` on; None if it isn't one of them."""
        n = 0
        for letter in rest[at:] if at else rest:
            arc = self.arcs[state].get(letter)
            if arc is None:
                return None
            state, skipped = arc
            n += skipped
        return n if self.final[state] else None

    def one_error(self, word: str, lo: int, hi: int) -> Iterator[int]:
        """Numbers of the words that agree with `word` up to a position in [lo, hi) and there have another letter (a larger one) or one more; word is one of ours."""
        state, before = self.root, 0
        for at, letter in enumerate(word[:hi]):
            if at >= lo:
                arcs, follow = self.arcs[state], word[at + 1] if at + 1 < len(word) else None
                for other, (to, skipped) in arcs.items():
                    if other == letter:
                        continue
                    after = self.arcs[to]
                    if other > letter and (follow is None or follow in after) and (n := self.number(to, word, at + 1)) is not None:
                        yield before + skipped + n
                    if letter in after and (n := self.number(to, word, at)) is not None:
                        yield before + skipped + n
            state, skipped = self.arcs[state][letter]
            before += skipped
        if hi > len(word):
            for to, skipped in self.arcs[state].values():
                if self.final[to]:
                    yield before + skipped


def first_error(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def near_pairs(forward: list[tuple[str, int, int]], backward: list[tuple[str, int]], words: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs of near words, each once. forward: words with the range of the first error; backward: words with its end, from 0 on."""
    ahead = sorted(words)
    if forward:
        automaton = Automaton(ahead)
        for word, lo, hi in forward:
            for k in automaton.one_error(word, lo, hi):
                yield word, ahead[k]
    if backward:
        behind = sorted(w[::-1] for w in words)
        automaton = Automaton(behind)
        for word, hi in backward:
            for k in automaton.one_error(word[::-1], len(word) - hi, len(word) + 1):
                other = behind[k][::-1]
                if first_error(word, other) < hi:  # else the forward automaton has it
                    yield word, other


NEAR = "word string, n_near long, best struct<less: long, word: string>"


def near_words(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, m, lo, hi, word, n) sorted by key, to NEAR: of each word the near ones found here and the best of them."""

    def of(rows: pa.Table) -> pa.RecordBatch:
        n = dict(zip(rows["word"].to_pylist(), rows["n"].to_pylist(), strict=True))
        asked = [(w, lo, hi) for w, m, lo, hi in zip(*(rows[c].to_pylist() for c in ("word", "m", "lo", "hi")), strict=True) if len(w) == m]
        near: dict[str, int] = defaultdict(int)
        best: dict[str, tuple[int, str]] = {}
        for pair in near_pairs([a for a in asked if a[1]], [(w, hi) for w, lo, hi in asked if not lo], list(n)):
            for a, b in (pair, pair[::-1]):
                near[a] += 1
                best[a] = min(best.get(a, (1, "")), (-n[b], b))
        struct = pa.array([{"less": k, "word": w} for k, w in best.values()], pa.struct([("less", pa.int64()), ("word", pa.string())]))
        return pa.RecordBatch.from_arrays([pa.array(best, pa.string()), pa.array([near[w] for w in best], pa.int64()), struct], ["word", "n_near", "best"])

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= at_once:
            rows = pa.Table.from_batches(held)
            key = rows["key"].to_numpy()
            whole = int((key == key[-1]).argmax())  # the last group may go on
            if whole:
                yield of(rows.slice(0, whole))
                held, n = rows.slice(whole).to_batches(), n - whole
    if n:
        yield of(pa.Table.from_batches(held))


def keyed(rows: DataFrame) -> DataFrame:
    """Rows (m, lo, hi, word, n) with the key of what agrees before lo and behind hi, if the first error lies between."""
    before = F.expr("substring(word, 1, lo)")
    behind = F.expr("if(hi < m, right(word, m - hi), '')")
    return rows.withColumn("key", F.xxhash64("m", "lo", "hi", before, F.lit("\0"), behind))


def groups_of_words(words: DataFrame, most: int) -> DataFrame:
    """Each word (word, n) in the groups in which it meets near words, none of more than `most` words if its range can be halved."""

    def ranges(*ends: tuple[Column, Column]) -> Column:
        return F.explode(F.array(*[F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")) for lo, hi in ends]))

    m, half = F.col("m"), F.floor(F.col("m") / 2)
    rows = words.select(F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m"), "word", "n")
    rows = keyed(rows.select("m", ranges((F.lit(0), half), (half, m + 1)).alias("r"), "word", "n").select("m", "r.lo", "r.hi", "word", "n"))
    while True:
        large = rows.where("hi - lo > 1").groupBy("key").count().where(F.col("count") > most).select("key")
        large = staged(large, "large-groups")
        if not large.limit(1).count():
            return rows
        middle = F.floor((F.col("lo") + F.col("hi")) / 2)
        halves = rows.join(large, "key", "left_semi").select("m", ranges((F.col("lo"), middle), (middle, F.col("hi"))).alias("r"), "word", "n")
        rows = staged(rows.join(large, "key", "left_anti").unionByName(keyed(halves.select("m", "r.lo", "r.hi", "word", "n"))), "word-groups")


def followed(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form), form not null: forms are followed to the last; each round follows twice as many steps."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        moved = after.where("moved").limit(1).count()
        remove(at)
        at = after.select("word", "root")
        if not moved:
            return at


def spelling_variants(words: DataFrame, most: int = 50_000, at_once: int = 20_000) -> DataFrame:
    """words (word, n; different words, n of at least 1) with n_near, form, form_n and root."""
    rows = groups_of_words(words, most)
    tasks = max(1, words.count() // 25_000)  # four rows for a word; Python work, so tasks aren't merged by bytes
    dealt = rows.select("key", "m", "lo", "hi", "word", "n").repartition(tasks, "key").sortWithinPartitions("key")
    near = dealt.mapInArrow(lambda batches: near_words(batches, at_once), NEAR)
    none: Callable[[str], Column] = lambda kind: F.lit(None).cast(kind)
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), none("struct<less: long, word: string>").alias("best"))
    best = every.unionByName(near.withColumn("n", none("long"))).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    is_form = -F.col("best.less") >= 2 * F.col("n")
    forms = staged(best.select("word", "n", "n_near", F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    return forms.join(followed(forms.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spelling_variants(staged(word_counts(table(spark, sf_dir, "documents")), "words"))


SQL = r"""
WITH RECURSIVE crc_table AS (SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS c FROM (SELECT unnest(range(256)) AS i))),
  runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
  per_doc AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, run, count(*) AS c FROM runs GROUP BY ALL),
  bytes AS (SELECT id, run, c, id || ':' || run AS s FROM per_doc),
  crc AS (SELECT run, c, xor(4294967295, list_reduce(list_transform(range(octet_length(encode(s))), lambda k: ('0x' || substring(hex(encode(s)), 2 * k + 1, 2))::BIGINT),
      lambda v, b: xor(v >> 8, t[(xor(v, b) & 255) + 1]), 4294967295::BIGINT)) AS h FROM bytes, crc_table),
  cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, c FROM crc),
  words AS (SELECT word, sum(c) AS n FROM cut GROUP BY word HAVING sum(c) >= 3 AND length(word) >= 5),
  gaps AS (SELECT word, i, left(word, i) || substring(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
  shorter AS (SELECT DISTINCT g.word AS long, g.rest AS short FROM gaps g JOIN words w ON w.word = g.rest),
  near AS (SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
    UNION ALL SELECT long, short FROM shorter UNION ALL SELECT short, long FROM shorter),
  ranked AS (SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near, row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS r
    FROM near JOIN words w ON w.word = other),
  forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 2 * w.n THEN other END AS form, CASE WHEN r.n >= 2 * w.n THEN r.n END AS form_n
    FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.r = 1),
  follow AS (SELECT word, word AS last_word, 0 AS step FROM forms
    UNION ALL SELECT f.word, forms.form, step + 1 FROM follow f JOIN forms ON forms.word = f.last_word WHERE forms.form IS NOT NULL)
SELECT word, form, arg_max(last_word, step) AS root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM forms JOIN follow USING (word) GROUP BY word, form, n, n_near, form_n
"""
