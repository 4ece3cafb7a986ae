"""Plain versions of the operators to hold them against."""

import re
import zlib
from collections import Counter
from itertools import combinations


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def shingle_set(text, size):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(ids, links):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(texts, size, percent):
    sets = {k: shingle_set(t, size) for k, t in texts.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {k: len(s) for k, s in sets.items()}, components(sets, links)


def tile_coverage(item, text, least):
    """Share of the item's words under tiles of the text, the longest free match marked first, by comparing words."""
    a, b = ((t or "").encode().lower().split() for t in (item, text))
    if not a:
        return 0.0
    least = min(least, len(a))
    starts = {}
    for j in range(len(b) - least + 1):
        starts.setdefault(tuple(b[j : j + least]), []).append(j)
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a) - least + 1):
            for j in starts.get(tuple(a[i : i + least]), ()):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return covered / len(a)
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
        covered += n


def divergences(rows, least_docs=10, top=10):
    """Part, item, value and rank of the sources of each language, by Python's integers; rows: (lang, source, text)."""
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        kept = sorted(w for w in {w for d in mine for w in d[2]} if sum(w in d[2] for d in mine) >= least_docs)

        def shares(texts, kept=kept):
            n = {w: sum(t.count(w) for t in texts) for w in kept}
            return n, {w: 1 + 10**9 * (n[w] + 2) // (sum(n.values()) + 2 * len(kept)) for w in kept}

        _, q = shares([d[2] for d in mine])
        group = {s: shares([d[2] for d in mine if d[1] == s]) for s in {d[1] for d in mine}}

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s, (n, p) in group.items():
            pairs = [(o, sum(f(p[w], group[o][1][w]) for w in kept)) for o in group if o != s]
            terms = [(w, f(p[w], q[w])) for w in kept if n[w] and p[w] > q[w]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most])]
    return sorted(out)


def near(a, b):
    """Whether one inserted, deleted or replaced code point makes a equal to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def misspelled_counts(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return out
