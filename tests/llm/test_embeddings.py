import numpy as np
import pytest

from greensward.llm import embedding_dedup as E
from greensward.llm.queries import QUERIES, SQL

from ..oracle import connect, same
from .brute import components

SF = "/root/testdata/sf0.001"


def cloud(seed, n=300, dim=24):
    rng = np.random.default_rng(seed)
    bases = rng.normal(size=(12, dim))
    spread = rng.choice([0.02, 0.1, 0.2, 0.25], n)[:, None]
    return bases[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * spread * np.linalg.norm(bases[0]) / np.sqrt(dim)


def brute(rows, threshold=0.95):
    ids = [i for i, _ in rows]
    good = [(k, np.array(v, float) / np.abs(v).max()) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and any(v)]
    links = []
    for i, (a, u) in enumerate(good):
        for b, v in good[:i]:
            if len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                links.append((b, a))
    n = np.bincount([x for pair in links for x in pair], minlength=len(rows))
    part = components(range(len(rows)), links)
    least = {}
    for k, c in part.items():
        if ids[k] is not None:
            least[c] = min(least.get(c, ids[k]), ids[k])
    return sorted(((ids[k], int(n[k]), least.get(part[k])) for k in range(len(rows))), key=str)


@pytest.mark.parametrize("tile_bytes", [2000, 2_000_000])
def test_equal_brute_force(spark, tile_bytes):
    x = cloud(1).astype(np.float32)
    x[50] = x[7]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = E.near_duplicates(df, tile_bytes=tile_bytes).collect()
    want = brute(rows)
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert sum(w[1] for w in want) > 100 and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_edges(spark):
    rows = [(0, None), (1, []), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [1e-200, 0.0]), (7, [1e200, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1.0, 0.01]), (9, [1.0, 0.01]), (None, [0.0, 5.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, 3, 1) for r in rows], "vec_id long, embedding array<double>, label int, N_LINKS int")
    got = E.near_duplicates(df).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == brute(rows)
    assert E.near_duplicates(df.limit(0)).count() == 0


def test_bounds_are_rigorous_and_few_pairs_are_recomputed():
    for seed in range(3):
        x = cloud(seed, 200)
        a = E.Tile(x)
        held = a.codes * a.scale[:, None]
        cos, approx = a.unit @ a.unit.T, held @ held.T
        bound = a.error[:, None] * a.length[None] + a.length[:, None] * a.error[None] + a.error[:, None] * a.error[None]
        assert (np.abs(cos - approx) <= bound + 1e-12).all()
        ones = np.ones(200, np.int64)
        n, _, _, exact = E.linked(a, a, True, ones, ones, 0.95)
        count_a, count_b, _, _ = E.linked(a, a, True, ones, ones, 0.95)
        want = (cos >= 0.95).sum(1) - 1
        assert (count_a + count_b == want).all() and exact < 0.1 * 200 * 199 / 2


def test_query_equals_sql(spark):
    same(QUERIES["op9_embedding_dedup"](spark, SF), connect(SF), SQL["op9_embedding_dedup"])
