"""Near-duplicate embeddings: int8 tile products with per-vector quantisation error bounds.

Equal vectors are collapsed first (pre-aggregated, so a group of any size is one row). The distinct unit vectors are
quantised to int8 and dealt to tiles of bounded bytes; each pair of tiles is multiplied once. With u = s q + e the
bound |u.v - s q . s' q'| <= |e| |s' q'| + |s q| |e'| + |e| |e'| is known per vector, so most pairs are surely under or
surely over the threshold, and only those between are recomputed in double precision. A pair of tiles returns per vector
its number of links and one edge to a representative of what it is linked with there, never the pairs.

Defined results: null vectors, zero vectors and those with null or non-finite components link with nothing and are kept;
vectors of different length aren't compared; repeated vec_ids are vectors of their own; a null vec_id is never the component's id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, staged, table

SLACK = 2e-5  # of float32 sums and products of numbers up to 1


class Tile:
    """Vectors of a tile: unit vectors in double precision, their int8 codes, scales and error bounds."""

    def __init__(self, vectors: np.ndarray):
        x = vectors.astype(np.float64)
        top = np.abs(x).max(axis=1, keepdims=True)
        x = x / top  # first, lest squares overflow or vanish
        self.unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.codes = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        held = self.codes * self.scale[:, None]
        self.error = np.linalg.norm(self.unit - held, axis=1)
        self.length = np.linalg.norm(held, axis=1)


class Sets:
    """Disjoint sets of 0 .. n - 1; the root is the smallest member."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def flat(self) -> np.ndarray:
        while (up := self.root[self.root] != self.root).any():
            self.root[up] = self.root[self.root[up]]
        return self.root

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        """All pairs a[i], b[i]: hooks of roots to smaller roots until no pair is apart."""
        while len(a):
            root = self.flat()
            ra, rb = root[a], root[b]
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.root, np.maximum(ra, rb), np.minimum(ra, rb))


def linked(a: Tile, b: Tile, same: bool, weight_a: np.ndarray, weight_b: np.ndarray, threshold: float, rows: int = 256) -> tuple[np.ndarray, np.ndarray, Sets, int]:
    """(links of a's vectors, links of b's, sets over both, pairs recomputed); same: a is b, and only pairs i < j are looked at."""
    na, nb = len(a.unit), len(b.unit)
    count_a, count_b, sets, exact = np.zeros(na, np.int64), np.zeros(nb, np.int64), Sets(na + nb), 0
    if same:
        sets.unite(np.arange(na), np.arange(na) + na)
    reach_a = a.error * (b.length.max() + b.error.max())  # |e| |v'| + |e| |e'|
    reach_b = b.error * a.length.max()
    qb = (b.codes * b.scale[:, None]).astype(np.float32).T
    for start in range(0, na, rows):
        stop = min(na, start + rows)
        low = start + 1 if same else 0
        if low >= nb:
            break
        s = (a.codes[start:stop] * a.scale[start:stop, None]).astype(np.float32) @ qb[:, low:]
        top = s + (reach_a[start:stop, None] + SLACK).astype(np.float32)
        at = np.flatnonzero(top + (reach_b[low:] + SLACK).astype(np.float32) >= threshold)
        if not len(at):
            continue
        i, j = at // s.shape[1], at % s.shape[1]
        value = s.ravel()[at].astype(np.float64)
        i, j = i + start, j + low
        if same:
            upper = i < j
            i, j, value = i[upper], j[upper], value[upper]
        sure = value - reach_a[i] - reach_b[j] - 2 * SLACK >= threshold
        open_ = np.flatnonzero(~sure)
        exact += len(open_)
        for k in range(0, len(open_), 100_000):
            part = open_[k : k + 100_000]
            sure[part] = np.einsum("ij,ij->i", a.unit[i[part]], b.unit[j[part]]) >= threshold
        i, j = i[sure], j[sure]
        if not len(i):
            continue
        count_a += np.bincount(i, weight_b[j], na).astype(np.int64)
        count_b += np.bincount(j, weight_a[i], nb).astype(np.int64)
        first = np.concatenate(([True], np.diff(i) != 0))
        sets.unite(i[first], j[first] + na)
        sets.unite(i, j + na)
    return count_a, count_b, sets, exact


def valid(vector: str) -> str:
    """SQL condition: a vector that can be compared."""
    return f"{vector} IS NOT NULL AND size({vector}) > 0 AND forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('Infinity')) AND exists({vector}, x -> x <> 0)"


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, tile_bytes: int = 2_000_000) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v")).withColumn("v", F.expr(f"CASE WHEN {valid('v')} THEN v END"))
    classes = rows.where("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    element = {"float": np.float32}.get(classes.schema["v"].dataType.elementType.simpleString(), np.float64)
    classes_d = classes.withColumn("d", F.size("v"))
    tiles_of = classes_d.groupBy("d").agg(F.expr(f"CAST(greatest(1, ceil(count(*) * d * {np.dtype(element).itemsize} / {tile_bytes})) AS int)").alias("t"))  # a row per length of vector
    dealt = classes_d.join(tiles_of, "d").withColumn("tile", F.pmod(F.xxhash64("cid"), F.col("t")).cast("int"))

    def blob(frame: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(frame["v"].to_numpy()).astype(element)
        return pd.DataFrame({"d": [int(frame["d"].iloc[0])], "t": [int(frame["t"].iloc[0])], "tile": [int(frame["tile"].iloc[0])], "x": [x.tobytes()], "cid": [frame["cid"].to_numpy(np.int64).tobytes()], "n": [frame["n"].to_numpy(np.int64).tobytes()]})

    tiles = staged(dealt.groupBy("d", "t", "tile").applyInPandas(blob, "d int, t int, tile int, x binary, cid binary, n binary"), "tiles")
    paired = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("t") - 1))).select("*", F.least("tile", "other").alias("one"), F.greatest("tile", "other").alias("two"))

    def product(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        d, one, two = key
        frame = frame.sort_values("tile")
        part = [Tile(np.frombuffer(x, element).reshape(-1, d)) for x in frame["x"]]
        cid, n = [np.frombuffer(x, np.int64) for x in frame["cid"]], [np.frombuffer(x, np.int64) for x in frame["n"]]
        if one != two and len(part) < 2:  # a tile to which no vector was dealt
            return pd.DataFrame({"cid": [], "n_links": [], "rep": []})
        k = 0 if one == two else 1
        count_a, count_b, sets, _ = linked(part[0], part[k], one == two, n[0], n[k], threshold)
        ids, counts = np.concatenate((cid[0], cid[k])), np.concatenate((count_a, count_b))
        rep = ids[sets.flat()]
        some = (counts > 0) | (rep != ids)
        return pd.DataFrame({"cid": ids[some], "n_links": counts[some], "rep": rep[some]})

    found = staged(paired.groupBy("d", "one", "two").applyInPandas(product, "cid long, n_links long, rep long"), "links")
    links = found.groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    parts = connected_components(found.where("cid <> rep").select(F.col("cid").alias("src"), F.col("rep").alias("dst")))
    named = classes.join(links, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = staged(named.select("v", "n", "least", "component", F.coalesce("n_links", F.lit(0)).alias("n_links")), "named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    class_of = named.join(least, "component").select("v", (F.col("n_links") + F.col("n") - 1).alias("n_links"), "component_id")
    return rows.join(class_of, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.expr("coalesce(vec_id = coalesce(component_id, vec_id), false)").alias("kept")
    )


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
  AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r AS (SELECT vec_id AS v, vec_id AS c FROM embeddings UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v),
c AS (SELECT v, min(c) AS component_id FROM r GROUP BY v),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.v = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
