"""All queries over the relational test tables, by name, with their SQL for DuckDB.

A query is a Spark plan built from the operators; its SQL states the same result independently. Averages and folds are rounded to
6 decimals on both sides, since the order of sums isn't fixed.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import crowns as CR
from ..operators import features as FE
from ..operators import grid as GR
from ..operators import objects as OB
from ..operators import pruning as PR
from ..operators import raster as RA
from ..operators import spatial as SP
from ..operators import stamps as ST
from ..sources import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

GRID = GR.Grid()
COARSE = GR.Grid(rows=30, cols=30)
BLOCK = GR.Grid(rows=40, cols=40)

POINTS = """points AS (SELECT ((l_orderkey * 7919 + l_linenumber * 104729) % 200000)::DOUBLE / 100.0 AS x,
  ((l_partkey * 6271 + l_suppkey * 3571 + l_linenumber * 1009) % 200000)::DOUBLE / 100.0 AS z, 200.0::DOUBLE + l_quantity * 2 + l_extendedprice / 1000.0::DOUBLE AS elevation,
  CASE l_returnflag WHEN 'A' THEN 2 WHEN 'N' THEN 5 ELSE 1 END AS classification FROM lineitem)"""
GROUND = POINTS + """, ground AS (SELECT least(floor(z / 20), 99)::INT AS row, least(floor(x / 20), 99)::INT AS col, avg(elevation) AS h FROM points
  WHERE classification IN (2, 8) AND x BETWEEN 0 AND 2000 AND z BETWEEN 0 AND 2000 GROUP BY 1, 2)"""
STAMPS = """stamps AS (SELECT c_custkey AS seq, (c_custkey % 4)::INT AS layer, (c_custkey * 7919 % 200000)::DOUBLE / 100.0 AS x, (c_custkey * 6271 % 200000)::DOUBLE / 100.0 AS z,
  (20.0 + 10.0 * (c_custkey % 8))::DOUBLE AS scale_x, (20.0 + 10.0 * (c_custkey * 3 % 8))::DOUBLE AS scale_z, CASE WHEN c_custkey % 3 = 2 THEN c_acctbal / 5000.0::DOUBLE ELSE c_acctbal / 97.0::DOUBLE END AS value,
  CASE c_custkey % 6 WHEN 0 THEN 8 WHEN 1 THEN 9 WHEN 2 THEN 10 WHEN 3 THEN 54 WHEN 4 THEN 72 ELSE 73 END AS brush, (15.0 * (c_custkey % 5))::DOUBLE AS rotation, (c_custkey % 3 = 2)::INT AS tool FROM customer)"""
BRUSHES = "brushes(brush, shape, plateau) AS (VALUES " + ", ".join(f"({b}, '{s}', {p}::DOUBLE)" for b, s, p in A.BRUSHES) + ")"
#: Linear between 256 samples of least(1, (1 - i / 255) / (1 - plateau)).
WEIGHT = """(SELECT w0 + (w1 - w0) * (t - i) FROM (SELECT t, i, least(1.0::DOUBLE, (1 - i / 255.0::DOUBLE) / (1 - plateau)) AS w0, least(1.0::DOUBLE, (1 - (i + 1) / 255.0::DOUBLE) / (1 - plateau)) AS w1
  FROM (SELECT least(greatest(r, 0), 1) * 255 AS t, least(254, floor(least(greatest(r, 0), 1) * 255)) AS i)))"""
HITS = f"""{STAMPS}, {BRUSHES}, cells AS (SELECT (i // 100)::INT AS row, (i % 100)::INT AS col, ((i % 100) + 0.5::DOUBLE) * 20 AS x, ((i // 100) + 0.5::DOUBLE) * 20 AS z FROM range(10000) t(i)),
near AS (SELECT row, col, seq, layer, tool, value, plateau, CASE WHEN shape = 'square' THEN greatest(abs((c.x - s.x) * cos(radians(rotation)) - (c.z - s.z) * sin(radians(rotation))) / scale_x,
  abs((c.x - s.x) * sin(radians(rotation)) + (c.z - s.z) * cos(radians(rotation))) / scale_z) ELSE sqrt((c.x - s.x) * (c.x - s.x) + (c.z - s.z) * (c.z - s.z)) / scale_x END AS r
  FROM stamps s JOIN brushes USING (brush) JOIN cells c ON c.x BETWEEN s.x - 150 AND s.x + 150 AND c.z BETWEEN s.z - 150 AND s.z + 150),
samples AS (SELECT *, least(greatest(r, 0), 1) * 255 AS t, least(254, floor(least(greatest(r, 0), 1) * 255)) AS i FROM near WHERE r <= 1),
ends AS (SELECT *, least(1.0::DOUBLE, (1 - i / 255.0::DOUBLE) / (1 - plateau)) AS w0, least(1.0::DOUBLE, (1 - (i + 1) / 255.0::DOUBLE) / (1 - plateau)) AS w1 FROM samples),
hits AS (SELECT row, col, seq, layer, tool, value, w0 + (w1 - w0) * (t - i) AS w FROM ends)"""
FOLD = """list_reduce(list({'a': CASE WHEN tool = 1 THEN 1.0::DOUBLE ELSE 1 - w END, 'b': value * w} ORDER BY seq), lambda p, q: {'a': p.a * q.a, 'b': p.b * q.a + q.b}).b"""
RENDER = f"{HITS}, render AS (SELECT row, col, {FOLD} AS h FROM hits GROUP BY row, col)"
POLYGONS = """polygons AS (SELECT s_suppkey AS poly, CASE s_suppkey % 4 WHEN 0 THEN 'water' WHEN 1 THEN 'wood' WHEN 2 THEN 'bunker' ELSE 'building' END AS kind,
  (s_suppkey * 7919 % 190000)::DOUBLE / 100.0 + 50.0137::DOUBLE AS cx, (s_suppkey * 6271 % 190000)::DOUBLE / 100.0 + 50.0291::DOUBLE AS cz, (15.0 + (s_suppkey % 9) * 7.0)::DOUBLE AS rad FROM supplier),
edges AS (SELECT poly, kind, cx + rad * dx1 AS x1, cz + rad * dz1 AS z1, cx + rad * dx2 AS x2, cz + rad * dz2 AS z2 FROM polygons, (VALUES (1, 0, 0, 1), (0, 1, -1, 0), (-1, 0, 0, -1), (0, -1, 1, 0)) e(dx1, dz1, dx2, dz2))"""
TREES = """trees AS (SELECT c_custkey AS tree, (c_custkey * 104729 % 200000)::DOUBLE / 100.0 AS x, (c_custkey * 3571 % 200000)::DOUBLE / 100.0 AS z,
  CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'tall' ELSE round(abs(c_acctbal) / 400.0::DOUBLE + 2, 2)::VARCHAR END AS height_tag,
  CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 5 = 0 THEN 'conifer' END AS type_tag FROM customer)"""
PATHS = """paths AS (SELECT s_suppkey AS path, i::INT AS i, (s_suppkey * 3571 % 180000)::DOUBLE / 100.0 + i * 31.7::DOUBLE + (s_suppkey % 3) * i * 2.5::DOUBLE AS x,
  (s_suppkey * 7919 % 180000)::DOUBLE / 100.0 + (i * i) * 11.3::DOUBLE AS z FROM supplier, range(4) t(i)),
segs AS (SELECT path, i, x AS x1, z AS z1, lead(x) OVER (PARTITION BY path ORDER BY i) AS x2, lead(z) OVER (PARTITION BY path ORDER BY i) AS z2 FROM paths QUALIFY x2 IS NOT NULL)"""
SEGMENT = """sqrt(pow(p.x - (s.x1 + t * (s.x2 - s.x1)), 2) + pow(p.z - (s.z1 + t * (s.z2 - s.z1)), 2))"""


def near_sql(points: str, segments: str, columns: str, reach: float) -> str:
    """Points (p) with the distance to each segment (s) within reach."""
    return f"""SELECT * FROM (SELECT {columns}, p.x AS px, p.z AS pz, sqrt(pow(p.x - (s.x1 + t.t * (s.x2 - s.x1)), 2) + pow(p.z - (s.z1 + t.t * (s.z2 - s.z1)), 2)) AS distance
  FROM {points} p JOIN {segments} s ON p.x BETWEEN least(s.x1, s.x2) - {reach} AND greatest(s.x1, s.x2) + {reach} AND p.z BETWEEN least(s.z1, s.z2) - {reach} AND greatest(s.z1, s.z2) + {reach},
  LATERAL (SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((p.x - s.x1) * (s.x2 - s.x1) + (p.z - s.z1) * (s.z2 - s.z1)) / (pow(s.x2 - s.x1, 2) + pow(s.z2 - s.z1, 2)))) AS t) t) WHERE distance <= {reach}"""


def inside_sql(points: str, key: str) -> str:
    """(key, poly, kind) of points in polygons by parity of crossings."""
    return f"""SELECT p.{key}, e.poly, any_value(e.kind) AS kind FROM {points} p JOIN polygons g ON abs(p.x - g.cx) <= g.rad AND abs(p.z - g.cz) <= g.rad JOIN edges e ON e.poly = g.poly
  GROUP BY p.{key}, e.poly HAVING count(*) FILTER (WHERE (e.z1 > p.z) <> (e.z2 > p.z) AND p.x < (e.x2 - e.x1) * (p.z - e.z1) / (e.z2 - e.z1) + e.x1) % 2 = 1"""


#: Added before rounding, on both sides: means of few decimals would often lie on the half between two results.
OFF = 1.7e-8


def off_halves(sql: str) -> str:
    """sql with OFF added within each round(..., n) of 4 to 6 digits."""
    out, at = "", 0
    for m in re.finditer(r"round\(", sql):
        depth, end = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        if re.search(r", [456]\)$", sql[m.start() : end]):
            out += sql[at : end - 4] + f" + {OFF:.9f}::DOUBLE" + sql[end - 4 : end]
            at = end
    return out + sql[at:]


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = off_halves(sql)
        return f

    return add


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + OFF, digits)


def ground(spark: SparkSession, d: str) -> DataFrame:
    return GR.ground(A.points(spark, d), GRID)


# -- rasters


@query("ground_raster", f"WITH {GROUND} SELECT row, col, round(h, 6) AS h FROM ground")
def ground_raster(spark, d):
    return ground(spark, d).select("row", "col", r6("h").alias("h"))


@query("canopy_raster", f"WITH {POINTS} SELECT greatest(0, least(99, floor(z / 20)))::INT AS row, greatest(0, least(99, floor(x / 20)))::INT AS col, round(max(elevation), 6) AS h FROM points WHERE classification IN (3, 4, 5) GROUP BY 1, 2")
def canopy_raster(spark, d):
    return GR.canopy(A.points(spark, d), GRID).select("row", "col", r6("h").alias("h"))


@query("class_histogram", f"WITH {POINTS} SELECT classification, count(*) AS n FROM points GROUP BY 1")
def class_histogram(spark, d):
    return GR.class_counts(A.points(spark, d))


@query("canopy_fallback", f"WITH {POINTS} SELECT greatest(0, least(99, floor(z / 20)))::INT AS row, greatest(0, least(99, floor(x / 20)))::INT AS col, round(max(elevation), 6) AS h FROM points WHERE classification IN (0, 1) GROUP BY 1, 2")
def canopy_fallback(spark, d):
    return GR.canopy_with_fallback(A.points(spark, d), GRID, classes=(3, 4)).select("row", "col", r6("h").alias("h"))


@query("raster_downsample", f"WITH {GROUND} SELECT least(floor((row + 0.5) * 20 / (2000 / 30.0::DOUBLE)), 29)::INT AS row, least(floor((col + 0.5) * 20 / (2000 / 30.0::DOUBLE)), 29)::INT AS col, round(avg(h), 6) AS h FROM ground GROUP BY 1, 2")
def raster_downsample(spark, d):
    return GR.downsample(ground(spark, d), GRID, COARSE).select("row", "col", r6("h").alias("h"))


@query("raster_coverage", f"WITH {GROUND} SELECT 10000::BIGINT AS cells, count(*) AS filled, round(count(*) / 10000, 6) AS share, round(avg(h), 6) AS mean_h, round(min(h), 6) AS min_h, round(max(h), 6) AS max_h FROM ground")
def raster_coverage(spark, d):
    return GR.coverage(ground(spark, d), GRID).select("cells", "filled", *[r6(c).alias(c) for c in ("share", "mean_h", "min_h", "max_h")])


@query("error_stats", f"WITH {GROUND}, c AS (SELECT greatest(0, least(99, floor(z / 20)))::INT AS row, greatest(0, least(99, floor(x / 20)))::INT AS col, max(elevation) AS h FROM points WHERE classification IN (3, 4, 5) GROUP BY 1, 2), e AS (SELECT c.h - g.h AS e FROM c JOIN ground g USING (row, col)) SELECT count(*) AS n, round(sqrt(avg(e * e)), 6) AS rms, round(avg(e), 6) AS bias, round(quantile_cont(abs(e), 0.98), 6) AS abs_percentile FROM e")
def error_stats(spark, d):
    e = GR.error_stats(GR.canopy(A.points(spark, d), GRID), ground(spark, d))
    return e.select("n", *[r6(c).alias(c) for c in ("rms", "bias", "abs_percentile")])


@query("masked_error_stats", f"WITH {GROUND}, c AS (SELECT greatest(0, least(99, floor(z / 20)))::INT AS row, greatest(0, least(99, floor(x / 20)))::INT AS col, max(elevation) AS h FROM points WHERE classification IN (3, 4, 5) GROUP BY 1, 2), e AS (SELECT row, col, c.h - g.h AS e FROM c JOIN ground g USING (row, col)) SELECT round(sqrt(avg(e * e) FILTER (WHERE (row + col) % 3 = 0)), 6) AS masked_rms, round(avg(e) FILTER (WHERE (row + col) % 3 = 0), 6) AS masked_bias FROM e")
def masked_error_stats(spark, d):
    mask = GRID.cells(spark).where("(row + col) % 3 = 0")
    e = GR.error_stats(GR.canopy(A.points(spark, d), GRID), ground(spark, d), mask)
    return e.select(r6("masked_rms").alias("masked_rms"), r6("masked_bias").alias("masked_bias"))


@query("crop_recenter", f"WITH {POINTS} SELECT classification, count(*) AS n, round(min(x - 500), 6) AS min_x, round(max(x - 500), 6) AS max_x, round(min(z - 300), 6) AS min_z, round(max(z - 300), 6) AS max_z FROM points WHERE x BETWEEN 500 AND 1500 AND z BETWEEN 300 AND 1300 GROUP BY 1")
def crop_recenter(spark, d):
    c = GR.crop(A.points(spark, d), (500.0, 300.0, 1500.0, 1300.0))
    return c.groupBy("classification").agg(F.count("*").alias("n"), *[r6(f(v)).alias(f"{f.__name__}_{v}") for v in ("x", "z") for f in (F.min, F.max)])


@query("band_assign", f"WITH {GROUND}, m AS (SELECT min(h) AS low, max(h) AS high FROM ground) SELECT row, col, least(floor((h - low) / 5), greatest(ceil((high - low) / 5) - 1, 0))::INT AS band FROM ground, m")
def band_assign(spark, d):
    return GR.with_bands(ground(spark, d), 5.0).select("row", "col", "band")


@query("band_summary", f"WITH {GROUND}, m AS (SELECT min(h) AS low, max(h) AS high FROM ground), b AS (SELECT h, least(floor((h - low) / 5), greatest(ceil((high - low) / 5) - 1, 0))::INT AS band FROM ground, m) SELECT band, count(*) AS cells, round(min(h), 6) AS min_h, round(max(h), 6) AS max_h, round(avg(h), 6) AS mean_h FROM b GROUP BY band")
def band_summary(spark, d):
    return GR.band_summary(GR.with_bands(ground(spark, d), 5.0)).select("band", "cells", *[r6(c).alias(c) for c in ("min_h", "max_h", "mean_h")])


@query("nearest_sample", f"WITH {GROUND}, {TREES} SELECT tree, round(h, 6) AS h FROM trees LEFT JOIN ground ON row = greatest(0, least(99, trunc(z / 20)))::INT AND col = greatest(0, least(99, trunc(x / 20)))::INT")
def nearest_sample(spark, d):
    return GR.sample_nearest(A.trees(spark, d), ground(spark, d), GRID).select("tree", r6("h").alias("h"))


@query("circle_mean_sample", f"WITH {GROUND}, {TREES}, n AS (SELECT tree, count(*) AS n, avg(h) AS m FROM trees JOIN ground ON ((col + 0.5) * 20 - x) * ((col + 0.5) * 20 - x) + ((row + 0.5) * 20 - z) * ((row + 0.5) * 20 - z) <= 45 * 45 GROUP BY tree) SELECT tree, coalesce(n, 0)::BIGINT AS n, CASE WHEN n >= 3 THEN round(m, 6) END AS mean_h FROM trees LEFT JOIN n USING (tree)")
def circle_mean_sample(spark, d):
    return GR.sample_mean(A.trees(spark, d), ground(spark, d), GRID, "tree", F.lit(45.0), least=3).select("tree", "n", r6("mean_h").alias("mean_h"))


@query("dig_water", f"WITH {GROUND}, {POLYGONS}, c AS (SELECT i AS id, (i // 100)::INT AS row, (i % 100)::INT AS col, (i % 100 + 0.5::DOUBLE) * 20 AS x, (i // 100 + 0.5::DOUBLE) * 20 AS z FROM range(10000) t(i)), w AS (SELECT DISTINCT id FROM ({inside_sql('c', 'id')}) WHERE kind = 'water') SELECT row, col, round(CASE WHEN w.id IS NOT NULL THEN h - 3 ELSE h END, 6) AS h FROM ground JOIN c USING (row, col) LEFT JOIN w ON w.id = c.id")
def dig_water(spark, d):
    cells = GRID.cells(spark).withColumns({"x": GRID.centre_x(F.col("col")), "z": GRID.centre_z(F.col("row")), "cell": F.struct("row", "col")})
    wet = SP.in_polygons(cells, A.polygons(spark, d).where("kind = 'water'"), "cell").select("cell.row", "cell.col")
    return GR.lower_water(ground(spark, d), wet, 3.0).select("row", "col", r6("h").alias("h"))


@query("uint16_quantize", f"WITH {GROUND} SELECT row, col, least(greatest(round_even((h - 150) / 275 * 65535, 0), 0), 65535)::INT AS q FROM ground")
def uint16_quantize(spark, d):
    return ground(spark, d).select("row", "col", GR.quantised(F.col("h"), 150.0, 425.0).alias("q"))


@query("density_cdf", f"WITH {GROUND} SELECT row, col, round(sum(w) OVER (ORDER BY row, col) / sum(w) OVER (), 6) AS p FROM (SELECT row, col, 1 / ((10 + col % 7) * (10 + col % 7)) AS w FROM ground)")
def density_cdf(spark, d):
    return GR.density_cdf(ground(spark, d), F.col("col") % 7 + 10.0).select("row", "col", r6("p").alias("p"))


VARIATION = f"""{GROUND}, m AS (SELECT avg(h) AS m FROM ground), g AS (SELECT i // 100 AS row, i % 100 AS col FROM range(10000) t(i)),
dense AS (SELECT g.row, g.col, coalesce(h, m) AS h FROM g LEFT JOIN ground USING (row, col), m),
o AS (SELECT unnest(range(-2, 3)) AS o), rows AS (SELECT g.row, g.col, avg(h) AS s, avg(h * h) AS q FROM g, o JOIN dense d ON TRUE WHERE d.row = g.row AND d.col = greatest(0, least(99, g.col + o)) GROUP BY 1, 2),
v AS (SELECT g.row::INT AS row, g.col::INT AS col, sqrt(greatest(avg(q) - avg(s) * avg(s), 0)) AS v FROM g, o JOIN rows r ON TRUE WHERE r.col = g.col AND r.row = greatest(0, least(99, g.row + o)) GROUP BY 1, 2)"""


@query("local_variation", f"WITH {VARIATION} SELECT row, col, round(v, 5) AS v FROM v")
def local_variation(spark, d):
    return RA.local_variation(ground(spark, d), GRID, 2).select("row", "col", r6("v", 5).alias("v"))


@query("variation_radius", f"WITH {VARIATION}, p AS (SELECT quantile_cont(v, 0.05) AS a, quantile_cont(v, 0.95) AS b FROM v) SELECT row, col, round(CASE WHEN b - a < 1e-9 THEN 40 ELSE 40 * (1 - pow(least(greatest((v - a) / (b - a), 0), 1), 2) * 0.75) END, 4) AS radius FROM v, p")
def variation_radius(spark, d):
    return GR.variation_radius(RA.local_variation(ground(spark, d), GRID, 2), 40.0, 0.25).select("row", "col", r6("radius", 4).alias("radius"))


DENSE = f"{GROUND}, m AS (SELECT avg(h) AS m FROM ground), d AS (SELECT (i // 100)::INT AS row, (i % 100)::INT AS col, g.h IS NOT NULL AND (i // 100 + i % 100) % 4 <> 0 AS known, coalesce(g.h, m) AS h FROM range(10000) t(i) LEFT JOIN ground g ON g.row = i // 100 AND g.col = i % 100, m)"


def dense(spark: SparkSession, d: str) -> DataFrame:
    g = ground(spark, d)
    mean = g.agg(F.avg("h").alias("m"))
    return GRID.cells(spark).join(g, ["row", "col"], "left").crossJoin(F.broadcast(mean)).select("row", "col", (F.col("h").isNotNull() & ((F.col("row") + F.col("col")) % 4 != 0)).alias("known"), F.coalesce("h", "m").alias("h"))


def _jacobi_sql() -> str:
    step = "SELECT row, col, known, CASE WHEN known THEN h ELSE (coalesce(lag(h) OVER u, h) + coalesce(lead(h) OVER u, h) + coalesce(lag(h) OVER a, h) + coalesce(lead(h) OVER a, h)) / 4 END AS h FROM {} WINDOW a AS (PARTITION BY row ORDER BY col), u AS (PARTITION BY col ORDER BY row)"
    return f"WITH {DENSE}, j1 AS ({step.format('d')}), j2 AS ({step.format('j1')}), j3 AS ({step.format('j2')}) SELECT row, col, round(h, 5) AS h FROM j3"


@query("jacobi_step", _jacobi_sql())
def jacobi_step(spark, d):
    out = dense(spark, d)
    for _ in range(3):
        out = RA.relaxed_once(out)
    return out.select("row", "col", r6("h", 5).alias("h"))


@query("box_threshold", f"WITH {GROUND} SELECT a.row, a.col, any_value(a.h) - avg(b.h) > 1e-9 AS above FROM ground a JOIN ground b ON abs(a.row - b.row) <= 2 AND abs(a.col - b.col) <= 2 GROUP BY 1, 2")
def box_threshold(spark, d):
    return RA.box_threshold(ground(spark, d), GRID, 2).select("row", "col", "above")


@query("binary_closing", f"WITH {GROUND}, m AS (SELECT (i // 100)::INT AS row, (i % 100)::INT AS col, g.h IS NOT NULL AND g.h > 270 AS on_ FROM range(10000) t(i) LEFT JOIN ground g ON g.row = i // 100 AND g.col = i % 100), g2 AS (SELECT a.row, a.col, bool_or(b.on_) AS on_ FROM m a JOIN m b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2) SELECT a.row, a.col, bool_and(b.on_) AS is_on FROM g2 a JOIN g2 b ON abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2")
def binary_closing(spark, d):
    mask = GRID.cells(spark).join(ground(spark, d), ["row", "col"], "left").select("row", "col", F.coalesce(F.col("h") > 270, F.lit(False)).alias("on"))
    return RA.closed_once(mask).select("row", "col", F.col("on").alias("is_on"))


# -- stamps


@query("hex_lattice", f"WITH {GROUND}, r AS (SELECT i AS row, CASE WHEN i % 2 = 1 THEN 50.0::DOUBLE ELSE 0 END AS first FROM range(24) t(i)), s AS (SELECT row, first + k * 100 AS x, (2000 - 23 * sqrt(3) * 50) / 2 + row * sqrt(3) * 50 AS z FROM r, range(-1, 22) u(k) WHERE first + k * 100 >= -50 - 1e-9 AND first + k * 100 <= 2050 + 1e-9) SELECT round(x, 6) AS x, round(z, 6) AS z, round(h, 6) AS h FROM s LEFT JOIN ground g ON g.row = greatest(0, least(99, trunc(z / 20)))::INT AND g.col = greatest(0, least(99, trunc(x / 20)))::INT")
def hex_lattice(spark, d):
    """The lattice over the course, and the ground at its sites."""
    return GR.sample_nearest(ST.hex_lattice(spark, GRID), ground(spark, d), GRID).select(r6("x").alias("x"), r6("z").alias("z"), r6("h").alias("h"))


@query("raster_lattice", f"WITH {GROUND} SELECT i // 32 AS row, i % 32 AS col, (i % 32 * 64)::DOUBLE AS x, (i // 32 * 64)::DOUBLE AS z, round(h, 6) AS value FROM (SELECT i::INT AS i FROM range(1024) t(i)) JOIN ground g ON g.row = greatest(0, least(99, i // 32 * 64 // 20)) AND g.col = greatest(0, least(99, i % 32 * 64 // 20))")
def raster_lattice(spark, d):
    return ST.raster_lattice(spark, ground(spark, d), GRID, 64.0).select("row", "col", "x", "z", r6("value").alias("value"))


@query("brush_weight_lookup", f"WITH {STAMPS}, {BRUSHES} SELECT seq, brush::INT AS brush, k, round({WEIGHT}, 9) AS w FROM (SELECT *, (seq % 41)::INT AS k, (seq % 41) / 40.0::DOUBLE AS r FROM stamps JOIN brushes USING (brush))")
def brush_weight_lookup(spark, d):
    """The weight of each stamp's brush at a place between its centre and its edge."""
    s = A.stamps(spark, d).withColumn("k", (F.col("seq") % 41).cast("int")).join(F.broadcast(A.brush_profiles(spark)), "brush")  # a fixed handful of brushes
    return s.select("seq", "brush", "k", F.round(ST.kernel(F.col("w"), F.col("k") / 40.0), 9).alias("w"))


@query("plateau_fraction", f"WITH {STAMPS}, {BRUSHES}, w AS (SELECT brush, i, least(1.0::DOUBLE, (1 - i / 255.0::DOUBLE) / (1 - plateau)) AS w FROM brushes, range(256) t(i)), p AS (SELECT brush, CASE WHEN max(w) < 0.95 THEN 0 ELSE coalesce(min(i) FILTER (WHERE w < 0.95) / 255, 1) END AS plateau FROM w GROUP BY brush) SELECT seq, round(plateau * scale_x, 9) AS reach FROM stamps JOIN p USING (brush)")
def plateau_fraction(spark, d):
    """How far from its centre each stamp still has full weight."""
    s = A.stamps(spark, d).join(F.broadcast(A.brush_profiles(spark)), "brush")
    return s.select("seq", F.round(ST.plateau_share(F.col("w")) * F.col("scale_x"), 9).alias("reach"))


@query("render_fold", f"WITH {RENDER} SELECT row, col, round(h, 6) AS h FROM render")
def render_fold(spark, d):
    return ST.render(GRID, A.stamps(spark, d), A.brush_profiles(spark)).select("row", "col", r6("h").alias("h"))


def cell_hits(spark: SparkSession, d: str) -> DataFrame:
    cells = GRID.cells(spark).withColumns({"x": GRID.centre_x(F.col("col")), "z": GRID.centre_z(F.col("row"))})
    return ST.effects(cells, A.stamps(spark, d), A.brush_profiles(spark), ["row", "col"])


@query("render_affine_partials", f"WITH {HITS}, b AS (SELECT row, col, seq // 100 AS blk, list_reduce(list({{'a': CASE WHEN tool = 1 THEN 1.0::DOUBLE ELSE 1 - w END, 'b': value * w}} ORDER BY seq), lambda p, q: {{'a': p.a * q.a, 'b': p.b * q.a + q.b}}) AS m FROM hits GROUP BY 1, 2, 3) SELECT row, col, blk::INT AS blk, round(m.a, 6) AS a, round(m.b, 6) AS b FROM b")
def render_affine_partials(spark, d):
    return ST.affine_blocks(cell_hits(spark, d), ["row", "col"], 100).select("row", "col", "blk", r6("a").alias("a"), r6("b").alias("b"))


@query("render_composed", f"WITH {RENDER} SELECT row, col, round(h, 5) AS h FROM render")
def render_composed(spark, d):
    return ST.render(GRID, A.stamps(spark, d), A.brush_profiles(spark), block=1000).select("row", "col", r6("h", 5).alias("h"))


@query("stamp_influence_max", f"WITH {HITS} SELECT row, col, round(max(w), 6) AS w FROM hits WHERE layer = 1 GROUP BY 1, 2")
def stamp_influence_max(spark, d):
    return ST.influence(GRID, A.stamps(spark, d).where("layer = 1"), A.brush_profiles(spark)).select("row", "col", r6("w").alias("w"))


@query("normalize_shift", f"WITH {RENDER} SELECT seq, round(value - (SELECT min(h) FROM render), 6) AS value FROM stamps")
def normalize_shift(spark, d):
    s = A.stamps(spark, d)
    return ST.shifted_to_zero(ST.render(GRID, s, A.brush_profiles(spark)), s).select("seq", r6("value").alias("value"))


@query("stamp_export_struct", f"WITH {STAMPS} SELECT seq, tool::INT AS tool, round(x - 1000, 3) AS pos_x, '-Infinity' AS pos_y, round(z - 1000, 3) AS pos_z, round(rotation, 3) AS yaw, round(scale_x, 3) AS size_x, round(scale_z, 3) AS size_z, brush::INT AS type, round(value, 3) AS value, -1 AS hole_id FROM stamps")
def stamp_export_struct(spark, d):
    e = ST.exported(A.stamps(spark, d))
    return e.select("seq", "entry.tool", F.col("entry.position.x").alias("pos_x"), F.col("entry.position.y").alias("pos_y"), F.col("entry.position.z").alias("pos_z"), F.col("entry.rotation.y").alias("yaw"), F.col("entry.scale.x").alias("size_x"), F.col("entry.scale.z").alias("size_z"), "entry.type", "entry.value", F.col("entry.holeId").alias("hole_id"))


@query("brush_adjust", f"WITH {STAMPS} SELECT seq, CASE WHEN brush = 73 THEN rotation + 90 ELSE rotation END AS rotation, CASE WHEN brush = 73 THEN scale_z * 3 ELSE scale_x END AS scale_x, CASE WHEN brush = 73 THEN scale_x ELSE scale_z END AS scale_z FROM stamps")
def brush_adjust(spark, d):
    return ST.adjusted(A.stamps(spark, d), {73: 90.0}, {73: (3.0, 1.0)}).select("seq", "rotation", "scale_x", "scale_z")


@query("planar_fit", f"WITH {POINTS}, b AS (SELECT floor(x / 100)::INT * 100 + floor(z / 100)::INT AS tile, x, z, elevation AS h FROM points), s AS (SELECT tile, count(*) AS n, covar_pop(x, x) AS xx, covar_pop(z, z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, h) AS xh, covar_pop(z, h) AS zh, covar_pop(h, h) AS hh FROM b GROUP BY tile) SELECT tile, n, round(CASE WHEN n < 3 OR xx * zz - xz * xz <= 0 THEN 0 ELSE sqrt(greatest(hh - (xh * xh * zz - 2 * xh * zh * xz + zh * zh * xx) / (xx * zz - xz * xz), 0)) END, 5) AS rms FROM s")
def planar_fit(spark, d):
    p = A.points(spark, d).withColumn("tile", F.floor(F.col("x") / 100).cast("int") * 100 + F.floor(F.col("z") / 100).cast("int"))
    return ST.plane_fit_rms(p.withColumnRenamed("elevation", "h"), "tile").select("tile", "n", r6("rms", 5).alias("rms"))


@query("candidate_score", f"""WITH {GROUND}, {BRUSHES}, hot AS (SELECT s_suppkey AS hotspot, (s_suppkey * 7919 % 200000)::DOUBLE / 100.0 AS hx, (s_suppkey * 6271 % 200000)::DOUBLE / 100.0 AS hz FROM supplier),
s AS (SELECT hotspot, hx, hz, h AS actual, 250.0::DOUBLE AS current, sqrt(pow((col + 0.5) * 20 - hx, 2) + pow((row + 0.5) * 20 - hz, 2)) AS dist FROM hot JOIN ground ON pow((col + 0.5) * 20 - hx, 2) + pow((row + 0.5) * 20 - hz, 2) <= 60 * 60),
t AS (SELECT hotspot, avg(actual) AS target FROM s GROUP BY 1), c AS (SELECT s.*, brush, plateau, tool, place, CASE WHEN tool = 1 THEN target - 250 ELSE target END AS value, least(dist / 60, 1) AS r FROM s JOIN t USING (hotspot), (SELECT *, list_position([8, 9, 10, 54], brush) AS place FROM brushes WHERE brush IN (8, 9, 10, 54)), (VALUES (0), (1)) k(tool)),
w AS (SELECT *, {WEIGHT} AS w FROM c), a AS (SELECT hotspot, brush, tool, place, value, sqrt(avg(pow(CASE WHEN tool = 1 THEN current + value * w ELSE current + (value - current) * w END - actual, 2))) AS rms FROM w GROUP BY ALL)
SELECT hotspot, brush::INT AS brush, tool::INT AS tool, round(value, 6) AS value, round(rms, 6) AS rms FROM a QUALIFY row_number() OVER (PARTITION BY hotspot ORDER BY round(rms, 9), place, tool) = 1""")
def candidate_score(spark, d):
    k = F.col("s_suppkey")
    hot = A.table(spark, d, "supplier").select(k.alias("hotspot"), ((k * 7919 % 200000) / 100.0).alias("x"), ((k * 6271 % 200000) / 100.0).alias("z"), F.lit(60.0).alias("radius"), F.lit(250.0).alias("current"))
    near = GR.circle_cells(hot.select("hotspot", "x", "z"), ground(spark, d), GRID, F.lit(60.0))
    samples = near.select("hotspot", GRID.centre_x(F.col("col")).alias("x"), GRID.centre_z(F.col("row")).alias("z"), F.col("h").alias("actual"), F.lit(250.0).alias("current"))
    return ST.candidate_scores(samples, hot, A.brush_profiles(spark)).select("hotspot", "brush", "tool", r6("value").alias("value"), r6("rms").alias("rms"))


# -- features


@query("way_classify", """WITH t AS (SELECT p_partkey AS k, p_size AS s, p_partkey // 16 AS q FROM part),
g AS (SELECT *, k % 16 AS b, s % 2 = 0 AS area, s % 5 = 0 AS cart, s % 7 = 0 AS nofoot, s % 3 = 0 AS drive,
  (['green','tee','bunker','fairway','driving_range','rough','water_hazard','lateral_water_hazard','cartpath','path','clubhouse','hole','pin'])[q % 13 + 1] AS golf,
  (['service','residential','footway','cycleway','path','proposed','tertiary','track','steps'])[q % 9 + 1] AS hw, (['wood','water','fell','sand','heath'])[q % 5 + 1] AS nat FROM t),
c AS (SELECT k, CASE WHEN b <= 3 THEN CASE WHEN golf IN ('green','tee','bunker','fairway','rough','cartpath','path','hole') THEN golf WHEN golf = 'driving_range' THEN 'fairway' WHEN golf LIKE '%water_hazard' THEN 'water' WHEN golf = 'clubhouse' THEN 'building' END
  WHEN b IN (4, 5) AND hw <> 'proposed' THEN CASE WHEN cart THEN 'cartpath' WHEN hw = 'service' AND drive THEN 'driveway' WHEN hw = 'service' THEN 'service_road' WHEN hw IN ('residential', 'tertiary') THEN 'roadway' WHEN NOT nofoot THEN 'path' END
  WHEN b = 6 THEN CASE nat WHEN 'wood' THEN 'wood' WHEN 'water' THEN 'water' WHEN 'fell' THEN 'mulch' END WHEN b = 7 THEN 'water' WHEN b = 8 THEN 'building' WHEN b = 9 AND k % 32 < 16 THEN 'mulch'
  WHEN b = 10 THEN CASE WHEN cart THEN 'cartpath' ELSE 'pavement' END WHEN b = 11 THEN 'heavyrough' WHEN b = 12 THEN 'vegetation' WHEN b = 13 THEN 'pavement' END AS kind,
  CASE WHEN b <= 3 AND golf IN ('cartpath', 'path') THEN area WHEN b <= 3 THEN golf <> 'hole' WHEN b IN (4, 5, 7) THEN area ELSE TRUE END AS is_area FROM g)
SELECT k AS osm_id, kind, CASE WHEN kind IS NOT NULL THEN is_area END AS is_area, kind NOT IN ('fairway', 'green', 'tee', 'hole') AS mask FROM c""")
def way_classify(spark, d):
    return FE.classified(A.way_tags(spark, d)).select("osm_id", "kind", "is_area", "mask")


@query("feature_counts", f"SELECT kind, count(*) AS n FROM ({SQL['way_classify']}) WHERE kind IS NOT NULL GROUP BY kind")
def feature_counts(spark, d):
    return FE.kind_counts(FE.classified(A.way_tags(spark, d)))


@query("mask_toggle", f"WITH f AS ({SQL['way_classify']}) SELECT osm_id, CASE WHEN kind IN ('green', 'water') THEN NOT (SELECT coalesce(bool_and(mask), FALSE) FROM f WHERE kind IN ('green', 'water')) ELSE mask END AS mask FROM f")
def mask_toggle(spark, d):
    f = FE.classified(A.way_tags(spark, d))
    return FE.toggled(f, F.coalesce(F.col("kind").isin("green", "water"), F.lit(False))).select("osm_id", "mask")


@query("way_node_assembly", "WITH w AS (SELECT o_orderkey AS way, i, (o_orderkey * 3 + i) % 5000 AS node FROM orders, range(5) t(i) WHERE i < o_orderkey % 4 + 2), n AS (SELECT c_custkey AS node FROM customer), a AS (SELECT way, count(*) AS n, count(n.node) AS has, sum(i * w.node) AS sig FROM w LEFT JOIN n USING (node) GROUP BY way) SELECT way AS osm_id, n, sig::BIGINT AS sig FROM a WHERE n = has")
def way_node_assembly(spark, d):
    k = F.col("o_orderkey")
    ways = A.table(spark, d, "orders").select(k.alias("osm_id"), F.transform(F.sequence(F.lit(0).cast("long"), k % 4 + 1), lambda i: (k * 3 + i) % 5000).alias("node_ids"))
    nodes = A.table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_custkey").cast("double").alias("x"), F.lit(0.0).alias("z"))
    sig = F.aggregate(F.transform("pts", lambda p, i: p["x"] * i), F.lit(0.0), lambda a, v: a + v).cast("long")
    return FE.assembled(ways, nodes).select("osm_id", F.size("pts").cast("long").alias("n"), sig.alias("sig"))


@query("clip_area", f"WITH {POLYGONS} SELECT poly, round(2 * rad * rad, 5) AS area FROM polygons WHERE cx - rad >= 200 AND cx + rad <= 1800 AND cz - rad >= 200 AND cz + rad <= 1800")
def clip_area(spark, d):
    p = A.polygons(spark, d).withColumn("full", SP.ring_area(F.col("ring")))
    c = FE.clipped_rings(p, (200.0, 200.0, 1800.0, 1800.0)).withColumn("area", SP.ring_area(F.col("ring")))
    return c.where(F.abs(F.col("area") - F.col("full")) < 1e-6).select("poly", r6("area", 5).alias("area"))


#: The area of a diamond left of x = a and below z = b about its centre is a sum of integrals over its columns, whose closed form is g; the box takes four of them.
def _column_area(t: str) -> str:
    m = f"least({t}, greatest(0, least(rad, rad - abs(b))))"
    return f"((b + rad) * {m} - {m} * {m} / 2 + CASE WHEN b >= 0 THEN 2 * rad * ({t} - {m}) - ({t} * {t} - {m} * {m}) ELSE 0 END)"


CLIPPED = f"""corners AS (SELECT poly, rad, cx, cz, x - cx AS a, z - cz AS b, sign FROM polygons, (VALUES (1800.0::DOUBLE, 1800.0::DOUBLE, 1), (200, 1800, -1), (1800, 200, -1), (200, 200, 1)) v(x, z, sign)),
q AS (SELECT poly, sign, {_column_area('rad')} AS half, {_column_area('least(abs(a), rad)')} AS part, a FROM corners), areas AS (SELECT poly, sum(sign * CASE WHEN a >= 0 THEN half + part ELSE half - part END) AS area FROM q GROUP BY poly)"""


@query("clipped_areas", f"WITH {POLYGONS}, {CLIPPED} SELECT poly, round(area, 5) AS area FROM areas WHERE area > 1e-6")
def clipped_areas(spark, d):
    """All polygons that reach into the box, those the box cuts too."""
    c = FE.clipped_rings(A.polygons(spark, d), (200.0, 200.0, 1800.0, 1800.0))
    return c.select("poly", r6(SP.ring_area(F.col("ring")), 5).alias("area"))


@query("point_in_polygon", f"WITH {TREES}, {POLYGONS} SELECT tree, poly FROM ({inside_sql('trees', 'tree')})")
def point_in_polygon(spark, d):
    return SP.in_polygons(A.trees(spark, d), A.polygons(spark, d), "tree")


@query("buffer_mask", f"WITH {TREES}, {POLYGONS}, e AS (SELECT poly, x1, z1, x2, z2 FROM edges), n AS ({near_sql('trees', 'e', 'p.tree, s.poly', 12.0)}) SELECT tree, poly FROM ({inside_sql('trees', 'tree')}) UNION SELECT tree, poly FROM n")
def buffer_mask(spark, d):
    return SP.within_buffer(A.trees(spark, d), A.polygons(spark, d), "tree", 12.0)


@query("inward_buffer", f"WITH {TREES}, {POLYGONS}, e AS (SELECT poly, x1, z1, x2, z2 FROM edges), n AS ({near_sql('trees', 'e', 'p.tree, s.poly', 4.0)}) SELECT tree, poly FROM ({inside_sql('trees', 'tree')}) EXCEPT SELECT tree, poly FROM n")
def inward_buffer(spark, d):
    return SP.within_buffer(A.trees(spark, d), A.polygons(spark, d), "tree", -4.0)


@query("mask_cells", f"WITH {POLYGONS}, c AS (SELECT i AS id, (i // 100)::INT AS row, (i % 100)::INT AS col, (i % 100 + 0.5::DOUBLE) * 20 AS x, (i // 100 + 0.5::DOUBLE) * 20 AS z FROM range(10000) t(i)) SELECT DISTINCT row, col FROM c JOIN ({inside_sql('c', 'id')}) USING (id)")
def mask_cells(spark, d):
    cells = GRID.cells(spark).withColumns({"x": GRID.centre_x(F.col("col")), "z": GRID.centre_z(F.col("row")), "cell": F.struct("row", "col")})
    return SP.in_polygons(cells, A.polygons(spark, d), "cell").select("cell.row", "cell.col").distinct()


@query("nearest_path_distance", f"WITH {TREES}, {PATHS}, n AS ({near_sql('trees', 'segs', 'p.tree, s.path', 100.0)}) SELECT tree, path, round(distance, 6) AS distance FROM n QUALIFY row_number() OVER (PARTITION BY tree ORDER BY distance, path) = 1")
def nearest_path_distance(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("path").orderBy("i")
    seg = A.paths(spark, d).select("path", F.col("x").alias("x1"), F.col("z").alias("z1"), F.lead("x").over(w).alias("x2"), F.lead("z").over(w).alias("z2")).where("x2 IS NOT NULL")
    return SP.nearest_segment(A.trees(spark, d), seg, "tree", "path", 100.0).select("tree", "path", r6("distance").alias("distance"))


@query("tree_type_hint_join", f"WITH {TREES}, {POLYGONS}, h AS (SELECT tree, min(poly) AS poly FROM ({inside_sql('trees', 'tree')}) WHERE kind = 'wood' AND poly % 8 = 1 GROUP BY tree) SELECT tree, coalesce(type_tag, CASE WHEN h.poly IS NOT NULL THEN 'pine' END) AS tree_type FROM trees LEFT JOIN h USING (tree)")
def tree_type_hint_join(spark, d):
    woods = A.polygons(spark, d).where("kind = 'wood'").withColumn("hint", F.when(F.col("poly") % 8 == 1, OB.LEAF_HINTS["needleleaved"]))
    return OB.hinted_trees(A.trees(spark, d), woods).select("tree", F.col("tags")[OB.TYPE].alias("tree_type"))


@query("tree_scale", f"WITH {TREES}, h AS (SELECT tree, coalesce(TRY_CAST(height_tag AS DOUBLE), 10) AS height FROM trees), m AS (SELECT min(height) AS a, max(height) AS b FROM h) SELECT tree, height, round(CASE WHEN b - a > 0.01 THEN (height - a) * (0.7 / (b - a)) + 0.5 ELSE 1 END, 6) AS scale FROM h, m")
def tree_scale(spark, d):
    return OB.tree_scales(A.trees(spark, d)).select("tree", "height", r6("scale").alias("scale"))


@query("object_group_merge", f"WITH {TREES} SELECT CASE WHEN type_tag = 'conifer' THEN 1 ELSE 0 END AS category, (tree % 7)::INT AS type, count(*) AS n, round(sum(x), 4) AS sum_x FROM trees GROUP BY 1, 2")
def object_group_merge(spark, d):
    rows = A.trees(spark, d).select("tree", F.when(F.col("tags")[OB.TYPE] == "conifer", 1).otherwise(0).alias("category"), (F.col("tree") % 7).cast("int").alias("type"), "x", "z")
    g = OB.merged_groups(rows, ["category", "type"], F.struct("x", "z"), "tree")
    return g.select("category", "type", "n", r6(F.aggregate("items", F.lit(0.0), lambda a, i: a + i["x"]), 4).alias("sum_x"))


@query("cluster_fill_rows", "SELECT category, type, ratio, source, array_to_string(list_sort(list_distinct(list(osm_id))), ', ') AS ids FROM (SELECT p_partkey % 500 AS osm_id, (p_size % 4)::INT AS category, (p_size % 3)::INT AS type, (p_size % 2 + 1)::DOUBLE AS ratio, p_brand AS source FROM part) GROUP BY ALL")
def cluster_fill_rows(spark, d):
    p = A.table(spark, d, "part").select((F.col("p_partkey") % 500).alias("osm_id"), (F.col("p_size") % 4).cast("int").alias("category"), (F.col("p_size") % 3).cast("int").alias("type"), (F.col("p_size") % 2 + 1).cast("double").alias("ratio"), F.col("p_brand").alias("source"))
    return OB.fill_rows(p)


@query("cluster_count_fn", "SELECT s_suppkey AS k, greatest(1, round_even(pi() * pow((5 + s_suppkey % 20) / (1 + s_suppkey % 3), 2), 0))::INT AS n FROM supplier")
def cluster_count_fn(spark, d):
    k = F.col("s_suppkey")
    return A.table(spark, d, "supplier").select(k.alias("k"), G.cluster_count(k % 20 + 5, k % 3 + 1).alias("n"))


HOLES = "holes AS (SELECT o_orderkey AS seq, CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey % 20)::INT END AS ref, TRY_CAST(substring(o_orderpriority, 1, 1) AS INT) AS par, o_orderkey % 5 + 1 AS n FROM orders)"


@query("hole_waypoints", f"WITH {HOLES}, p AS (SELECT *, (seq % 1000)::DOUBLE AS x0, (seq % 777)::DOUBLE AS z0 FROM holes WHERE n >= 2) SELECT seq, par, CASE WHEN n = 2 THEN x0 + 5 ELSE x0 + 10 END AS mid_x, CASE WHEN n = 2 THEN z0 + 1.5 ELSE z0 + 3 END AS mid_z, x0 + (n - 1) * 10.0 AS end_x, z0 + (n - 1) * (n - 1) * 3.0 AS end_z FROM p")
def hole_waypoints(spark, d):
    h = OB.hole_waypoints(A.holes(spark, d))
    at = lambda i, c: F.get(F.col("pts"), F.lit(i))[c]
    return h.select("seq", "par", at(1, "x").alias("mid_x"), at(1, "z").alias("mid_z"), at(2, "x").alias("end_x"), at(2, "z").alias("end_z"))


@query("hole_order", f"""WITH RECURSIVE {HOLES}, h AS (SELECT seq, coalesce(ref, -1) AS ref, par FROM holes WHERE n >= 2), ev AS (SELECT row_number() OVER (ORDER BY seq) AS i, seq, ref FROM (SELECT min(seq) AS seq, ref FROM h WHERE ref <> 0 GROUP BY ref UNION ALL SELECT seq, ref FROM h WHERE ref = 0)),
go AS (SELECT 0::BIGINT AS i, []::INT[] AS known, NULL::INT AS hole UNION ALL SELECT i, CASE WHEN list_contains(known, x) THEN known ELSE list_append(known, x) END, x FROM (SELECT ev.i, known, CASE WHEN ref = 0 THEN len(known) + 1 ELSE ref END::INT AS x FROM go JOIN ev ON ev.i = go.i + 1)),
every AS (SELECT seq, ref AS hole, par FROM h WHERE ref <> 0 UNION ALL SELECT h.seq, go.hole, par FROM h JOIN ev USING (seq) JOIN go USING (i) WHERE h.ref = 0)
SELECT hole, max(seq) AS seq, max_by(struct_pack(p := par), seq).p AS par FROM every GROUP BY hole""")
def hole_order(spark, d):
    return OB.ordered_holes(A.holes(spark, d)).select("hole", "seq", "par")


@query("hole_order_numbered", f"WITH {HOLES} SELECT coalesce(ref, -1) AS hole, max(seq) AS seq FROM holes WHERE n >= 2 AND ref IS DISTINCT FROM 0 GROUP BY 1")
def hole_order_numbered(spark, d):
    return OB.ordered_holes(A.holes(spark, d).where("ref IS NULL OR ref <> 0")).select("hole", "seq")


@query("water_level_p90", f"WITH {TREES}, {POLYGONS}, s AS (SELECT tree, x, z, coalesce(TRY_CAST(height_tag AS DOUBLE), 10) AS h FROM trees), i AS (SELECT poly, s.h FROM ({inside_sql('trees', 'tree')}) q JOIN s USING (tree) WHERE kind = 'water') SELECT g.poly, count(i.h) AS n, round(quantile_cont(i.h, 0.9), 6) AS level FROM polygons g LEFT JOIN i USING (poly) WHERE kind = 'water' GROUP BY 1")
def water_level_p90(spark, d):
    sites = OB.tree_heights(A.trees(spark, d)).select(F.col("tree").alias("site"), "x", "z", F.col("height").alias("h"))
    return OB.water_levels(A.polygons(spark, d).where("kind = 'water'"), sites).select("poly", "n", r6("level").alias("level"))


@query("bezier_points", f"""WITH {PATHS}, w AS (SELECT path, i, x, z FROM paths), s AS (SELECT a.path, a.i, a.x AS x0, a.z AS z0, a.x + 10 AS x1, a.z + 4 AS z1, b.x - 10 AS x2, b.z + 4 AS z2, b.x AS x3, b.z AS z3 FROM w a JOIN w b ON a.path = b.path AND b.i = a.i + 1),
n AS (SELECT *, greatest(8, trunc(sqrt(pow(x1 - x0, 2) + pow(z1 - z0, 2)) + sqrt(pow(x2 - x1, 2) + pow(z2 - z1, 2)) + sqrt(pow(x3 - x2, 2) + pow(z3 - z2, 2)))::INT) AS n FROM s),
p AS (SELECT *, k, k / n::DOUBLE AS t FROM n, LATERAL (SELECT unnest(range(n + CASE WHEN i = 2 THEN 1 ELSE 0 END)) AS k))
SELECT path, i::INT AS i, k::INT AS k, round(pow(1 - t, 3) * x0 + 3 * pow(1 - t, 2) * t * x1 + 3 * (1 - t) * t * t * x2 + t * t * t * x3, 5) AS x, round(pow(1 - t, 3) * z0 + 3 * pow(1 - t, 2) * t * z1 + 3 * (1 - t) * t * t * z2 + t * t * t * z3, 5) AS z FROM p""")
def bezier_points(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("path").orderBy("i")
    p = A.paths(spark, d).withColumns({"nx": F.lead("x").over(w), "nz": F.lead("z").over(w)}).where("nx IS NOT NULL")
    at = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    x, z, nx, nz = (F.col(c) for c in ("x", "z", "nx", "nz"))
    pts = p.select("path", "i", F.posexplode(G.bezier_points(at(x, z), at(x + 10, z + 4), at(nx - 10, nz + 4), at(nx, nz), F.col("i") == 2)).alias("k", "p"))
    return pts.select("path", "i", "k", r6("p.x", 5).alias("x"), r6("p.z", 5).alias("z"))


@query("spline_waypoints", f"""WITH {POLYGONS}, r AS (SELECT poly, rad, cx, cz, k, dx, dz FROM polygons, (VALUES (0, 1, 0), (1, 0, 1), (2, -1, 0), (3, 0, -1)) v(k, dx, dz) WHERE kind = 'bunker'),
q AS (SELECT poly, k, dx, dz, cx + dx * rad - 1000 AS x, cz + dz * rad - 1000 AS z FROM r) SELECT poly AS osm_id, k::INT AS k, round(x - dx * 0.005, 3) AS x, round(z - dz * 0.005, 3) AS z FROM q""")
def spline_waypoints(spark, d):
    f = A.polygons(spark, d).where("kind = 'bunker'").select(F.col("poly").alias("osm_id"), "kind", F.col("ring").alias("pts"))
    w = OB.splines(f).select("osm_id", F.posexplode("points").alias("k", "w"))
    return w.select("osm_id", "k", F.col("w.waypoint.x").alias("x"), F.col("w.waypoint.y").alias("z"))


@query("ring_shape", f"WITH {POLYGONS} SELECT poly, round(2 * rad * rad, 5) AS area, FALSE AS clockwise FROM polygons")
def ring_shape(spark, d):
    return A.polygons(spark, d).select("poly", r6(SP.ring_area(F.col("ring")), 5).alias("area"), G.is_clockwise(F.col("ring")).alias("clockwise"))


PEARLS = f"""{PATHS}, l AS (SELECT *, sqrt(pow(x2 - x1, 2) + pow(z2 - z1, 2)) AS len FROM segs), c AS (SELECT *, sum(len) OVER (PARTITION BY path ORDER BY i) AS stop FROM l), b AS (SELECT *, stop - len AS start FROM c), t AS (SELECT path, max(stop) AS total, greatest(2, floor(max(stop) / 10)::INT + 1) AS n FROM c GROUP BY path),
s AS (SELECT path, k, n, total * k / (n - 1) AS d FROM t, LATERAL (SELECT unnest(range(n)) AS k)), m AS (SELECT s.path, s.k, x1 + (x2 - x1) * (d - start) / len AS x, z1 + (z2 - z1) * (d - start) / len AS z FROM s JOIN b ON b.path = s.path AND d >= start AND d <= stop + 1e-9 QUALIFY row_number() OVER (PARTITION BY s.path, s.k ORDER BY start DESC) = 1),
pearls AS (SELECT *, degrees(atan2(lead(x) OVER w - x, lead(z) OVER w - z)) AS yaw FROM m WINDOW w AS (PARTITION BY path ORDER BY k))"""


@query("cart_pearls", f"WITH {PEARLS} SELECT path, k::INT AS k, round(x, 5) AS x, round(z, 5) AS z, round(yaw, 4) AS yaw FROM pearls")
def cart_pearls(spark, d):
    return OB.pearls(A.paths(spark, d), 10.0).select("path", "k", r6("x", 5).alias("x"), r6("z", 5).alias("z"), r6("yaw", 4).alias("yaw"))


@query("cart_path_stamps", f"WITH {GROUND}, {PEARLS} SELECT path, k::INT AS k, round(any_value(x), 5) AS x, round(any_value(z), 5) AS z, round(avg(h), 5) AS value, round(any_value(yaw), 4) AS rotation FROM pearls JOIN ground ON pow((col + 0.5) * 20 - x, 2) + pow((row + 0.5) * 20 - z, 2) <= 25 * 25 WHERE yaw IS NOT NULL GROUP BY path, k")
def cart_path_stamps(spark, d):
    s = OB.cart_path_stamps(A.paths(spark, d), ground(spark, d), GRID, 10.0, 6.0, 25.0)
    return s.select("path", "k", r6("x", 5).alias("x"), r6("z", 5).alias("z"), r6("value", 5).alias("value"), r6("rotation", 4).alias("rotation"))


# -- layers


LOG = "log AS (SELECT (event_id % 12)::INT + CASE WHEN event_id % 12 >= 9 THEN 2 ELSE 1 END AS layer, event_id AS idx, event_type AS step, value FROM events)"


@query("latest_layer", f"WITH {LOG} SELECT layer, step, round(value, 6) AS value FROM log ORDER BY layer DESC, idx DESC LIMIT 1")
def latest_layer(spark, d):
    from ..streaming.layers import latest

    return latest(A.layer_log(spark, d)).select("layer", "step", r6("value").alias("value"))


@query("layer_union", f"WITH {LOG}, g AS (SELECT layer, row_number() OVER (ORDER BY layer) AS k FROM (SELECT DISTINCT layer FROM log)) SELECT layer, idx, step FROM log WHERE layer IN (SELECT layer FROM g WHERE layer = k)")
def layer_union(spark, d):
    from ..streaming.layers import without_gap

    return without_gap(A.layer_log(spark, d)).select("layer", "idx", "step")


# -- kernels: no SQL; tests hold them against brute force and their invariants


TILE = GR.Grid(rows=50, cols=50, max_x=1000.0, max_z=1000.0)


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """Rasters of 50 x 50 cells of 20 m, one per quarter of the ground, in their own frame, with the ground's own gaps."""
    row, col = F.col("row"), F.col("col")
    return ground(spark, d).select((F.floor(row / 50) * 2 + F.floor(col / 50)).cast("int").alias("raster"), (row % 50).alias("row"), (col % 50).alias("col"), "h")


@query("tree_detect")
def tree_detect(spark, d):
    """Crowns of the whole ground in cells of 10 m: the highest vegetation over the mean ground; raster is the square of 500 m they stand in."""
    grid, at = GR.Grid(rows=200, cols=200), A.points(spark, d)
    found = CR.trees(GR.ground(at, grid, (2,)), GR.canopy(at, grid), grid, outlier=500.0, tile=64)
    return found.select((F.floor(F.col("z") / 500) * 4 + F.floor(F.col("x") / 500)).cast("int").alias("raster"), "x", "z", "radius", "height")


@query("scatter_refine")
def scatter_refine(spark, d):
    return RA.scattered(tiles(spark, d), TILE, 60.0)


@query("rect_fill")
def rect_fill(spark, d):
    return RA.rectangles(tiles(spark, d), TILE)


#: One stamp after the other, the newest first; rows of t: what is left of a cell, at -1 how many stamps are done, below whether a stamp is gone.
PRUNE = f"""{HITS}, h AS MATERIALIZED (SELECT seq, (row * 100 + col)::BIGINT AS id, w FROM hits), ord AS MATERIALIZED (SELECT seq, tool, row_number() OVER (ORDER BY seq DESC) AS k FROM stamps),
t(id, v) USING KEY (id) AS (SELECT DISTINCT id, 1.0::DOUBLE FROM h UNION ALL SELECT -1, 0.0::DOUBLE
  UNION (WITH st AS (SELECT ord.* FROM ord JOIN t ON t.id = -1 AND ord.k = t.v::BIGINT + 1), own AS (SELECT st.seq, h.id, h.w, r.v FROM st JOIN h ON h.seq = st.seq JOIN recurring.t r ON r.id = h.id),
    dec AS (SELECT st.k, st.seq, st.tool, coalesce((SELECT bool_and(v <= 1e-3) FROM own WHERE w > 1e-3), FALSE) AS gone FROM st)
    SELECT -1, k::DOUBLE FROM dec UNION ALL SELECT -10 - seq, gone::INT::DOUBLE FROM dec UNION ALL SELECT own.id, own.v * (1 - own.w) FROM own, dec WHERE NOT gone AND tool = 0))"""


@query("prune_stamps", f"WITH RECURSIVE {PRUNE} SELECT -10 - id AS seq, v = 0 AS keep FROM t WHERE id <= -10")
def prune_stamps(spark, d):
    return PR.pruned(A.stamps(spark, d), cell_hits(spark, d))


@query("tree_relocate")
def tree_relocate(spark, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("path").orderBy("i")
    seg = A.paths(spark, d).select("path", F.col("x").alias("x1"), F.col("z").alias("z1"), F.lead("x").over(w).alias("x2"), F.lead("z").over(w).alias("z2")).where("x2 IS NOT NULL")
    return OB.relocated(A.trees(spark, d), seg)


@query("cluster_pack")
def cluster_pack(spark, d):
    return RA.packed_circles(A.polygons(spark, d), 8.0)


from . import compositing, packing, placement, refinement, tiling  # noqa: E402, F401  add their queries
