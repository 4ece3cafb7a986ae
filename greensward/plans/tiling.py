"""Queries of the operators in operators.tiled over the whole ground, with their SQL. Tiles are small here, so that several meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import outlines as OU
from ..operators import tiled as TI
from . import catalog as C

TILE = 32


def labels_sql(mask: str) -> str:
    """WITH clauses from a mask (row, col): labels (place, label), by the smallest place among neighbours, until none changes."""
    return f"""m AS ({mask}), cells AS (SELECT (row * 100 + col)::INT AS place, row, col FROM m),
  adj AS (SELECT a.place AS a, b.place AS b FROM cells a JOIN (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) v(dr, dc) ON TRUE JOIN cells b ON b.row = a.row + dr AND b.col = a.col + dc),
  lab(place, label) USING KEY (place) AS (SELECT place, place FROM cells
    UNION SELECT adj.b, min(lab.label) FROM lab JOIN adj ON adj.a = lab.place JOIN recurring.lab old ON old.place = adj.b WHERE lab.label < old.label GROUP BY adj.b)"""


HIGH = "SELECT row, col FROM ground WHERE h > 310"


@C.query("components", f"WITH RECURSIVE {C.GROUND}, {labels_sql(HIGH)} SELECT (place // 100)::INT AS row, (place % 100)::INT AS col, (label + 1)::BIGINT AS label FROM lab")
def components(spark, d):
    return TI.components(C.ground(spark, d).where("h > 310"), C.GRID, TILE)


GROWN = """g1 AS (SELECT DISTINCT a.row + o.o AS row, a.col + p.o AS col FROM high a, (VALUES (-1), (0), (1)) o(o), (VALUES (-1), (0), (1)) p(o)),
  g2 AS (SELECT a.row + o.o AS row, a.col + p.o AS col FROM g1 a, (VALUES (-1), (0), (1)) o(o), (VALUES (-1), (0), (1)) p(o) GROUP BY 1, 2 HAVING count(*) = 9),
  inside AS (SELECT row::INT AS row, col::INT AS col FROM g2 WHERE row BETWEEN 0 AND 99 AND col BETWEEN 0 AND 99)"""


@C.query("denoised_mask", f"WITH RECURSIVE {C.GROUND}, high AS ({HIGH}), {GROWN}, {labels_sql('SELECT row, col FROM inside')}, s AS (SELECT place, count(*) OVER (PARTITION BY label) AS n FROM lab) SELECT (place // 100)::INT AS row, (place % 100)::INT AS col FROM s WHERE n >= 4")
def denoised_mask(spark, d):
    return TI.denoised(C.ground(spark, d).where("h > 310"), C.GRID, 1, TILE)


CELLS = "cells AS (SELECT (i // 100)::INT AS row, (i % 100)::INT AS col FROM range(10000) t(i))"


@C.query("edt", f"WITH {C.GROUND}, {CELLS}, empty AS (SELECT * FROM cells ANTI JOIN ground USING (row, col)) SELECT g.row, g.col, round(sqrt(min(pow((g.row - e.row) * 20.0::DOUBLE, 2) + pow((g.col - e.col) * 20.0::DOUBLE, 2))), 6) AS d FROM ground g LEFT JOIN empty e ON TRUE GROUP BY 1, 2")
def edt(spark, d):
    return TI.distances(C.ground(spark, d), C.GRID).select("row", "col", C.r6("d").alias("d"))


@C.query("nearest_fill", f"WITH {C.GROUND}, {CELLS}, n AS (SELECT c.row, c.col, min_by(g.h, struct_pack(d := (c.row - g.row) * (c.row - g.row) + (c.col - g.col) * (c.col - g.col), r := g.row, c := g.col)) AS h, min((c.row - g.row) * (c.row - g.row) + (c.col - g.col) * (c.col - g.col)) AS d FROM cells c, ground g GROUP BY 1, 2) SELECT row, col, CASE WHEN d * 400 <= 30 * 30 THEN round(h, 6) END AS h, d = 0 AS known FROM n")
def nearest_fill(spark, d):
    return TI.nearest_filled(C.ground(spark, d), C.GRID, 30.0).select("row", "col", C.r6("h").alias("h"), "known")


#: The heights that settle are those of one system of equations, whatever they start from; 400 rounds from the mean come close enough for 3 decimals.
SETTLED = f"""{C.GROUND}, {CELLS}, mean AS (SELECT avg(h) AS m FROM ground), start AS (SELECT row, col, h IS NOT NULL AS known, coalesce(h, m) AS h FROM cells LEFT JOIN ground USING (row, col), mean),
  j AS (SELECT 0 AS k, row, col, known, h FROM start UNION ALL SELECT k + 1, row, col, known, CASE WHEN known THEN h ELSE (coalesce(lag(h) OVER u, h) + coalesce(lead(h) OVER u, h) + coalesce(lag(h) OVER a, h) + coalesce(lead(h) OVER a, h)) / 4 END
    FROM j WHERE k < 400 WINDOW a AS (PARTITION BY row ORDER BY col), u AS (PARTITION BY col ORDER BY row))"""


@C.query("gap_fill", f"WITH RECURSIVE {SETTLED} SELECT row, col, round(h + 0.000017::DOUBLE, 3) AS h, known FROM j WHERE k = 400")
def gap_fill(spark, d):
    out = TI.gap_filled(C.ground(spark, d), C.GRID, rounds=1000, tolerance=1e-8, tile=64, halo=64)
    return out.select("row", "col", F.round(F.col("h") + 0.000017, 3).alias("h"), "known")


#: One move after the other of all regions at once, until a region's first move comes again.
TRACE = f"""{labels_sql(HIGH)}, cell AS MATERIALIZED (SELECT label AS region, (place // 100)::INT AS row, (place % 100)::INT AS col FROM lab),
  way(turn, dr, dc) AS (VALUES (0, 0, -1), (1, -1, -1), (2, -1, 0), (3, -1, 1), (4, 0, 1), (5, 1, 1), (6, 1, 0), (7, 1, -1)),
  go AS (SELECT label AS region, 0::BIGINT AS i, (label // 100)::INT AS row, (label % 100)::INT AS col, 0 AS came, -1 AS t0, FALSE AS over FROM (SELECT DISTINCT label FROM lab)
    UNION ALL SELECT region, i + 1, to_row, to_col, (turn + 4) % 8, CASE WHEN t0 < 0 THEN turn ELSE t0 END, FALSE
      FROM (SELECT go.*, way.turn, c.row AS to_row, c.col AS to_col FROM go, way, cell c WHERE c.region = go.region AND c.row = go.row + way.dr AND c.col = go.col + way.dc
        QUALIFY row_number() OVER (PARTITION BY go.region ORDER BY (way.turn - go.came + 7) % 8) = 1)
      WHERE NOT (i > 0 AND row = region // 100 AND col = region % 100 AND turn = t0))"""


@C.query("outline_trace", f"WITH RECURSIVE {C.GROUND}, {TRACE} SELECT (region + 1)::BIGINT AS region, i, row, col FROM go WHERE i = 0 OR row <> region // 100 OR col <> region % 100")
def outline_trace(spark, d):
    regions = TI.components(C.ground(spark, d).where("h > 310"), C.GRID, TILE).withColumnRenamed("label", "region")
    return OU.traced(regions, C.GRID, "region")


@C.query("outlines")
def outlines(spark, d):
    """Simplified boundaries of the high ground with their holes; tests hold traces and lines against plain loops."""
    return OU.region_rings(C.ground(spark, d).where("h > 310"), C.GRID, 15.0, tile=TILE)
