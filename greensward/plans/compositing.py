"""Queries of brush images, of rectangles along edges, of stamps scattered by density and of numbers of candidates, with their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compositing as CO
from ..operators import fallline as FL
from ..operators import grid as GR
from ..operators import raster as RA
from ..sources import adapters as A
from . import catalog as C

#: Stamps and cells, the four pixels about each cell's place in the image, and the weight between them.
CANVAS = f"""{C.STAMPS}, {C.BRUSHES}, img AS (SELECT brush, r::INT AS r, c::INT AS c, floor(255 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (1 - sqrt((r - 7.5::DOUBLE) * (r - 7.5::DOUBLE) + (c - 7.5::DOUBLE) * (c - 7.5::DOUBLE)) / 8) / (1 - plateau)))) AS v FROM brushes, range(16) a(r), range(16) b(c)),
s AS (SELECT *, CASE WHEN rotation <> 0 THEN sqrt(scale_x * scale_x + scale_z * scale_z) ELSE scale_x END AS rx, CASE WHEN rotation <> 0 THEN sqrt(scale_x * scale_x + scale_z * scale_z) ELSE scale_z END AS rz,
  CASE WHEN brush = 54 THEN 0.0625::DOUBLE ELSE 0 END AS ox, CASE WHEN brush = 54 THEN -0.03125::DOUBLE ELSE 0 END AS oz FROM stamps),
cells AS (SELECT (i // 100)::INT AS row, (i % 100)::INT AS col, ((i % 100) + 0.5::DOUBLE) * 20 AS cx, ((i // 100) + 0.5::DOUBLE) * 20 AS cz FROM range(10000) t(i)),
k AS (SELECT row, col, seq, tool, value / 275 * 65535 AS value, brush, 7.5::DOUBLE + (((cx - x) * sin(radians(rotation)) + (cz - z) * cos(radians(rotation))) / scale_z + oz) * 8 AS pr, 7.5::DOUBLE + (((cx - x) * cos(radians(rotation)) - (cz - z) * sin(radians(rotation))) / scale_x + ox) * 8 AS pc
  FROM s JOIN cells ON row >= trunc((z - rz) / 20) AND row <= trunc((z + rz) / 20) AND col >= trunc((x - rx) / 20) AND col <= trunc((x + rx) / 20)),
i AS (SELECT *, least(floor(pr), 14)::INT AS r0, least(floor(pc), 14)::INT AS c0 FROM k WHERE pr BETWEEN 0 AND 15 AND pc BETWEEN 0 AND 15),
w AS (SELECT row, col, seq, tool, value, ((p.v * (1 - (pc - c0)) + q.v * (pc - c0)) * (1 - (pr - r0)) + (t.v * (1 - (pc - c0)) + u.v * (pc - c0)) * (pr - r0)) / 255 AS w FROM i JOIN img p ON p.brush = i.brush AND p.r = r0 AND p.c = c0 JOIN img q ON q.brush = i.brush AND q.r = r0 AND q.c = c0 + 1
  JOIN img t ON t.brush = i.brush AND t.r = r0 + 1 AND t.c = c0 JOIN img u ON u.brush = i.brush AND u.r = r0 + 1 AND u.c = c0 + 1),
canvas AS (SELECT row, col, {C.FOLD} AS h FROM w WHERE w <> 0 GROUP BY row, col)"""


def canvas(spark, d):
    return CO.composite(C.GRID, A.stamps(spark, d), A.brush_images(spark))


@C.query("composite_canvas", f"WITH {CANVAS} SELECT row, col, round(h, 5) AS h FROM canvas")
def composite_canvas(spark, d):
    return canvas(spark, d).select("row", "col", C.r6("h", 5).alias("h"))


@C.query("composite_metres", f"WITH {CANVAS} SELECT row, col, round(least(greatest(round_even(h, 0), 0), 65535) / 65535 * 275, 6) AS h FROM canvas")
def composite_metres(spark, d):
    return canvas(spark, d).select("row", "col", C.r6(CO.in_metres(F.col("h"))).alias("h"))


@C.query("scatter_density")
def scatter_density(spark, d):
    """Stamps thrown where heights vary most, small ones there. No SQL: draws are random; a test holds the shares of draws, radii, values and distances."""
    radii = GR.variation_radius(RA.local_variation(C.ground(spark, d), C.GRID, 2, centred=True), 60.0, 0.25)
    row, col = F.col("row"), F.col("col")
    radii = radii.select((F.floor(row / 50) * 2 + F.floor(col / 50)).cast("int").alias("raster"), (row % 50).alias("row"), (col % 50).alias("col"), "radius")
    return RA.scattered(C.tiles(spark, d), C.TILE, 60.0, radii=radii, density=True)


@C.query("candidate_trials")
def candidate_trials(spark, d):
    """No SQL: packing draws at random; a test holds the numbers against a plain search."""
    return RA.candidate_trials(GR.with_bands(C.ground(spark, d), 10.0), C.GRID)


#: Rectangles of a diamond's edges in closed form: the opposite wall is as far as an edge is long.
RECTANGLES = f"""{C.GROUND}, {C.POLYGONS}, r AS (SELECT poly, k::INT AS i, rad * sqrt(2) AS width, CASE WHEN rad * sqrt(2) <= 60 THEN greatest(25, rad * sqrt(2)) ELSE 25 END::DOUBLE AS length, cx + rad * mx / 2 AS mx, cz + rad * mz / 2 AS mz, -mx / sqrt(2) AS nx, -mz / sqrt(2) AS nz
  FROM polygons, (VALUES (0, 1, 1), (1, -1, 1), (2, -1, -1), (3, 1, -1)) v(k, mx, mz)),
rects AS (SELECT poly, i, mx + nx * length / 2 AS x, mz + nz * length / 2 AS z, width / 2 / (500 / 512::DOUBLE) AS scale_x, length / 2 / (500 / 512::DOUBLE) AS scale_z, degrees(atan2(nx, nz)) AS rotation FROM r)"""


def rectangles(spark, d):
    from pyspark.sql import Window as W

    corners = A.polygons(spark, d).select(F.col("poly").alias("region"), F.posexplode("ring").alias("i", "p"), F.get("ring", F.lit(0)).alias("first"))
    after = F.coalesce(F.lead("p").over(W.partitionBy("region").orderBy("i")), "first")
    edges = corners.withColumn("q", after).select("region", F.lit(0).alias("ring"), "i", F.lit(False).alias("hole"), F.col("p.x").alias("x1"), F.col("p.z").alias("z1"), F.col("q.x").alias("x2"), F.col("q.z").alias("z2"))
    return FL.edge_rectangles(edges, 60.0, 25.0)


@C.query("edge_rectangles", f"WITH {RECTANGLES} SELECT poly, i, round(x, 5) AS x, round(z, 5) AS z, round(scale_x, 5) AS scale_x, round(scale_z, 5) AS scale_z, round(rotation, 4) AS rotation FROM rects")
def edge_rectangles(spark, d):
    r = rectangles(spark, d)
    return r.select(F.col("region").alias("poly"), "i", *[C.r6(c, 5).alias(c) for c in ("x", "z", "scale_x", "scale_z")], C.r6("rotation", 4).alias("rotation"))


@C.query("rectangle_values", f"""WITH {RECTANGLES}, m AS (SELECT poly, i, count(h) AS n, avg(h) AS value FROM rects JOIN ground ON abs(((col + 0.5) * 20 - x) * cos(radians(rotation)) - ((row + 0.5) * 20 - z) * sin(radians(rotation))) <= scale_x
  AND abs(((col + 0.5) * 20 - x) * sin(radians(rotation)) + ((row + 0.5) * 20 - z) * cos(radians(rotation))) <= scale_z GROUP BY 1, 2) SELECT poly, i, coalesce(n, 0)::BIGINT AS n, round(value, 6) AS value FROM rects LEFT JOIN m USING (poly, i)""")
def rectangle_values(spark, d):
    got = FL.rectangle_values(rectangles(spark, d), C.ground(spark, d), C.GRID, ["region", "i"])
    return got.select(F.col("region").alias("poly"), "i", "n", C.r6("value").alias("value"))
