"""Queries of discs packed in bands, with SQL that takes one candidate, or one cell, after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import fallline as FL
from ..operators import grid as GR
from ..operators import packing as PA
from ..operators import refine as RE
from . import catalog as C

COARSE = GR.Grid(rows=25, cols=25)
RADII = G.tier_radii(300.0, 60.0, 0.7)
TIERS = ", ".join(f"({k}, {r!r}::DOUBLE)" for k, r in enumerate(RADII))
MOST = 120

MASKS = f"""{C.GROUND}, coarse AS (SELECT row // 4 AS row, col // 4 AS col, avg(h) AS h FROM ground GROUP BY 1, 2), m AS (SELECT min(h) AS low, max(h) AS high FROM coarse),
  masks AS (SELECT row, col, least(floor((h - low) / 15), greatest(ceil((high - low) / 15) - 1, 0))::INT AS band FROM coarse, m), all_cells AS (SELECT (i // 25)::INT AS row, (i % 25)::INT AS col FROM range(625) t(i))"""

#: The k-th candidates of all bands at once; acc holds those taken.
DISCS = f"""{MASKS}, others AS (SELECT c.row, c.col, o.band FROM all_cells c LEFT JOIN masks o ON o.row = c.row AND o.col = c.col),
  deep AS (SELECT b.band, b.row, b.col, min(sqrt(pow((b.row - c.row) * 80.0::DOUBLE, 2) + pow((b.col - c.col) * 80.0::DOUBLE, 2))) AS depth FROM masks b LEFT JOIN others c ON c.band IS DISTINCT FROM b.band GROUP BY 1, 2, 3),
  cand AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY band ORDER BY tier, lot, row, col) AS k FROM (SELECT *, ('0x' || substr(md5('1/' || band || '/' || tier || '/' || row || '/' || col), 1, 8))::BIGINT AS lot
    FROM deep, (VALUES {TIERS}) v(tier, radius) WHERE coalesce(depth >= radius * 0.5, TRUE) QUALIFY row_number() OVER (PARTITION BY band, tier ORDER BY lot, row, col) <= {MOST})),
  acc(band, k, row, col, radius, taken) USING KEY (band, k) AS (SELECT DISTINCT band, 0::BIGINT, 0, 0, 0.0::DOUBLE, FALSE FROM cand
    UNION (SELECT c.band, c.k, c.row, c.col, c.radius, NOT EXISTS (FROM recurring.acc r WHERE r.taken AND r.band = c.band AND (r.row * 80.0 - c.row * 80.0) * (r.row * 80.0 - c.row * 80.0) + (r.col * 80.0 - c.col * 80.0) * (r.col * 80.0 - c.col * 80.0) < (r.radius * 0.5::DOUBLE + c.radius * 0.5) * (r.radius * 0.5::DOUBLE + c.radius * 0.5))
      FROM acc JOIN cand c ON c.band = acc.band AND c.k = acc.k + 1))"""


def masks(spark, d):
    return GR.with_bands(GR.downsample(C.ground(spark, d), C.GRID, COARSE), 15.0)


@C.query("contour_discs", f"WITH RECURSIVE {DISCS} SELECT band, row, col, round(radius, 6) AS radius FROM acc WHERE taken")
def contour_discs(spark, d):
    return PA.packed(masks(spark, d), COARSE, "band", RADII, 0.5, most=MOST).select("band", "row", "col", C.r6("radius").alias("radius"))


BANDS = f"{C.GROUND}, m AS (SELECT min(h) AS low, max(h) AS high FROM ground), banded AS (SELECT row, col, least(floor((h - low) / 40), greatest(ceil((high - low) / 40) - 1, 0))::INT AS band FROM ground, m)"


@C.query("contour_cover", f"WITH {BANDS} SELECT band, count(*) AS cells, 0::BIGINT AS bare, 0::BIGINT AS overlaps FROM banded GROUP BY band")
def contour_cover(spark, d):
    """Of each band its cells, how many no stamp covers, and how many pairs of plateaus overlap."""
    bands = GR.with_bands(C.ground(spark, d), 40.0).select("band", "row", "col", "h")
    stamps = PA.contour_stamps(bands, C.GRID, 60.0, 20.0, 0.7, denoise=0)
    reach = F.when(F.col("pass") == 1, F.col("radius") * 0.5).otherwise(30.0)
    bare = bands.join(PA.covered_cells(stamps, "band", C.GRID, reach), ["band", "row", "col"], "left_anti").groupBy("band").agg(F.count("*").alias("bare"))
    discs = stamps.where(F.col("pass") == 1).select("band", "n", "x", "z", (F.col("radius") * 0.5).alias("p"))
    other = discs.select("band", F.col("n").alias("m"), F.col("x").alias("ox"), F.col("z").alias("oz"), F.col("p").alias("op"))
    near = F.pow(F.col("x") - F.col("ox"), F.lit(2)) + F.pow(F.col("z") - F.col("oz"), F.lit(2)) < F.pow(F.col("p") + F.col("op") - 1e-6, F.lit(2))
    overlaps = discs.join(other, "band").where((F.col("n") < F.col("m")) & near).groupBy("band").agg(F.count("*").alias("overlaps"))
    found = bands.groupBy("band").agg(F.count("*").alias("cells")).join(bare, "band", "left").join(overlaps, "band", "left")
    return found.select("band", "cells", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("bare", "overlaps")])


#: The deepest open cell of each band, one after the other, on 25 x 25 cells of 80 m.
CRUMBS = f"""{MASKS},
  s AS (SELECT 0 AS k, b.band, c.row, c.col, o.band IS NOT NULL AS open, NULL::INT AS p_row, NULL::INT AS p_col, NULL::DOUBLE AS p_deep FROM (SELECT DISTINCT band FROM masks) b, all_cells c LEFT JOIN masks o ON o.band = b.band AND o.row = c.row AND o.col = c.col
    UNION ALL SELECT s.k + 1, s.band, s.row, s.col, s.open AND sqrt(pow((s.row - p.row) * 80.0::DOUBLE, 2) + pow((s.col - p.col) * 80.0::DOUBLE, 2)) > 120, p.row, p.col, p.deep
      FROM s JOIN (SELECT a.band, a.row, a.col, min(sqrt(pow((a.row - b.row) * 80.0::DOUBLE, 2) + pow((a.col - b.col) * 80.0::DOUBLE, 2))) AS deep FROM s a JOIN s b ON b.band = a.band AND a.open AND NOT b.open GROUP BY 1, 2, 3
        QUALIFY row_number() OVER (PARTITION BY a.band ORDER BY deep DESC, a.row, a.col) = 1) p ON p.band = s.band)"""


@C.query("crumb_cover", f"WITH RECURSIVE {CRUMBS} SELECT DISTINCT band, p_row AS row, p_col AS col, round(p_deep, 6) AS depth FROM s WHERE p_row IS NOT NULL")
def crumb_cover(spark, d):
    return RE.deepest_first(masks(spark, d), COARSE, 120.0, "band", tile=10, halo=10).select("band", "row", "col", C.r6("depth").alias("depth"))


@C.query("contour_poisson")
def contour_poisson(spark, d):
    """Bands closed and rid of specks, packed and filled; tests hold its parts against plain loops."""
    return PA.contour_stamps(GR.with_bands(C.ground(spark, d), 40.0), C.GRID)


@C.query("fallline_cover", f"WITH {MASKS} SELECT band, count(*) AS cells, 0::BIGINT AS bare FROM masks GROUP BY band")
def fallline_cover(spark, d):
    """Of each band its cells, and how many neither a rectangle from an edge nor a disc holds."""
    bands = GR.with_bands(GR.downsample(C.ground(spark, d), C.GRID, COARSE), 15.0)
    stamps = FL.fallline_stamps(bands, COARSE, 400.0, 100.0, 40.0, denoise=0, crumb_radius=480.0, tile=10)
    held = FL.rectangle_cells(stamps.where(F.col("pass") == 1), COARSE).select("band", "row", "col")
    held = held.unionByName(PA.covered_cells(stamps.where(F.col("pass") == 2), "band", COARSE, F.lit(120.0)))
    bare = bands.join(held.distinct(), ["band", "row", "col"], "left_anti").groupBy("band").agg(F.count("*").alias("bare"))
    return bands.groupBy("band").agg(F.count("*").alias("cells")).join(bare, "band", "left").select("band", "cells", F.coalesce("bare", F.lit(0).cast("long")).alias("bare"))
