"""Queries of the refinement pass, with SQL that takes one place after the other."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import refine as RE
from ..operators import stamps as ST
from ..operators.grid import Grid
from ..sources import adapters as A
from . import catalog as C

COARSE = Grid(rows=25, cols=25)
HOW = RE.Refinement(tolerance=6.0, smallest=60.0, largest=170.0, claim=0.8, spread=1.1)

#: The weight of (plateau, r) in a relation that has them.
WEIGHTED = """(SELECT w0 + (w1 - w0) * (t - i) FROM (SELECT t, i, least(1.0::DOUBLE, (1 - i / 255.0::DOUBLE) / (1 - {p})) AS w0, least(1.0::DOUBLE, (1 - (i + 1) / 255.0::DOUBLE) / (1 - {p})) AS w1
  FROM (SELECT least(greatest({r}, 0), 1) * 255 AS t, least(254, floor(least(greatest({r}, 0), 1) * 255)) AS i)))"""


def lifted(name: str, cell: float, n: int) -> str:
    """Relation name (row, col, now): the mean ground and the raise stamps on it, at the centres of n x n cells."""
    square = "greatest(abs((c.x - s.x) * cos(radians(rotation)) - (c.z - s.z) * sin(radians(rotation))) / scale_x, abs((c.x - s.x) * sin(radians(rotation)) + (c.z - s.z) * cos(radians(rotation))) / scale_z)"
    return f"""{name}_cells AS (SELECT (i // {n})::INT AS row, (i % {n})::INT AS col, (i % {n} + 0.5::DOUBLE) * {cell} AS x, (i // {n} + 0.5::DOUBLE) * {cell} AS z FROM range({n * n}) t(i)),
  {name}_near AS (SELECT row, col, value, plateau, CASE WHEN shape = 'square' THEN {square} ELSE sqrt((c.x - s.x) * (c.x - s.x) + (c.z - s.z) * (c.z - s.z)) / scale_x END AS r
    FROM stamps s JOIN brushes USING (brush) JOIN {name}_cells c ON c.x BETWEEN s.x - 150 AND s.x + 150 AND c.z BETWEEN s.z - 150 AND s.z + 150 WHERE tool = 1),
  {name}_lift AS (SELECT row, col, sum(value * {WEIGHTED.format(p='plateau', r='r')}) AS lift FROM {name}_near WHERE r <= 1 GROUP BY 1, 2),
  {name} AS (SELECT c.row, c.col, c.x, c.z, m.m + coalesce(lift, 0) AS now FROM {name}_cells c LEFT JOIN {name}_lift l ON l.row = c.row AND l.col = c.col, mean m)"""


LOOP = f"""{C.GROUND}, {C.STAMPS}, {C.BRUSHES}, mean AS (SELECT avg(h) AS m FROM ground), {lifted('fine', 20.0, 100)}, {lifted('wide', 80.0, 25)},
  actual AS (SELECT row // 4 AS row, col // 4 AS col, avg(h) AS h FROM ground GROUP BY 1, 2),
  field AS (SELECT w.row, w.col, w.now - a.h AS e FROM wide w LEFT JOIN actual a ON a.row = w.row AND a.col = w.col),
  s AS (SELECT 0 AS k, row, col, e, FALSE AS done, NULL::INT AS p_row, NULL::INT AS p_col, NULL::INT AS p_side, NULL::DOUBLE AS p_deep, NULL::DOUBLE AS p_e, FALSE AS p_placed FROM field
    UNION ALL SELECT s.k + 1, s.row, s.col, s.e, s.done OR (s.row = p.row AND s.col = p.col) OR (p.placed AND s.e * p.side > 6 AND sqrt(pow((s.row - p.row) * 80.0::DOUBLE, 2) + pow((s.col - p.col) * 80.0::DOUBLE, 2)) <= 0.8 * least(greatest(p.deep, 60), 170)),
        p.row, p.col, p.side, p.deep, p.e, p.placed
      FROM s, (SELECT q.*, (SELECT count(*) FROM ground g WHERE pow((g.col + 0.5::DOUBLE) * 20 - (q.col + 0.5) * 80, 2) + pow((g.row + 0.5::DOUBLE) * 20 - (q.row + 0.5) * 80, 2) <= pow(least(170.0::DOUBLE, 1.1::DOUBLE * 1.1 * 1.1 * least(greatest(q.deep, 60), 170)), 2)) >= 3 AS placed
        FROM (SELECT a.row, a.col, v.side, any_value(a.e) AS e, min(sqrt(pow((a.row - b.row) * 80.0::DOUBLE, 2) + pow((a.col - b.col) * 80.0::DOUBLE, 2))) AS deep
          FROM s a JOIN (VALUES (1), (-1)) v(side) ON coalesce(a.e * v.side > 6, FALSE) AND NOT a.done JOIN s b ON NOT (coalesce(b.e * v.side > 6, FALSE) AND NOT b.done)
          GROUP BY 1, 2, 3 HAVING deep >= 80 ORDER BY deep DESC, v.side DESC, a.row, a.col LIMIT 1) q) p),
  picks AS (SELECT DISTINCT k, p_row AS row, p_col AS col, p_side AS side, p_deep AS deep, p_e AS e FROM s WHERE p_placed),
  hot AS (SELECT row_number() OVER (ORDER BY k) AS hotspot, row, col, side, deep, e, least(greatest(deep, 60), 170) AS radius, (col + 0.5::DOUBLE) * 80 AS x, (row + 0.5::DOUBLE) * 80 AS z FROM picks)"""


def start(spark, d):
    """A stamp that lays the whole course at the mean ground, and the raise stamps on it."""
    grid = C.GRID
    flat = ST.course_wide(-1, 0.0, grid, tool=ST.FLATTEN, margin=1000.0)
    names = ["seq", "x", "z", "scale_x", "scale_z", "value", "brush", "rotation", "tool"]
    mean = C.ground(spark, d).agg(F.avg("h").alias("value"))
    return mean.select(*[(F.col("value") if n == "value" else F.lit(flat[n])).alias(n) for n in names]).unionByName(A.stamps(spark, d).where(F.col("tool") == ST.RAISE).select(*names))


def found(spark, d):
    return RE.hotspots(start(spark, d), C.ground(spark, d), C.GRID, COARSE, A.brush_profiles(spark), HOW, tile=10, halo=10)


@C.query("adaptive_refine", f"WITH RECURSIVE {LOOP} SELECT hotspot, row, col, side, round(deep, 6) AS depth, round(radius, 6) AS radius, round(e, 5) AS error FROM hot")
def adaptive_refine(spark, d):
    return found(spark, d).select("hotspot", "row", "col", "side", *[C.r6(c, n).alias(c) for c, n in (("depth", 6), ("radius", 6), ("error", 5))])


FITTED = f"""{LOOP}, tried(place, brush, plateau, rank) AS (VALUES (1, 8, 0.0::DOUBLE, 0), (2, 9, 0.25::DOUBLE, 1), (3, 10, 0.5::DOUBLE, 2), (4, 54, 0.1::DOUBLE, 3)),
  now AS (SELECT f.row, f.col, f.x, f.z, f.now, g.h FROM fine f LEFT JOIN ground g ON g.row = f.row AND g.col = f.col),
  near AS (SELECT hotspot, radius, n.now, n.h, sqrt(pow(n.x - hot.x, 2) + pow(n.z - hot.z, 2)) AS d FROM hot JOIN now n ON n.h IS NOT NULL AND pow(n.x - hot.x, 2) + pow(n.z - hot.z, 2) <= pow(least(170.0::DOUBLE, radius * (1.1::DOUBLE * 1.1 * 1.1)), 2)),
  aim AS (SELECT hotspot, avg(h) AS target FROM near GROUP BY 1),
  cand AS (SELECT a.hotspot, place, brush, plateau, rank, tool, w.now AS centre, a.target, CASE WHEN tool = 1 THEN a.target - w.now ELSE a.target END AS value
    FROM aim a JOIN hot USING (hotspot) JOIN wide w ON w.row = hot.row AND w.col = hot.col, tried, (VALUES (0), (1)) t(tool)),
  weights AS (SELECT c.*, n.now, n.h, {WEIGHTED.format(p='c.plateau', r='n.d / n.radius')} AS w FROM cand c JOIN near n USING (hotspot)),
  scores AS (SELECT hotspot, place, brush, plateau, rank, tool, value, sqrt(avg(pow(CASE WHEN tool = 1 THEN now + value * w ELSE now + (value - now) * w END - h, 2))) AS rms FROM weights GROUP BY ALL),
  best AS (SELECT *, least(radius * pow(1.1::DOUBLE, rank), 170) AS placed FROM (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY hotspot ORDER BY round(rms, 9), place, tool) = 1) JOIN hot USING (hotspot))"""


@C.query("refine_stamps", f"WITH RECURSIVE {FITTED} SELECT hotspot, brush::INT AS brush, tool::INT AS tool, round(value, 4) AS value, round(placed, 5) AS placed, round(rms, 4) AS rms FROM best")
def refine_stamps(spark, d):
    return found(spark, d).select("hotspot", F.col("brush").cast("int").alias("brush"), "tool", C.r6("value", 4).alias("value"), C.r6("placed", 5).alias("placed"), C.r6("rms", 4).alias("rms"))


@C.query(
    "refine_residual",
    f"""WITH RECURSIVE {FITTED}, hits AS (SELECT n.row, n.col, hotspot, tool, value, {WEIGHTED.format(p='plateau', r='sqrt(pow(n.x - b.x, 2) + pow(n.z - b.z, 2)) / placed')} AS w FROM best b JOIN now n ON sqrt(pow(n.x - b.x, 2) + pow(n.z - b.z, 2)) / placed <= 1),
  maps AS (SELECT row, col, list_reduce(list({{'a': CASE WHEN tool = 1 THEN 1.0::DOUBLE ELSE 1 - w END, 'b': value * w}} ORDER BY hotspot), lambda p, q: {{'a': p.a * q.a, 'b': p.b * q.a + q.b}}) AS m FROM hits GROUP BY 1, 2),
  after AS (SELECT n.h, n.now, CASE WHEN m IS NULL THEN n.now ELSE m.a * n.now + m.b END AS later FROM now n LEFT JOIN maps ON maps.row = n.row AND maps.col = n.col WHERE n.h IS NOT NULL)
SELECT count(*) AS cells, round(sqrt(avg(pow(now - h, 2))), 4) AS rms_before, round(sqrt(avg(pow(later - h, 2))), 4) AS rms_after FROM after""",
)
def refine_residual(spark, d):
    ground, profiles = C.ground(spark, d), A.brush_profiles(spark)
    before, after = start(spark, d), RE.refined(start(spark, d), ground, C.GRID, COARSE, profiles, HOW, tile=10, halo=10)
    off = [ST.render(C.GRID, s, profiles).select("row", "col", F.col("h").alias(n)) for s, n in ((before, "before"), (after, "after"))]
    both = ground.join(off[0], ["row", "col"]).join(off[1], ["row", "col"])
    rms = lambda c: C.r6(F.sqrt(F.avg(F.pow(F.col(c) - F.col("h"), F.lit(2)))), 4).alias(f"rms_{c}")
    return both.agg(F.count("*").alias("cells"), rms("before"), rms("after"))
