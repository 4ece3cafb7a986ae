"""Outlines of regions of any size: the cells around a region in order, and lines with fewer points.

A trace around a region is a chain of moves, each of which follows from the one before and the cells about it. So all moves that cells at an edge allow are made at
once, and chains are put in order by doubling: whoever knows its next 2**k moves and where they lead knows 2**(k+1). Lines are simplified in rounds, all stretches
side by side. No task holds a whole ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .grid import Grid
from .spatial import bin_of, crosses
from .staging import cut
from .tiled import components

#: Steps (row, col) clockwise from the left.
STEPS = ((0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1))


def at_edge(cells: DataFrame, key: str) -> DataFrame:
    """The cells (key, row, col) that lack one of the four neighbours of their key."""
    across, up = W.partitionBy(key, "row").orderBy("col"), W.partitionBy(key, "col").orderBy("row")
    next_to = [F.lag("col").over(across) == F.col("col") - 1, F.lead("col").over(across) == F.col("col") + 1, F.lag("row").over(up) == F.col("row") - 1, F.lead("row").over(up) == F.col("row") + 1]
    named = cells.select(key, "row", "col", *[F.coalesce(n, F.lit(False)).alias(f"_{i}") for i, n in enumerate(next_to)])
    return named.where("NOT (_0 AND _1 AND _2 AND _3)").select(key, "row", "col")


def first_turn(came: Column, near: Column) -> Column:
    """The first direction clockwise behind `came` in which a neighbour stands; near has a bit for each; null without neighbours."""
    ways = [F.pmod(came + k, F.lit(8)) for k in range(1, 9)]
    return F.coalesce(*[F.when(F.floor(near / F.pow(F.lit(2), w)).cast("int") % 2 == 1, w) for w in ways])


def traced(cells: DataFrame, grid: Grid, key: str) -> DataFrame:
    """(key, i, row, col): the outer boundary of each set of connected cells (key, row, col) in order, clockwise from its first cell in row-major order, by following the
    last turn around until a move repeats. The first cell stands only at the start. A cell alone is its own boundary."""
    members = cells.select(key, "row", "col").distinct()
    edge = cut(at_edge(members, key))
    step = F.explode(F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for k, (a, b) in enumerate(STEPS)])).alias("s")
    around = edge.select(key, "row", "col", step).select(key, F.col("row").alias("from_row"), F.col("col").alias("from_col"), "s.turn", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"))
    met = around.join(members, [key, "row", "col"])
    near = cut(met.groupBy(key, F.col("from_row").alias("row"), F.col("from_col").alias("col")).agg(F.sum(F.pow(F.lit(2), F.col("turn"))).cast("int").alias("near")))
    place = (F.col("row").cast("long") * grid.cols + F.col("col")) * 8
    moves = met.join(edge, [key, "row", "col"]).join(near, [key, "row", "col"])
    moves = moves.select(key, ((F.col("from_row").cast("long") * grid.cols + F.col("from_col")) * 8 + F.col("turn")).alias("move"), (place + first_turn(F.pmod(F.col("turn") + 4, F.lit(8)), F.col("near"))).alias("to"))
    first = edge.groupBy(key).agg(F.min(F.struct("row", "col")).alias("f")).select(key, "f.row", "f.col")
    start = first.join(near, [key, "row", "col"])
    known = cut(start.select(key, (place + first_turn(F.lit(0), F.col("near"))).alias("move"), F.lit(0).cast("long").alias("i")))
    jump, size, n = cut(moves), 1, 0
    while (more := known.count()) > n:  # until the next `size` moves of all are known ones
        n = more
        ahead = known.join(jump, [key, "move"]).select(key, F.col("to").alias("move"), (F.col("i") + size).alias("i"))
        known = cut(known.unionByName(ahead).groupBy(key, "move").agg(F.min("i").alias("i")))
        jump = cut(jump.join(jump.select(key, F.col("move").alias("to"), F.col("to").alias("later")), [key, "to"]).select(key, "move", F.col("later").alias("to")))
        size *= 2
    ways = [F.get(F.array(*[F.lit(s[k]) for s in STEPS]), (F.col("move") % 8).cast("int")) for k in (0, 1)]
    cell = F.floor(F.col("move") / 8)
    stood = known.select(key, (F.col("i") + 1).alias("i"), (F.floor(cell / grid.cols) + ways[0]).cast("int").alias("row"), (cell % grid.cols + ways[1]).cast("int").alias("col"))
    stood = stood.join(first.select(key, F.col("row").alias("r0"), F.col("col").alias("c0")), key).where("row <> r0 OR col <> c0")
    return first.select(key, F.lit(0).cast("long").alias("i"), "row", "col").unionByName(stood.select(key, "i", "row", "col"))


def simplified(lines: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """The points of lines (keys, i, x, z) that stay if, from end to end, the farthest from the straight line between its neighbours that stay is kept while it is
    farther than tolerance; the first such at a tie."""
    ends = lines.groupBy(*keys).agg(F.min(F.struct("i", "x", "z")).alias("a"), F.max(F.struct("i", "x", "z")).alias("b"))
    corner = F.explode(F.array("a", "b")).alias("p")
    kept = [ends.select(*keys, corner).select(*keys, "p.*").distinct()]
    left = cut(lines.join(ends, keys).where("i > a.i AND i < b.i"))
    while not left.isEmpty():
        dx, dz = F.col("b.x") - F.col("a.x"), F.col("b.z") - F.col("a.z")
        px, pz = F.col("x") - F.col("a.x"), F.col("z") - F.col("a.z")
        length = F.sqrt(dx * dx + dz * dz)
        off = F.when(length > 0, F.abs(dz * px - dx * pz) / length).otherwise(F.sqrt(px * px + pz * pz))
        farthest = left.withColumn("off", off).groupBy(*keys, "a", "b").agg(F.max(F.struct("off", (-F.col("i")).alias("first"), "x", "z")).alias("m")).where(F.col("m.off") > tolerance)
        split = cut(farthest.select(*keys, "a", "b", F.struct((-F.col("m.first")).alias("i"), F.col("m.x").alias("x"), F.col("m.z").alias("z")).alias("p")))
        kept.append(split.select(*keys, "p.*"))
        on = left.join(split, [*keys, "a", "b"]).where("i <> p.i")
        left = cut(on.select(*keys, "i", "x", "z", F.when(F.col("i") > F.col("p.i"), F.col("p")).otherwise(F.col("a")).alias("a"), F.when(F.col("i") < F.col("p.i"), F.col("p")).otherwise(F.col("b")).alias("b")))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def ring_edges(rings: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, i, x1, z1, x2, z2) of closed rings (keys, i, x, z)."""
    order, whole = W.partitionBy(*keys).orderBy("i"), W.partitionBy(*keys).orderBy("i").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    next_ = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(f"{c}2")
    return rings.select(*keys, "i", F.col("x").alias("x1"), F.col("z").alias("z1"), next_("x"), next_("z"))


def holders(points: DataFrame, edges: DataFrame, point: str, key: str, size: float = 16.0) -> DataFrame:
    """(point, key) of each point (point, x, z) in each ring, given as edges (key, x1, z1, x2, z2), that holds it. Edges meet points of the strips of z they cross."""
    strips = edges.withColumn("strip", F.explode(F.sequence(bin_of(F.least("z1", "z2"), size), bin_of(F.greatest("z1", "z2"), size))))
    met = points.withColumn("strip", bin_of(F.col("z"), size)).join(strips, "strip").where(crosses(F.col("x"), F.col("z")))
    return met.groupBy(point, key).count().where("count % 2 = 1").select(point, key)


def region_rings(mask: DataFrame, grid: Grid, tolerance: float = 1.5, least: int = 3, tile: int = 256, key: str | None = None) -> DataFrame:
    """(region, ring, hole, i, x, z): the simplified boundaries of the connected regions of mask (row, col), or of the masks of each whole number key, in metres.

    ring 0 is the region's outer boundary; others, named by their first cell, go around areas it encloses, found as components of the cells that aren't in the
    mask and don't reach the raster's edge: they are holes of each region whose outer boundary holds their first cell. A region is named 1 + its first cell's place
    (+ key * cells). Rings of fewer than least cells, or of fewer than three points in the end, are left out, with a region's holes if it is its outer one."""
    size, names = grid.rows * grid.cols, ["row", "col"] if key is None else [key, "row", "col"]
    own = F.lit(0) if key is None else F.col(key)
    cells = cut(mask.select(names).distinct())
    dense = grid.cells(mask.sparkSession)
    others = (dense if key is None else dense.crossJoin(F.broadcast(cells.select(key).distinct()))).join(cells, names, "left_anti")  # a row per key
    in_and_out = [c.select((own.cast("long") * 2 + k).alias("side"), "row", "col") for k, c in enumerate((cells, others))]
    labelled = cut(components(in_and_out[0].unionByName(in_and_out[1]), grid, tile, key="side"))
    labelled = labelled.select(F.when(F.col("side") % 2 == 0, 1).otherwise(-1).alias("sign"), (F.floor(F.col("side") / 2) * size + F.col("label")).alias("label"), "row", "col")
    enclosed = labelled.where("sign < 0").groupBy("label").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1")).where((F.col("r0") > 0) & (F.col("c0") > 0) & (F.col("r1") < grid.rows - 1) & (F.col("c1") < grid.cols - 1))
    sets = labelled.where("sign > 0").unionByName(labelled.where("sign < 0").join(enclosed.select("label"), "label", "left_semi").select(labelled.columns))
    lines = cut(traced(sets.select((F.col("sign") * F.col("label")).alias("id"), "row", "col"), grid, "id"))
    lines = lines.join(lines.groupBy("id").count().where(F.col("count") >= max(3, least)), "id", "left_semi").select("id", "i", F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("z"))
    outer, inner = lines.where("id > 0").withColumnRenamed("id", "region"), lines.where("id < 0").withColumn("hole", -F.col("id")).drop("id")
    first = inner.where("i = 0").select("hole", "x", "z")
    held = holders(first, ring_edges(outer.select("region", "i", "x", "z"), ["region"]), "hole", "region").where(F.floor((F.col("hole") - 1) / size) == F.floor((F.col("region") - 1) / size))
    rings = outer.select("region", F.lit(0).cast("long").alias("ring"), "i", "x", "z").unionByName(inner.join(held, "hole").select("region", F.col("hole").alias("ring"), "i", "x", "z"))
    kept = cut(simplified(rings, ["region", "ring"], tolerance / grid.cell_x))
    kept = kept.join(kept.groupBy("region", "ring").count().where("count >= 3").select("region", "ring"), ["region", "ring"], "left_semi")
    kept = kept.join(kept.where("ring = 0").select("region").distinct(), "region", "left_semi")
    x, z = grid.min_x + (F.col("x") + 0.5) * grid.cell_x, grid.min_z + (F.col("z") + 0.5) * grid.cell_z
    return kept.select("region", "ring", (F.col("ring") != 0).alias("hole"), "i", x.alias("x"), z.alias("z"))
