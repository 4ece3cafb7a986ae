"""Bands filled with discs: random candidates in order of their lot, without a loop over them, then the rest covered from its deepest cells.

A candidate is taken if no candidate before it that is taken comes too near. So in a round every candidate that has none before it that is still open and too
near is taken, and those too near to it fall out; which are taken is what the loop over all in order gives, and with lots drawn at random few rounds do.
Candidates meet in bins as wide as the earlier one's reach, a level of bins for each radius.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from .grid import Grid
from .refine import deepest_first
from .staging import cut, numbered
from .tiled import denoised, depths, nearest_values


def lot(seed: int, *place: str) -> Column:
    """A number of 32 bits that follows from seed and place alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), *place)), 1, 8), 16, 10).cast("long")


def candidates(deep: DataFrame, key: str, radii: list[float], plateau: float, edge: float, most: int, seed: int) -> DataFrame:
    """(key, tier, lot, row, col, radius): for each radius (a tier) the up to `most` cells (key, row, col, depth) with the smallest lots among those where a plateau
    keeps edge metres from the end of the mask. Cells without an end (null depth) take any."""
    tiers = F.array(*[F.struct(F.lit(k).alias("tier"), F.lit(float(r)).alias("radius")) for k, r in enumerate(radii)])
    fit = F.filter(tiers, lambda t: F.col("depth").isNull() | (F.col("depth") >= t["radius"] * plateau + max(0.0, edge)))
    rows = deep.select(key, "row", "col", F.explode(fit).alias("t")).select(key, "t.tier", "row", "col", "t.radius").withColumn("lot", lot(seed, key, "tier", "row", "col"))
    first = F.row_number().over(W.partitionBy(key, "tier").orderBy("lot", "row", "col"))
    return rows.withColumn("_n", first).where(F.col("_n") <= most).drop("_n")


def conflicts(rows: DataFrame, key: str, grid: Grid, radii: list[float], plateau: float) -> DataFrame:
    """(a, b): numbers of candidates (n, key, tier, row, col, radius) of a key whose plateaus overlap, a before b."""
    level = F.array(*[F.lit(2 * r * plateau) for r in radii])  # a plateau meets only plateaus up to its own size behind it
    z, x, p = F.col("row") * grid.cell_z, F.col("col") * grid.cell_x, F.col("radius") * plateau
    at = rows.select("n", F.col(key).alias("k"), "tier", z.alias("z"), x.alias("x"), p.alias("p"))
    bin_of = lambda v, step=0: F.floor(F.col(v) / F.get(level, F.col("level"))) + step
    near = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    first = at.withColumn("level", F.col("tier")).withColumn("sz", near).withColumn("sx", near)
    first = first.select(F.col("n").alias("a"), "k", "level", F.col("z").alias("az"), F.col("x").alias("ax"), F.col("p").alias("ap"), bin_of("z", F.col("sz")).alias("bz"), bin_of("x", F.col("sx")).alias("bx"))
    second = at.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("tier"))))
    second = second.select(F.col("n").alias("b"), "k", "level", "z", "x", "p", bin_of("z").alias("bz"), bin_of("x").alias("bx"))
    dz, dx, reach = F.col("az") - F.col("z"), F.col("ax") - F.col("x"), F.col("ap") + F.col("p")
    return first.join(second, ["k", "level", "bz", "bx"]).where((F.col("a") < F.col("b")) & (dz * dz + dx * dx < reach * reach)).select("a", "b")


def first_free(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(n): of nodes (n) those that are taken if they are gone through in order and one is left out that an edge (a, b), a < b, joins with one taken."""
    edges, left_out = cut(edges), []
    while not edges.isEmpty():
        behind = edges.select(F.col("b").alias("a")).distinct()  # those before which another is still open wait
        out = cut(edges.join(behind, "a", "left_anti").select("b").distinct())
        left_out.append(out.select(F.col("b").alias("n")))
        edges = cut(edges.join(out, "b", "left_anti").join(out.withColumnRenamed("b", "a"), "a", "left_anti").select("a", "b"))
    taken = nodes.select("n")
    if left_out:
        taken = taken.join(reduce(DataFrame.unionByName, left_out), "n", "left_anti")
    return taken


def covered_cells(discs: DataFrame, key: str, grid: Grid, reach: Column) -> DataFrame:
    """(key, row, col) of the cells whose centres lie within reach of a disc's (key, row, col)."""
    span = lambda cell: F.explode(F.sequence(-F.floor(reach / cell), F.floor(reach / cell)))
    cells = discs.withColumn("dr", span(grid.cell_z)).withColumn("dc", span(grid.cell_x))
    dz, dx = F.col("dr") * grid.cell_z, F.col("dc") * grid.cell_x
    return cells.where(dz * dz + dx * dx <= reach * reach).select(key, (F.col("row") + F.col("dr")).cast("int").alias("row"), (F.col("col") + F.col("dc")).cast("int").alias("col")).distinct()


def packed(mask: DataFrame, grid: Grid, key: str, radii: list[float], plateau: float, edge: float = 0.0, most: int = 2000, seed: int = 1) -> DataFrame:
    """(key, row, col, radius, n): discs in each mask (key, row, col), larger ones first, whose plateaus (that share of the radius) neither overlap nor leave the mask."""
    if plateau <= 0:
        return mask.select(key, "row", "col", F.lit(0.0).alias("radius"), F.lit(0).cast("long").alias("n")).limit(0)
    rows = cut(numbered(candidates(depths(mask, grid, key), key, radii, plateau, edge, most, seed), "n", F.col(key), F.col("tier"), F.col("lot"), F.col("row"), F.col("col")))
    return rows.join(first_free(rows, conflicts(rows, key, grid, radii, plateau)), "n").select(key, "row", "col", "radius", "n")


def contour_stamps(banded: DataFrame, grid: Grid, largest: float = 50.0, smallest: float = 10.0, ratio: float = 0.85, plateau: float = 0.5, most: int = 2000, seed: int = 1, denoise: int = 1, edge: float = 0.0, crumb_radius: float = 16.0, crumb_share: float = 0.25, tile: int = 64, region: DataFrame | None = None) -> DataFrame:
    """(band, pass, n, row, col, x, z, radius, value) of the bands (band, row, col, h): discs packed by lot (pass 1), then discs of crumb_radius on what they leave
    bare, each claiming crumb_share of it, 1.5 cells at least (pass 2). Bands are closed and rid of specks first, and kept to region (row, col). A value is the height of the
    nearest cell with data. n is the order within a pass."""
    mask = denoised(banded.where("h IS NOT NULL"), grid, denoise, key="band")
    if region is not None:
        mask = mask.join(region.select("row", "col").distinct(), ["row", "col"])
    mask = cut(mask.select("band", "row", "col"))
    discs = cut(packed(mask, grid, "band", G.tier_radii(largest, smallest, ratio), plateau, edge, most, seed))
    bare = mask.join(covered_cells(discs, "band", grid, F.col("radius") * plateau), ["band", "row", "col"], "left_anti")
    claim = max(crumb_share * crumb_radius, 1.5 * max(grid.cell_x, grid.cell_z))
    crumbs = numbered(deepest_first(bare, grid, claim, "band", tile), "n", F.col("band"), F.desc("depth"), F.col("row"), F.col("col"))
    both = discs.withColumn("pass", F.lit(1)).unionByName(crumbs.select("band", "row", "col", F.lit(float(crumb_radius)).alias("radius"), "n", F.lit(2).alias("pass")))
    both = cut(both.withColumn("stamp", F.struct("pass", "n")))
    value = nearest_values(both, banded.select("row", "col", "h"), "stamp")
    out = both.join(value, "stamp").select("band", "pass", "n", "row", "col", "radius", "value")
    return out.withColumns({"x": grid.centre_x(F.col("col")), "z": grid.centre_z(F.col("row"))})
