"""Rectangles that reach from each edge of a region to the wall on its other side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .compositing import boxed_cells
from .grid import Grid
from .outlines import region_rings, ring_edges
from .refine import deepest_first
from .spatial import over_bins
from .staging import cut
from .tiled import denoised, nearest_values

#: Fixed value: the share of a square brush's radius at full weight.
PLATEAU = 500 / 512


def inward_edges(edges: DataFrame) -> DataFrame:
    """edges (region, ring, i, hole, x1, z1, x2, z2) of closed rings with their width and (nx, nz), the unit normal into the region, whichever way
    a ring runs: away from a hole. Edges without length are left out."""
    turn = edges.groupBy("region", "ring").agg(F.sum(F.expr("x1 * z2 - x2 * z1")).alias("turn"))
    side = F.when((F.col("turn") >= 0) != F.col("hole"), 1.0).otherwise(-1.0)
    wide = edges.withColumn("width", F.sqrt(F.expr("(x2 - x1) * (x2 - x1) + (z2 - z1) * (z2 - z1)"))).where("width >= 1e-9").join(turn, ["region", "ring"])
    return wide.withColumns({"nx": side * (F.col("z1") - F.col("z2")) / F.col("width"), "nz": side * (F.col("x2") - F.col("x1")) / F.col("width")}).drop("turn")


def nearest_walls(rays: DataFrame, edges: DataFrame, keys: list[str], reach: float, bin_size: float = 128.0) -> DataFrame:
    """(keys, distance) of the first edge of its region that each ray (keys, region, ox, oz, nx, nz) meets within reach; rays that meet none are left out.
    Rays and edges are exploded over the bins of their boxes and meet in an equi-join."""
    ex, ez = F.col("ox") + F.col("nx") * reach, F.col("oz") + F.col("nz") * reach
    near = over_bins(rays, F.least("ox", ex), F.least("oz", ez), F.greatest("ox", ex), F.greatest("oz", ez), bin_size)
    wall = edges.select("region", "x1", "z1", (F.col("x2") - F.col("x1")).alias("ex"), (F.col("z2") - F.col("z1")).alias("ez"))
    wall = over_bins(wall, F.expr("least(x1, x1 + ex)"), F.expr("least(z1, z1 + ez)"), F.expr("greatest(x1, x1 + ex)"), F.expr("greatest(z1, z1 + ez)"), bin_size)
    met = near.join(wall, ["region", "bin_x", "bin_z"]).withColumn("cross", F.expr("nx * ez - nz * ex")).where("abs(cross) >= 1e-9")
    met = met.withColumns({"distance": F.expr("((x1 - ox) * ez - (z1 - oz) * ex) / cross"), "u": F.expr("((x1 - ox) * nz - (z1 - oz) * nx) / cross")})
    return met.where(F.expr(f"distance > 1e-6 AND distance <= {reach} AND u BETWEEN 0 AND 1")).groupBy(*keys).agg(F.min("distance").alias("distance"))


def edge_rectangles(edges: DataFrame, reach: float, least: float, samples: int = 5, plateau: float = PLATEAU) -> DataFrame:
    """(region, ring, i, x, z, scale_x, scale_z, rotation): for each edge a rectangle as wide as the edge whose plateau reaches inward to the
    nearest wall that rays from some places of the edge meet, but at least `least`; so long too where none is met within reach."""
    key = ["region", "ring", "i"]
    inward = inward_edges(edges)
    places = F.array(*[F.lit(0.05 + 0.9 * k / max(samples - 1, 1)) for k in range(samples)])
    rays = inward.withColumn("t", F.explode(places)).select(*key, F.expr("x1 + t * (x2 - x1)").alias("ox"), F.expr("z1 + t * (z2 - z1)").alias("oz"), "nx", "nz")
    long_ = inward.join(nearest_walls(rays, edges, key, reach), key, "left").withColumn("length", F.greatest(F.coalesce("distance", F.lit(0.0)), F.lit(float(least))))
    centre = lambda a, b, n: (F.col(a) + F.col(b)) / 2 + F.col(n) * F.col("length") / 2
    return long_.select(*key, centre("x1", "x2", "nx").alias("x"), centre("z1", "z2", "nz").alias("z"), (F.col("width") / 2 / plateau).alias("scale_x"), (F.col("length") / 2 / plateau).alias("scale_z"), F.degrees(F.atan2("nx", "nz")).alias("rotation"))


def rectangle_cells(rectangles: DataFrame, grid: Grid) -> DataFrame:
    """rectangles with each cell (row, col) whose centre lies in the turned rectangle."""
    angle, dx, dz = F.radians("rotation"), grid.centre_x(F.col("col")) - F.col("x"), grid.centre_z(F.col("row")) - F.col("z")
    return boxed_cells(grid, rectangles).where((F.abs(dx * F.cos(angle) - dz * F.sin(angle)) <= F.col("scale_x")) & (F.abs(dx * F.sin(angle) + dz * F.cos(angle)) <= F.col("scale_z")))


def rectangle_values(rectangles: DataFrame, raster: DataFrame, grid: Grid, keys: list[str]) -> DataFrame:
    """(keys, n, value): the mean of the cells with data whose centres lie in each turned rectangle; null where there are none."""
    cells = rectangle_cells(rectangles, grid)
    means = cells.select(*keys, "row", "col").join(raster.select("row", "col", "h"), ["row", "col"]).groupBy(*keys).agg(F.count("h").alias("n"), F.avg("h").alias("value"))
    return rectangles.select(*keys).join(means, keys, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def fallline_stamps(banded: DataFrame, grid: Grid, reach: float = 60.0, least: float = 25.0, tolerance: float = 1.5, samples: int = 5, denoise: int = 1, crumb_radius: float = 16.0, crumb_share: float = 0.25, tile: int = 64, least_cells: int = 3) -> DataFrame:
    """(band, pass, region, ring, i, row, col, x, z, scale_x, scale_z, rotation, value) of the bands (band, row, col, h): a rectangle for each edge of the simplified
    boundaries of a band's regions and their holes (pass 1), then discs on the cells of the band that no rectangle holds, from the deepest (pass 2; region is null).

    A rectangle's value is the mean of its cells with data; without any, and for discs, that of the nearest cell with data about the middle."""
    size = grid.rows * grid.cols
    mask = cut(denoised(banded.where("h IS NOT NULL"), grid, denoise, key="band").select("band", "row", "col"))
    rings = cut(region_rings(mask, grid, tolerance, least_cells, tile, "band"))
    edges = ring_edges(rings, ["region", "ring", "hole"])
    key = ["region", "ring", "i"]
    found = cut(edge_rectangles(edges, reach, least, samples).withColumn("band", F.floor((F.col("region") - 1) / size).cast("int")))
    held = rectangle_cells(found, grid).select("band", "row", "col").distinct()
    claim = max(crumb_share * crumb_radius, 1.5 * max(grid.cell_x, grid.cell_z))
    crumbs = deepest_first(mask.join(held, ["band", "row", "col"], "left_anti"), grid, claim, "band", tile)
    raster = banded.select("row", "col", "h")
    inner = lambda v, low, cell, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), ((v - low) / cell).cast("int")))
    means = rectangle_values(found, raster, grid, key).select(*key, F.col("value").alias("mean"))
    placed = found.withColumns({"row": inner(F.col("z"), grid.min_z, grid.cell_z, grid.rows), "col": inner(F.col("x"), grid.min_x, grid.cell_x, grid.cols)}).join(means, key).withColumn("pass", F.lit(1))
    none = F.lit(None).cast("long")
    discs = crumbs.select("band", "row", "col", none.alias("region"), none.alias("ring"), none.alias("i"), grid.centre_x(F.col("col")).alias("x"), grid.centre_z(F.col("row")).alias("z"), F.lit(float(crumb_radius)).alias("scale_x"), F.lit(float(crumb_radius)).alias("scale_z"), F.lit(0.0).alias("rotation"), F.lit(None).cast("double").alias("mean"), F.lit(2).alias("pass"))
    both = cut(placed.select(*discs.columns).unionByName(discs))
    bare = both.where("mean IS NULL").select("row", "col").distinct().withColumn("site", F.struct("row", "col"))
    near = nearest_values(bare, raster, "site").select("site.row", "site.col", F.col("value").alias("near"))
    out = both.join(near, ["row", "col"], "left").withColumn("value", F.coalesce("mean", "near"))
    return out.select("band", "pass", "region", "ring", "i", "row", "col", "x", "z", "scale_x", "scale_z", "rotation", "value")
