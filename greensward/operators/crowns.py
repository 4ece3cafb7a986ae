"""Tree crowns on rasters of any size: the height of the vegetation over the ground, cut into crowns about its inner points.

Filters look only a little way, so they run in tiles with a halo; distances, connected patches and peaks are those of `tiled`. Flooding from peaks stays within a
connected patch of crown cells, so patches, not rasters or tiles, are its groups, and only those with several peaks need it: what crosses a tile's
border is found once, and labels are those of the whole raster.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from .grid import Grid
from .staging import cut
from .tiled import components, depths, gap_filled, in_windows


def filtered(dense: DataFrame, grid: Grid, name: str, kernel: Callable[[np.ndarray], dict[str, np.ndarray]], schema: str, tile: int, halo: int) -> DataFrame:
    """(row, col, schema) of all cells: kernel on the array of name in a tile and halo cells about it, clipped at the raster's edges; missing cells are 0."""
    inside = F.col("tile_row").between(0, (grid.rows - 1) // tile) & F.col("tile_col").between(0, (grid.cols - 1) // tile)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        top, left = int(frame["tile_row"].iloc[0]) * tile, int(frame["tile_col"].iloc[0]) * tile
        r0, c0 = max(0, top - halo), max(0, left - halo)
        array = np.zeros((min(grid.rows, top + tile + halo) - r0, min(grid.cols, left + tile + halo) - c0))
        array[frame["row"] - r0, frame["col"] - c0] = frame[name]
        found = kernel(array)
        rows, cols = np.meshgrid(np.arange(top, min(grid.rows, top + tile)), np.arange(left, min(grid.cols, left + tile)), indexing="ij")
        return pd.DataFrame({"row": rows.ravel(), "col": cols.ravel()} | {k: v[rows - r0, cols - c0].ravel() for k, v in found.items()})

    return in_windows(dense.select("row", "col", name), tile, halo).where(inside).groupBy("tile_row", "tile_col").applyInPandas(run, f"row int, col int, {schema}")


def canopy_height(ground: DataFrame, canopy: DataFrame, grid: Grid, outlier: float = 40.0, **more) -> DataFrame:
    """(row, col, h) of all cells: how far the canopy stands over the ground, 0 without vegetation. Gaps of the ground are filled first, heights over outlier
    are taken for errors and filled too."""
    base = gap_filled(ground, grid, **more).select("row", "col", F.col("h").alias("g"))
    over = base.join(canopy.select("row", "col", F.col("h").alias("c")), ["row", "col"], "left").select("row", "col", (F.coalesce("c", "g") - F.col("g")).alias("h"))
    return gap_filled(cut(over.where(F.col("h") <= outlier)), grid, **more).select("row", "col", F.greatest("h", F.lit(0.0)).alias("h"))


def flooded(cells: DataFrame, key: str) -> DataFrame:
    """(row, col, label) of patches (key, row, col, depth, seed): cells without a seed get that of the neighbour that reaches them first, deepest cells first."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r, c = frame["row"].to_numpy() - frame["row"].min(), frame["col"].to_numpy() - frame["col"].min()
        height, seeds, mask = np.zeros((r.max() + 1, c.max() + 1)), np.zeros((r.max() + 1, c.max() + 1), np.int64), np.zeros((r.max() + 1, c.max() + 1), bool)
        height[r, c], seeds[r, c], mask[r, c] = -frame["depth"], frame["seed"].fillna(0).astype(np.int64), True
        return pd.DataFrame({"row": frame["row"], "col": frame["col"], "label": K.watershed(height, seeds, mask)[r, c]})

    return cells.groupBy(key).applyInPandas(run, "row int, col int, label long").where("label > 0")


def crowns(height: DataFrame, grid: Grid, sigma: float = 1.5, block: float = 20.0, apart: float = 2.0, least: float = 3.5, floor: float = 1.0, tile: int = 256) -> DataFrame:
    """(label, row, col, radius, height) of the crowns in a dense raster of heights over the ground (row, col, h): row and col are the mean of the crown's
    cells, the radius that of a disc of their area in metres, the height that of the cell at the middle; crowns under least metres are left out.

    A cell is in a crown if it is over floor and, smoothed by sigma metres, over the mean of the block about it. Crowns grow from the cells farthest from
    others, within apart metres."""
    cell = grid.cell_x
    smooth, mean, reach = max(sigma / cell, 0.5), max(3, int(block / cell) | 1), max(1, int(apart / cell))

    def vegetation(h: np.ndarray) -> dict[str, np.ndarray]:
        low = K.gaussian(h, smooth)
        return {"h": h, "crown": (h > floor) & (low - K.box_mean(low, mean) > 1e-9)}

    marked = cut(filtered(height, grid, "h", vegetation, "h double, crown boolean", tile, int(4 * smooth + 0.5) + mean // 2))
    inside = marked.where("crown").select("row", "col", F.lit(0).alias("all"))
    cells = Grid(grid.rows, grid.cols, 0.0, 0.0, float(grid.cols), float(grid.rows))  # depths are counted in cells, so equal ones are equal
    deep = cut(depths(inside, cells, "all").select("row", "col", F.coalesce("depth", F.lit(0.0)).alias("depth")))
    tops = filtered(deep, grid, "depth", lambda d: {"top": K.peaks(d, reach)}, "top boolean", tile, reach).where("top")
    seeds = components(tops, grid, tile, eight=True).withColumnRenamed("label", "seed")
    patches = cut(components(inside, grid, tile).withColumnRenamed("label", "patch").join(deep, ["row", "col"]).join(seeds, ["row", "col"], "left"))
    seeded = patches.groupBy("patch").agg(F.min("seed").alias("one"), F.max("seed").alias("other")).where("one IS NOT NULL")
    alone = patches.select("patch", "row", "col").join(seeded.where("one = other").select("patch", F.col("one").alias("label")), "patch").select("row", "col", "label")
    several = flooded(patches.join(seeded.where("one <> other").select("patch"), "patch", "left_semi"), "patch")
    found = alone.unionByName(several).groupBy("label").agg(F.avg("row").alias("row"), F.avg("col").alias("col"), F.count("*").alias("n"))
    middle = marked.select(F.col("row").alias("at_row"), F.col("col").alias("at_col"), F.col("h").alias("height"))
    found = found.withColumns({"at_row": F.rint("row").cast("int"), "at_col": F.rint("col").cast("int")}).join(middle, ["at_row", "at_col"]).where(F.col("height") >= least)
    return found.select("label", "row", "col", (F.sqrt(F.col("n") / math.pi) * cell).alias("radius"), "height")


def trees(ground: DataFrame, canopy: DataFrame, grid: Grid, outlier: float = 40.0, tile: int = 256, **more) -> DataFrame:
    """(x, z, radius, height) of crowns in the canopy over the ground."""
    found = crowns(canopy_height(ground, canopy, grid, outlier, tile=tile), grid, tile=tile, **more)
    return found.select((grid.min_x + (F.col("col") + 0.5) * grid.cell_x).alias("x"), (grid.min_z + (F.col("row") + 0.5) * grid.cell_z).alias("z"), "radius", "height")
