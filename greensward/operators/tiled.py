"""Rasters of any size, worked on in tiles: connected components, nearest sites, distances, closing, gaps filled by relaxation.

A raster is a table of (row, col), and no task holds more than a tile with its halo, or some whole rows. What crosses tiles goes through Spark: equal
labels across borders as a graph, distances as a scan of columns and then of rows, relaxation in blocks of as many rounds as the halo has cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from .grid import Grid, downsample
from .staging import cut, smallest_reachable


def tile_of(cell: Column | str, tile: int) -> Column:
    return F.floor((F.col(cell) if isinstance(cell, str) else cell) / tile).cast("int")


def in_windows(cells: DataFrame, tile: int, halo: int) -> DataFrame:
    """cells with (tile_row, tile_col) of each tile they lie in, or within halo cells of."""
    reached = lambda c: F.explode(F.sequence(tile_of(F.col(c) - halo, tile), tile_of(F.col(c) + halo, tile)))
    return cells.withColumn("tile_row", reached("row")).withColumn("tile_col", reached("col"))


def components(mask: DataFrame, grid: Grid, tile: int = 256, eight: bool = False, key: str | None = None) -> DataFrame:
    """(key, row, col, label) of the cells (key, row, col) of mask, a mask for each whole number key, or one: label is 1 + the row-major place of the
    first cell of the cell's component.

    Tiles are labelled alone; labels that meet across a border are edges of a graph of labels, whose components rename them."""
    cols, size = grid.cols, grid.rows * grid.cols

    def label(frame: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(frame["row"].min()), int(frame["col"].min())
        on = np.zeros((int(frame["row"].max()) - r0 + 1, int(frame["col"].max()) - c0 + 1), bool)
        on[frame["row"] - r0, frame["col"] - c0] = True
        rows, at = np.nonzero(on)
        first_row, first_col = np.divmod(K.labels(on, eight)[rows, at].astype(np.int64) - 1, on.shape[1])
        of = int(frame["of"].iloc[0])
        return pd.DataFrame({"of": of, "row": rows + r0, "col": at + c0, "label": of * size + (first_row + r0) * cols + first_col + c0})

    cells = mask.select((F.lit(0) if key is None else F.col(key)).cast("long").alias("of"), "row", "col").distinct()
    local = cut(cells.groupBy("of", tile_of("row", tile).alias("tile_row"), tile_of("col", tile).alias("tile_col")).applyInPandas(label, "of long, row int, col int, label long"))
    slant = F.explode(F.array(*map(F.lit, (-1, 0, 1) if eight else (0,)))).alias("slant")
    meeting = []
    for axis, other in (("row", "col"), ("col", "row")):
        last = local.where(F.col(axis) % tile == tile - 1).select("of", (F.col(axis) + 1).alias(axis), F.col(other).alias("from"), F.col("label").alias("a"), slant)
        next_ = local.where(F.col(axis) % tile == 0).select("of", axis, other, F.col("label").alias("b"))
        meeting.append(last.withColumn(other, F.col("from") + F.col("slant")).join(next_, ["of", axis, other]).select("a", "b"))
    root = smallest_reachable(meeting[0].unionByName(meeting[1]).distinct())
    named = local.join(root.withColumnRenamed("node", "label"), "label", "left").withColumn("label", F.coalesce("least", "label") - F.col("of") * size + 1)
    return named.select(*([] if key is None else [F.col("of").cast(mask.schema[key].dataType).alias(key)]), "row", "col", "label")


def closed(mask: DataFrame, radius: int, key: str | None = None) -> DataFrame:
    """(key, row, col) of mask grown by squares of 2 radius + 1 cells and shrunk again, axis by axis; cells outside a raster are cells like others."""
    places = lambda axis: F.explode(F.sequence(F.col(axis) - radius, F.col(axis) + radius))
    names = ["row", "col"] if key is None else [key, "row", "col"]
    out = mask.select(names).distinct()
    for axis in ("row", "col"):
        out = out.withColumn(axis, places(axis)).distinct()
    for axis in ("row", "col"):
        out = out.withColumn(axis, places(axis)).groupBy(names).count().where(F.col("count") == 2 * radius + 1).select(names)
    return out


def denoised(mask: DataFrame, grid: Grid, radius: int, tile: int = 256, key: str | None = None) -> DataFrame:
    """(key, row, col) of mask closed by radius, without components smaller than half the square of 2 radius + 1 cells."""
    names = ["row", "col"] if key is None else [key, "row", "col"]
    if radius <= 0:
        return mask.select(names).distinct()
    inside = closed(mask, radius, key).where(F.col("row").between(0, grid.rows - 1) & F.col("col").between(0, grid.cols - 1))
    labelled = components(inside, grid, tile, key=key)
    by = [n for n in names if n == key] + ["label"]
    large = labelled.groupBy(by).count().where(F.col("count") >= max(1, (2 * radius + 1) ** 2 // 2)).select(by)
    return labelled.join(large, by, "left_semi").select(names)


def nearest_in_rows(row: np.ndarray, near: np.ndarray, cell_z: float, cell_x: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each cell of some rows, given the nearest site of its own column (NaN: none): the nearest site of all and its distance; at a tie that with
    the smaller row, then column. Offsets are tried outwards and a cell is done when the offset alone is farther than its best site."""
    n = near.shape[1]
    square = ((near - row[:, None]) * cell_z) ** 2
    square[np.isnan(near)] = np.inf
    best, best_row, best_col = square.copy(), near.copy(), np.where(np.isnan(near), np.nan, np.arange(n, dtype=float))
    i, c = np.nonzero(np.ones(near.shape, bool))
    for k in range(1, n):
        add = (k * cell_x) ** 2
        open_ = add <= best[i, c]
        i, c = i[open_], c[open_]
        if not len(i):
            break
        for to in (c - k, c + k):
            held = (to >= 0) & (to < n)
            a, b, t = i[held], c[held], to[held]
            d, r = square[a, t] + add, near[a, t]
            less = (d < best[a, b]) | (d == best[a, b]) & ((r < best_row[a, b]) | (r == best_row[a, b]) & (t < best_col[a, b]))
            a, b, t = a[less], b[less], t[less]
            best[a, b], best_row[a, b], best_col[a, b] = d[less], r[less], t
    return np.sqrt(best), best_row, best_col


def nearest_sites(sites: DataFrame, grid: Grid, wanted: DataFrame | None = None, rows_at_once: int = 16) -> DataFrame:
    """(row, col, near_row, near_col, d) of each cell of the grid, or of wanted: the nearest of sites (row, col) and how far it is in metres; at a tie
    the first in row-major order; null without sites.

    Exact in two scans: the nearest site in a column by windows, then along rows, which tasks hold whole, some at once."""
    dense = grid.cells(sites.sparkSession).join(sites.select("row", "col").distinct().withColumn("site", F.col("row")), ["row", "col"], "left")
    column = W.partitionBy("col").orderBy("row")
    up, down = F.last("site", True).over(column.rowsBetween(W.unboundedPreceding, 0)), F.first("site", True).over(column.rowsBetween(0, W.unboundedFollowing))
    scanned = dense.select("row", "col", up.alias("up"), down.alias("down"))
    scanned = scanned.select("row", "col", F.when(F.col("down").isNull() | (F.col("row") - F.col("up") <= F.col("down") - F.col("row")), F.col("up")).otherwise(F.col("down")).alias("near"))
    cell_z, cell_x, cols = grid.cell_z, grid.cell_x, grid.cols

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        row, i = np.unique(frame["row"].to_numpy(), return_inverse=True)
        near = np.full((len(row), cols), np.nan)
        near[i, frame["col"]] = frame["near"].to_numpy(float, na_value=np.nan)
        d, r, c = nearest_in_rows(row, near, cell_z, cell_x)
        out = pd.DataFrame({"row": np.repeat(row, cols), "col": np.tile(np.arange(cols), len(row)), "near_row": r.ravel(), "near_col": c.ravel(), "d": d.ravel()})
        return out[np.isfinite(out["d"])]

    found = scanned.groupBy(F.floor(F.col("row") / rows_at_once)).applyInPandas(across, "row int, col int, near_row int, near_col int, d double")
    return (grid.cells(sites.sparkSession) if wanted is None else wanted.select("row", "col")).join(found, ["row", "col"], "left")


def depths(mask: DataFrame, grid: Grid, key: str, rows_at_once: int = 16) -> DataFrame:
    """(key, row, col, depth) of each mask (key, row, col): metres to the nearest cell of the raster that isn't in the mask of that key; null if all are.

    Only the masks' cells are stored and shuffled: in a column the nearest cell that is missing stands at an end of the run of cells without a gap."""
    column = W.partitionBy(key, "col").orderBy("row")
    runs = mask.select(key, "row", "col").distinct().withColumn("run", F.col("row") - F.row_number().over(column))
    ends = W.partitionBy(key, "col", "run")
    up, down = F.min("row").over(ends) - 1, F.max("row").over(ends) + 1
    runs = runs.select(key, "row", "col", F.when(up >= 0, up).alias("up"), F.when(down < grid.rows, down).alias("down"))
    near = F.when(F.col("down").isNull() | (F.col("row") - F.col("up") <= F.col("down") - F.col("row")), F.col("up")).otherwise(F.col("down"))
    kind, cell_z, cell_x, cols = mask.schema[key].dataType.simpleString(), grid.cell_z, grid.cell_x, grid.cols

    def across(frame: pd.DataFrame) -> pd.DataFrame:
        row, i = np.unique(frame["row"].to_numpy(), return_inverse=True)
        first = max(0, int(frame["col"].min()) - 1)
        c = frame["col"].to_numpy() - first
        sites = np.repeat(row[:, None].astype(float), min(cols, int(frame["col"].max()) + 2) - first, axis=1)
        sites[i, c] = frame["near"].to_numpy(float, na_value=np.nan)
        d = nearest_in_rows(row, sites, cell_z, cell_x)[0][i, c]
        return pd.DataFrame({key: frame[key], "row": frame["row"], "col": frame["col"], "depth": pd.Series(d, index=frame.index).where(np.isfinite(d), None)})

    found = runs.select(key, "row", "col", near.alias("near")).groupBy(key, F.floor(F.col("row") / rows_at_once))
    return found.applyInPandas(across, f"{key} {kind}, row int, col int, depth double")


def distances(raster: DataFrame, grid: Grid) -> DataFrame:
    """(row, col, d): metres from the centre of each cell with data to that of the nearest without; null where all have data."""
    known = raster.where("h IS NOT NULL").select("row", "col")
    return nearest_sites(grid.cells(raster.sparkSession).join(known, ["row", "col"], "left_anti"), grid, known).select("row", "col", "d")


def nearest_filled(raster: DataFrame, grid: Grid, far: float | None = None) -> DataFrame:
    """(row, col, h, known) of all cells; those without data have the value of the nearest cell with data, or null if that is over far metres off."""
    known = raster.where("h IS NOT NULL").select("row", "col", "h")
    near = nearest_sites(known, grid)
    if far is not None:
        near = near.withColumn("near_row", F.when(F.col("d") <= far, F.col("near_row")))
    value = known.select(F.col("row").alias("near_row"), F.col("col").alias("near_col"), "h")
    return near.join(value, ["near_row", "near_col"], "left").select("row", "col", "h", F.coalesce(F.col("d") == 0, F.lit(False)).alias("known"))


def finer(raster: DataFrame, coarse: Grid, fine: Grid) -> DataFrame:
    """(row, col, h) of all fine cells, linear between the dense coarse ones in both axes, corners on corners."""

    def steps(name: str, n: int, m: int) -> Column:
        at = F.col(name) * ((n - 1) / (m - 1) if m > 1 else 0.0)
        low = F.least(F.floor(at), F.lit(max(0, n - 2))).cast("int")
        return F.explode(F.array(F.struct(low.alias("at"), (1 - (at - low)).alias("w")), F.struct(F.least(low + 1, F.lit(n - 1)).alias("at"), (at - low).alias("w"))))

    corners = fine.cells(raster.sparkSession).withColumn("r", steps("row", coarse.rows, fine.rows)).withColumn("c", steps("col", coarse.cols, fine.cols))
    value = raster.select(F.col("row").alias("r_at"), F.col("col").alias("c_at"), "h")
    met = corners.select("row", "col", F.col("r.at").alias("r_at"), F.col("c.at").alias("c_at"), (F.col("r.w") * F.col("c.w")).alias("w")).join(value, ["r_at", "c_at"])
    return met.groupBy("row", "col").agg(F.sum(F.col("w") * F.col("h")).alias("h"))


def relaxed(dense: DataFrame, grid: Grid, rounds: int, tolerance: float, tile: int = 256, halo: int = 32) -> DataFrame:
    """(row, col, h, known): cells that aren't known become the mean of their four neighbours, edges repeated, until none changes by tolerance in
    a round, or for so many rounds. A window runs halo rounds alone, after which its tile's cells are as if all cells had run them; a raster of
    one tile runs them all at once."""
    if grid.rows <= tile and grid.cols <= tile:
        halo = rounds

    def run(frames: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        frame = frames
        r0, c0 = int(frame["row"].min()), int(frame["col"].min())
        h = np.zeros((int(frame["row"].max()) - r0 + 1, int(frame["col"].max()) - c0 + 1))
        free = np.zeros(h.shape, bool)
        at = frame["row"] - r0, frame["col"] - c0
        h[at], free[at] = frame["h"], ~frame["known"].to_numpy(bool)
        before = h
        for _ in range(halo if free.any() else 0):
            before, h = h, K.relax(h, free, 1, 0.0)
            if np.abs(h - before).max() < tolerance / 10:
                break  # here nothing changes any more, and the next block would tell if it did
        out = pd.DataFrame({"row": frame["row"], "col": frame["col"], "h": h[at], "known": frame["known"], "change": np.abs(h - before)[at]})
        return out[(frame["row"] // tile == frame["tile_row"]) & (frame["col"] // tile == frame["tile_col"])]

    for _ in range(0, rounds, max(1, halo)):
        windows = in_windows(dense.select("row", "col", "h", "known"), tile, min(halo, max(grid.rows, grid.cols)))
        inside = windows.where(F.col("tile_row").between(0, (grid.rows - 1) // tile) & F.col("tile_col").between(0, (grid.cols - 1) // tile))
        dense = cut(inside.groupBy("tile_row", "tile_col").applyInPandas(run, "row int, col int, h double, known boolean, change double"))
        if dense.where(F.col("change") >= tolerance).isEmpty():
            break
    return dense.select("row", "col", "h", "known")


def nearest_values(sites: DataFrame, raster: DataFrame, key: str, far: int = 50) -> DataFrame:
    """(key, value) of sites (key, row, col): the height of their cell or, where it has none, of a cell of the smallest square about it that has any, the
    nearest one of that square, in row-major order at a tie; 0 if none is within far cells. Few sites need a search; squares of 2 cells are tried first."""
    known = raster.where("h IS NOT NULL").select("row", "col", "h")
    here = sites.select(key, "row", "col").join(known, ["row", "col"], "left")
    parts, left = [here.where("h IS NOT NULL").select(key, F.col("h").alias("value"))], cut(here.where("h IS NULL").select(key, "row", "col"))
    for reach in (min(2, far), far):
        if left.isEmpty():
            break
        step = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
        around = left.withColumn("dr", step).withColumn("dc", step).select(key, "dr", "dc", (F.col("row") + F.col("dr")).alias("row"), (F.col("col") + F.col("dc")).alias("col"))
        order = F.struct(F.greatest(F.abs("dr"), F.abs("dc")).alias("square"), (F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")).alias("d"), "row", "col")
        parts.append(cut(around.join(known, ["row", "col"]).groupBy(key).agg(F.min_by("h", order).alias("value"))))
        left = cut(left.join(parts[-1], key, "left_anti"))
    out = left.select(key, F.lit(0.0).alias("value"))
    for part in parts:
        out = out.unionByName(part)
    return out


def gap_filled(raster: DataFrame, grid: Grid, rounds: int = 200, tolerance: float = 1e-4, smallest: int = 32, tile: int = 256, halo: int = 32) -> DataFrame:
    """(row, col, h, known) of all cells: those with data keep their values, the others settle to the mean of their neighbours, from coarse to fine.

    The raster is halved until a side would be under `smallest`; the coarsest level starts from the nearest cells with data and may take four times
    the rounds, a finer one from the level before. A raster without any data gives no heights (null)."""
    raster = cut(raster.where("h IS NOT NULL").select("row", "col", "h"))
    n = raster.count()
    if n == 0:
        return grid.cells(raster.sparkSession).withColumns({"h": F.lit(None).cast("double"), "known": F.lit(False)})
    if n == grid.rows * grid.cols:
        return raster.withColumn("known", F.lit(True))
    grids = [grid]
    while max(grids[-1].rows, grids[-1].cols) > smallest:
        rows, cols = (max(min(n, smallest), n // 2) for n in (grids[-1].rows, grids[-1].cols))
        grids.append(Grid(rows, cols, grid.min_x, grid.min_z, grid.max_x, grid.max_z))
    out = None
    for k in range(len(grids) - 1, -1, -1):
        level = raster if k == 0 else downsample(raster, grid, grids[k])
        if out is None:
            start = nearest_filled(level, grids[k])
        else:
            known = level.where("h IS NOT NULL").select("row", "col", F.col("h").alias("own"))
            start = finer(out, grids[k + 1], grids[k]).join(known, ["row", "col"], "left").select("row", "col", F.coalesce("own", "h").alias("h"), F.col("own").isNotNull().alias("known"))
        out = relaxed(cut(start), grids[k], rounds * (4 if k == len(grids) - 1 else 1), tolerance, tile, halo)
    return out
