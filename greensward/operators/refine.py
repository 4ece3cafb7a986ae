"""Refinement: stamps put where the terrain is off most widely, in the order of the deepest place first.

A hotspot is the cell deepest within an area that is too high, or too low, by more than a tolerance: the one farthest from any cell that isn't. Its stamp
claims the cells around it, which makes cells nearby less deep, and the next deepest follows. That loop is sequential, but a claim reaches only so far. So
windows (tiles with a halo) run it side by side, and a window takes a place only if nothing that it can't see could change that place: neither a claim from
beyond its edge, nor one of a deeper place that is itself uncertain. What is certain in the tile's own cells is told to all, and in the next round every window runs
again from the start, with the places known by then taken when their turn comes. So the places found are those of the sequential loop, with the depths
they have there. If no window is certain of anything new the halo is doubled, up to the whole raster at worst.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import Grid, circle_cells, downsample
from .staging import cut, numbered
from .stamps import affine_blocks, candidate_scores, effects, fold, render
from .tiled import in_windows, nearest_in_rows


@dataclass(frozen=True)
class Refinement:
    """What a pass looks for. Radii in metres; `claim` is the share of a stamp's radius that is done with it; `spread` widens a stamp by its brush's place
    in `brushes`; `planar` shrinks a radius, by `shrink` at a time, until the ground in it is a plane up to that RMS."""

    tolerance: float
    smallest: float = 25.0
    largest: float = 50.0
    claim: float = 1.0
    spread: float = 1.0
    least_cells: float = 1.0
    least_points: int = 3
    planar: float | None = None
    shrink: float = 0.75
    brushes: tuple[int, ...] = (8, 9, 10, 54)

    @property
    def widest(self) -> float:
        return max(self.spread**k for k in range(len(self.brushes)))


def depths(flagged: np.ndarray, cell_z: float, cell_x: float) -> np.ndarray:
    """Distance of each flagged cell to the nearest other one; inf where there is none, 0 for the others."""
    row = np.arange(len(flagged), dtype=float)
    other = np.where(flagged, np.nan, row[:, None])
    up = np.fmax.accumulate(other, axis=0)
    down = np.fmin.accumulate(other[::-1], axis=0)[::-1]
    near = np.where(np.isnan(down) | (row[:, None] - up <= down - row[:, None]), up, down)
    return nearest_in_rows(row, near, cell_z, cell_x)[0]


def plane_rms(x: np.ndarray, z: np.ndarray, h: np.ndarray) -> float:
    if len(h) < 3:
        return 0.0
    plane = np.column_stack((x - x.mean(), z - z.mean(), np.ones(len(x))))
    return float(np.sqrt(np.mean((h - plane @ np.linalg.lstsq(plane, h, rcond=None)[0]) ** 2)))


class Window:
    """The cells (error, done) of a window whose first cell is `first`, `inner` its tile's rows and columns, and the ground's points (x, z, h) in it."""

    def __init__(self, error: np.ndarray, done: np.ndarray, first: tuple[int, int], inner: tuple[slice, slice], points: tuple[np.ndarray, np.ndarray, np.ndarray], grid: Grid, how: Refinement):
        self.error, self.done, self.first, self.points, self.grid, self.how = error, done, first, points, grid, how
        self.inside = np.zeros(error.shape, bool)
        self.inside[inner] = True
        ends = []  # metres to the first cell of the raster beyond the window
        for axis, (n, total, cell) in enumerate(zip(error.shape, (grid.rows, grid.cols), (grid.cell_z, grid.cell_x))):
            at = np.arange(n)
            before = np.where(first[axis] > 0, (at + 1) * cell, np.inf)
            behind = np.where(first[axis] + n < total, (n - at) * cell, np.inf)
            ends.append(np.minimum(before, behind))
        self.edge = np.minimum(ends[0][:, None], ends[1][None, :])

    def around(self, i: int, j: int, reach: float) -> tuple[tuple[slice, slice], np.ndarray]:
        """The box of cells within reach of a cell, which may lie outside, and their distances to it."""
        sizes = self.grid.cell_z, self.grid.cell_x
        box, apart = [], []
        for at, n, cell in zip((i, j), self.error.shape, sizes):
            k = int(min(reach, 1e9) / cell) + 1
            box.append(slice(min(n, max(0, at - k)), max(0, min(n, at + k + 1))))
            apart.append(((np.arange(box[-1].start, box[-1].stop) - at) * cell) ** 2)
        return (box[0], box[1]), np.sqrt(apart[0][:, None] + apart[1][None, :])

    def base_radius(self, i: int, j: int, depth: float) -> tuple[float, float] | None:
        """(radius, the radius its points are taken from); None where the ground has too few points."""
        how, (x, z, h) = self.how, self.points
        base = min(max(depth, how.smallest), how.largest)
        reach = min(how.largest, base * how.widest)
        cx, cz = self.grid.min_x + (self.first[1] + j + 0.5) * self.grid.cell_x, self.grid.min_z + (self.first[0] + i + 0.5) * self.grid.cell_z
        apart = (x - cx) ** 2 + (z - cz) ** 2
        if (apart <= reach * reach).sum() < how.least_points:
            return None
        while how.planar is not None and base > how.smallest:
            near = apart <= base * base
            if near.sum() < how.least_points or plane_rms(x[near], z[near], h[near]) <= how.planar:
                break
            base = max(base * how.shrink, how.smallest)
        return base, reach

    def side(self, sign: int, known: list[tuple[int, int, float, float]]) -> tuple[list[tuple], bool]:
        """New certain hotspots of the window's own tile, where the terrain is too high (1) or too low (-1), and whether it has uncertain ones.
        known: places found before (row and column in the window, depth, radius claimed), also those that only reach into the window."""
        how, grid = self.how, self.grid
        flagged = (sign * np.nan_to_num(self.error) > how.tolerance) & ~self.done
        depth = np.where(flagged, depths(flagged, grid.cell_z, grid.cell_x), 0.0)
        farthest = how.largest * how.claim
        seen = how.largest + np.hypot(grid.cell_z, grid.cell_x)  # the points of a stamp's surroundings are in the window
        uncertain = flagged & (self.edge <= np.maximum(depth + farthest, seen)) & np.isfinite(self.edge)
        if np.isinf(self.edge).all():  # the window is the whole raster: where every cell is flagged there is no depth, and no deepest place
            flagged &= np.isfinite(depth)
        least = how.least_cells * min(grid.cell_z, grid.cell_x)
        key = np.where(flagged & (depth >= least), depth, -1.0)

        def take(i: int, j: int, claim: float, deep: float) -> tuple[np.ndarray, np.ndarray]:
            """Claim the cells about a place; others, none deeper than deep, become as deep as they are far from those."""
            box, apart = self.around(i, j, claim)
            rows, cols = np.nonzero(flagged[box] & (apart <= claim))
            rows, cols = rows + box[0].start, cols + box[1].start
            flagged[rows, cols], key[rows, cols], depth[rows, cols] = False, -1.0, 0.0
            box, _ = self.around(i, j, claim + deep)
            left = np.argwhere(key[box] >= 0) + (box[0].start, box[1].start)
            for part in np.array_split(left, len(left) * len(rows) // 1_000_000 + 1):
                near = np.sqrt(((part[:, :1] - rows) * grid.cell_z) ** 2 + ((part[:, 1:] - cols) * grid.cell_x) ** 2).min(axis=1, initial=np.inf)
                at = part[:, 0], part[:, 1]
                key[at] = depth[at] = np.minimum(depth[at], near)
            return rows, cols

        turns = sorted(known, key=lambda k: (-k[2], k[0], k[1]))
        for i, j, _, _ in turns:
            if 0 <= i < key.shape[0] and 0 <= j < key.shape[1]:
                key[i, j] = -1.0
        found, open_ = [], False
        while True:
            i, j = map(int, np.unravel_index(int(np.argmax(key)), key.shape))
            deep = float(key[i, j])
            if turns and (deep < least or (-turns[0][2], turns[0][0], turns[0][1]) < (-deep, i, j)):
                a, b, before, claim = turns.pop(0)
                take(a, b, claim, before)
            elif deep < least or deep <= 0:
                return found, open_
            elif uncertain[i, j]:
                key[i, j] = -1.0
                open_ |= bool(self.inside[i, j])
                box, apart = self.around(i, j, farthest + deep)
                uncertain[box] |= flagged[box] & (apart <= farthest + depth[box])
            else:
                radius = self.base_radius(i, j, deep)
                rows, cols = take(i, j, 0.0 if radius is None else radius[0] * how.claim, deep)
                if self.inside[i, j]:
                    cells = ((rows + self.first[0]) * grid.cols + cols + self.first[1]).tolist()
                    found.append((i + self.first[0], j + self.first[1], sign, deep, *(radius or (None, None)), float(self.error[i, j]), cells))


FOUND = "row int, col int, side int, depth double, radius double, reach double, error double, claims array<long>"


def in_tile(grid: Grid, tile: int) -> Column:
    return F.col("tile_row").between(0, (grid.rows - 1) // tile) & F.col("tile_col").between(0, (grid.cols - 1) // tile)


def sides(cells: pd.DataFrame, points: tuple[np.ndarray, np.ndarray, np.ndarray], signs: tuple[int, ...], grid: Grid, how: Refinement, tile: int, halo: int) -> list[tuple]:
    """Rows FOUND of one window's rows (tile_row, tile_col, row, col, error, done) and the known places (side, depth, claim) among them."""
    top, left = int(cells["tile_row"].iloc[0]) * tile, int(cells["tile_col"].iloc[0]) * tile
    r0, c0 = max(0, top - halo), max(0, left - halo)
    shape = min(grid.rows, top + tile + halo) - r0, min(grid.cols, left + tile + halo) - c0
    error, done = np.full(shape, np.nan), np.zeros(shape, bool)
    place = cells["side"].notna()
    own, known = cells[~place], cells[place]
    at = own["row"] - r0, own["col"] - c0
    error[at], done[at] = own["error"], own["done"].astype(bool)
    inner = slice(top - r0, top - r0 + tile), slice(left - c0, left - c0 + tile)
    window, out = Window(error, done, (r0, c0), inner, points, grid, how), []
    for sign in signs:
        here = known[known["side"] == sign]
        found, open_ = window.side(sign, list(zip((here["row"] - r0).tolist(), (here["col"] - c0).tolist(), here["depth"].tolist(), here["claim"].tolist())))
        out += found + [(None,) * 8] * open_
    return out


NAMES = ["row", "col", "side", "depth", "radius", "reach", "error", "claims"]


def window_rows(state: DataFrame, known: DataFrame | None, grid: Grid, how: Refinement, tile: int, halo: int, keys: list[str]) -> DataFrame:
    """Rows of the windows: cells of state (keys, row, col, error, done), and known places (keys, row, col, side, depth, radius) that reach into a window."""
    no = F.lit(None).cast("double")
    rows = in_windows(state.select(*keys, "row", "col", "error", "done"), tile, halo).withColumns({"side": F.lit(None).cast("int"), "depth": no, "claim": no})
    if known is not None:
        wider = halo + int(how.largest * how.claim / min(grid.cell_z, grid.cell_x)) + 1
        places = known.select(*keys, "row", "col", no.alias("error"), F.lit(True).alias("done"), "side", "depth", F.coalesce(F.col("radius") * how.claim, F.lit(0.0)).alias("claim"))
        rows = rows.unionByName(in_windows(places, tile, wider))
    return rows.where(in_tile(grid, tile))


def certain_hotspots(state: DataFrame, known: DataFrame | None, raster: DataFrame, fine: Grid, coarse: Grid, how: Refinement, tile: int, halo: int) -> DataFrame:
    """Rows FOUND of state (row, col, error, done) that aren't known yet: hotspots certain by now (radius null: too few points, only the cell is claimed), and
    a row without a place for each window that has uncertain ones."""
    z, x = fine.centre_z(F.col("row")), fine.centre_x(F.col("col"))
    points = raster.where("h IS NOT NULL").select(x.alias("x"), z.alias("z"), "h", coarse.row_of(z).alias("row"), coarse.col_of(x).alias("col"))
    windows = window_rows(state, known, coarse, how, tile, halo, []).groupBy("tile_row", "tile_col")

    def run(cells: pd.DataFrame, ground: pd.DataFrame) -> pd.DataFrame:
        out = sides(cells, tuple(ground[c].to_numpy(float) for c in ("x", "z", "h")), (1, -1), coarse, how, tile, halo) if len(cells) else []
        return pd.DataFrame(out, columns=NAMES, dtype=object)

    return windows.cogroup(in_windows(points, tile, halo).where(in_tile(coarse, tile)).groupBy("tile_row", "tile_col")).applyInPandas(run, FOUND)


def deepest_first(mask: DataFrame, grid: Grid, claim: float, key: str, tile: int = 64, halo: int = 32) -> DataFrame:
    """(key, row, col, depth) of cells that cover each mask (key, row, col) by discs of radius claim: each time the deepest cell that isn't covered yet, the
    first in row-major order at a tie. Depth is the distance to the nearest cell of the raster that isn't in the mask, or is covered; a mask that fills the
    raster has none, and no places."""
    how = Refinement(tolerance=0.5, smallest=claim, largest=claim, least_cells=0.0, least_points=0)
    kind, none = mask.schema[key].dataType.simpleString(), (np.zeros(0),) * 3

    def run(cells: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(sides(cells, none, (1,), grid, how, tile, halo), columns=NAMES, dtype=object)
        out.insert(0, key, cells[key].iloc[0])
        return out

    state, known = cut(mask.select(key, "row", "col").distinct().withColumns({"error": F.lit(1.0), "done": F.lit(False)})), None
    while True:
        found = cut(window_rows(state, known, grid, how, tile, halo, [key]).groupBy(key, "tile_row", "tile_col").applyInPandas(run, f"{key} {kind}, {FOUND}"))
        here = found.where("row IS NOT NULL").drop("claims")
        known = here if known is None else known.unionByName(here)
        if found.where("row IS NULL").isEmpty():
            return known.select(key, "row", "col", "depth")
        if here.isEmpty():
            halo *= 2


def scored(places: DataFrame, stamps: DataFrame, raster: DataFrame, now: DataFrame, fine: Grid, profiles: DataFrame, how: Refinement) -> DataFrame:
    """Hotspots (hotspot, x, z, radius, reach, ...) with brush, tool, value, rms and placed, the radius the stamp gets. now: (row, col, h) of the terrain at fine cells."""
    centre = fold(effects(places, stamps, profiles, ["hotspot"]), ["hotspot"])
    at = places.join(centre, "hotspot", "left").withColumn("current", F.coalesce("h", F.lit(0.0))).drop("h")
    ground = raster.where("h IS NOT NULL").join(now.select("row", "col", F.col("h").alias("now")), ["row", "col"], "left")
    cells = circle_cells(at.select("hotspot", "x", "z", "reach"), ground.select("row", "col", F.struct(F.col("h").alias("actual"), F.coalesce("now", F.lit(0.0)).alias("current")).alias("h")), fine, F.col("reach"))
    samples = cells.select("hotspot", fine.centre_x(F.col("col")).alias("x"), fine.centre_z(F.col("row")).alias("z"), "h.actual", "h.current")
    best = candidate_scores(samples, at, profiles, how.brushes)
    rank = F.array_position(F.array(*map(F.lit, how.brushes)), F.col("brush")) - 1
    wide = F.greatest(F.lit(how.smallest), F.least(F.col("radius") * F.pow(F.lit(how.spread), rank), F.lit(how.largest)))
    return at.drop("current").join(best, "hotspot").withColumn("placed", wide)


def hotspots(stamps: DataFrame, raster: DataFrame, fine: Grid, coarse: Grid, profiles: DataFrame, how: Refinement, mask: DataFrame | None = None, tile: int = 64, halo: int = 32, rebuild: bool = False) -> DataFrame:
    """Hotspots of one pass: (hotspot, row, col, side, depth, radius, reach, error, x, z, brush, tool, value, rms, placed), numbered in the sequential order.

    The error is the terrain of stamps less the mean ground in a coarse cell; cells without ground, or not in mask (row, col), aren't looked at. With
    rebuild each round's stamps are in the terrain when the next round looks, and only the cells they touch are rendered again; the order of rounds then
    matters, and results are no longer those of the loop on one terrain."""
    ground = cut(raster.where("h IS NOT NULL").select("row", "col", "h"))
    actual = downsample(ground, fine, coarse)
    if mask is not None:
        actual = actual.join(mask.select("row", "col").distinct(), ["row", "col"])
    now = cut(render(fine, stamps, profiles))
    off = F.coalesce("now", F.lit(0.0)) - F.col("actual")
    model = render(coarse, stamps, profiles).withColumnRenamed("h", "now")
    state = cut(actual.withColumnRenamed("h", "actual").join(model, ["row", "col"], "left").select("row", "col", "actual", F.coalesce("now", F.lit(0.0)).alias("now"), off.alias("error"), F.lit(False).alias("done")))
    base = cut(stamps.select("seq", "x", "z", "scale_x", "scale_z", "value", "brush", "rotation", "tool"))
    x, z = coarse.centre_x(F.col("col")), coarse.centre_z(F.col("row"))
    order = (F.desc("depth"), F.desc("side"), F.col("row"), F.col("col"))
    known, rounds = None, 0
    while True:
        found = cut(certain_hotspots(state.select("row", "col", "error", "done"), None if rebuild else known, ground, fine, coarse, how, tile, halo))
        here = found.where("row IS NOT NULL").withColumns({"x": x, "z": z, "round": F.lit(rounds)})
        places = here.drop("claims")
        if rebuild:
            places = cut(scored(numbered(places.where("radius IS NOT NULL"), "hotspot", *order), base, ground, now, fine, profiles, how))
            added = as_stamps(places, base)
            places = places.drop("hotspot")
            for grid in (fine, coarse):
                cells = grid.cells(stamps.sparkSession).withColumns({"x": grid.centre_x(F.col("col")), "z": grid.centre_z(F.col("row"))})
                touched = affine_blocks(effects(cells, added, profiles, ["row", "col"]), ["row", "col"], 1 << 62).select("row", "col", "a", "b")
                later = lambda h: F.coalesce(F.col("a"), F.lit(1.0)) * h + F.coalesce(F.col("b"), F.lit(0.0))
                if grid is fine:
                    now = cut(now.join(touched, ["row", "col"], "full").select("row", "col", later(F.coalesce("h", F.lit(0.0))).alias("h")))
                else:
                    claimed = here.select(F.explode("claims").alias("at")).distinct().select(F.floor(F.col("at") / coarse.cols).cast("int").alias("row"), (F.col("at") % coarse.cols).cast("int").alias("col"), F.lit(True).alias("_claimed"))
                    after = state.join(touched, ["row", "col"], "left").join(claimed, ["row", "col"], "left").withColumn("now", later(F.col("now")))
                    state = cut(after.withColumn("error", F.col("now") - F.col("actual")).withColumn("done", F.col("done") | F.coalesce("_claimed", F.lit(False))).drop("a", "b", "_claimed"))
            base = cut(base.unionByName(added))
        known = places if known is None else known.unionByName(places)
        some = not here.isEmpty()
        if found.where("row IS NULL").isEmpty() and not (rebuild and some):
            break
        halo, rounds = halo if some else 2 * halo, rounds + 1
    if rebuild:
        return numbered(known, "hotspot", F.col("round"), *order)
    return scored(numbered(known.where("radius IS NOT NULL"), "hotspot", *order), base, ground, now, fine, profiles, how)


def as_stamps(found: DataFrame, stamps: DataFrame) -> DataFrame:
    """Stamps of hotspots, behind the last of stamps."""
    last = stamps.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("last"))  # one row
    return found.crossJoin(F.broadcast(last)).select((F.col("last") + F.col("hotspot")).alias("seq"), "x", "z", F.col("placed").alias("scale_x"), F.col("placed").alias("scale_z"), "value", F.col("brush").cast("int").alias("brush"), F.lit(0.0).alias("rotation"), "tool")


def refined(stamps: DataFrame, raster: DataFrame, fine: Grid, coarse: Grid, profiles: DataFrame, how: Refinement, passes: int = 1, decay: float = 1.0, most: int | None = None, **more) -> DataFrame:
    """stamps and, behind them, those of one or more passes, each of which looks at the terrain that the ones before have left, for radii smaller by decay.
    With `most` a pass adds only its first hotspots."""
    out = stamps.select("seq", "x", "z", "scale_x", "scale_z", "value", "brush", "rotation", "tool")
    for k in range(passes):
        found = hotspots(out, raster, fine, coarse, profiles, Refinement(**{**how.__dict__, "smallest": how.smallest * decay**k, "largest": how.largest * decay**k}), **more)
        if most is not None:
            found = found.where(F.col("hotspot") <= most)
        out = cut(out.unionByName(as_stamps(found, out)))
    return out
