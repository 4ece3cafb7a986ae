"""Neighbourhood operators on rasters: as window frames where a frame says it, else a kernel per raster (key) with applyInPandas.

A raster of a key is one group; its size is a parameter of the grid, not of the data, so groups are bounded and
many rasters run side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels as K
from .grid import Grid
from .spatial import dealt


def relaxed_once(raster: DataFrame) -> DataFrame:
    """(row, col, h, known): unknown cells become the mean of their four neighbours, edges repeated. The raster is dense."""
    across, up = W.partitionBy("row").orderBy("col"), W.partitionBy("col").orderBy("row")
    near = [F.coalesce(f("h").over(w), F.col("h")) for f, w in ((F.lag, across), (F.lead, across), (F.lag, up), (F.lead, up))]
    return raster.withColumn("h", F.when(F.col("known"), F.col("h")).otherwise((near[2] + near[3] + near[0] + near[1]) / 4))


def local_variation(raster: DataFrame, grid: Grid, k: int, centred: bool = False) -> DataFrame:
    """(row, col, v): standard deviation in a square of 2 k + 1 cells, edges repeated, missing cells at the global mean; rows then columns.
    If `centred`, heights are taken from that mean, so that squares of large heights don't cancel where the ground is flat."""
    mean = raster.agg(F.avg("h").alias("m"))
    dense = grid.cells(raster.sparkSession).join(raster.select("row", "col", "h"), ["row", "col"], "left").crossJoin(F.broadcast(mean)).select("row", "col", (F.coalesce("h", "m") - (F.col("m") if centred else 0.0)).alias("h"))
    out = dense.select("row", "col", F.col("h").alias("s"), (F.col("h") * F.col("h")).alias("q"))
    for axis, other, n in (("col", "row", grid.cols), ("row", "col", grid.rows)):
        i = F.col(axis)
        places = F.when(i == 0, F.sequence(F.lit(-k), F.lit(0))).when(i == n - 1, F.sequence(F.lit(n - 1), F.lit(n - 1 + k))).otherwise(F.array(i))
        w = W.partitionBy(other).orderBy(axis).rowsBetween(-k, k)
        padded = out.withColumn("place", F.explode(places)).drop(axis).withColumnRenamed("place", axis)
        out = padded.select("row", "col", F.avg("s").over(w).alias("s"), F.avg("q").over(w).alias("q")).where(F.col(axis).between(0, n - 1))
    return out.select("row", "col", F.sqrt(F.greatest(F.col("q") - F.col("s") * F.col("s"), F.lit(0.0))).alias("v"))


def box_threshold(raster: DataFrame, grid: Grid, k: int) -> DataFrame:
    """(row, col, h, above): whether a cell is over the mean of the cells with data in the square of 2 k + 1 about it; rows first, then
    columns, over the dense grid, since a cell without data still passes on its row's sums."""
    w1, w2 = W.partitionBy("row").orderBy("col").rowsBetween(-k, k), W.partitionBy("col").orderBy("row").rowsBetween(-k, k)
    dense = grid.cells(raster.sparkSession).join(raster.select("row", "col", "h"), ["row", "col"], "left")
    rows = dense.select("row", "col", "h", F.sum("h").over(w1).alias("s"), F.count("h").over(w1).alias("n"))
    return rows.select("row", "col", "h", (F.col("h") - F.sum("s").over(w2) / F.sum("n").over(w2) > 1e-9).alias("above")).where("h IS NOT NULL")


def closed_once(mask: DataFrame) -> DataFrame:
    """(row, col, on) of a dense mask: grown, then shrunk by one cell; outside doesn't count."""
    across, up = W.partitionBy("row").orderBy("col").rowsBetween(-1, 1), W.partitionBy("col").orderBy("row").rowsBetween(-1, 1)
    grown = mask.select("row", "col", F.max("on").over(across).alias("on")).select("row", "col", F.max("on").over(up).alias("on"))
    return grown.select("row", "col", F.min("on").over(across).alias("on")).select("row", "col", F.min("on").over(up).alias("on"))


def per_raster(raster: DataFrame, key: str, grid: Grid, kernel: Callable[[np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """kernel on the dense array of each key; its rows, with the key."""
    kind = raster.schema[key].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        h = np.full((grid.rows, grid.cols), np.nan)
        h[frame["row"], frame["col"]] = frame["h"].to_numpy(float, na_value=np.nan)
        out = kernel(h)
        out.insert(0, key, frame[key].iloc[0])
        return out

    return raster.select(key, "row", "col", "h").groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def cells_of(value: np.ndarray, name: str, where: np.ndarray | None = None) -> pd.DataFrame:
    rows, cols = np.nonzero(np.ones(value.shape, bool) if where is None else where)
    return pd.DataFrame({"row": rows.astype(np.int32), "col": cols.astype(np.int32), name: value[rows, cols]})


def contour_stamps(banded: DataFrame, grid: Grid, largest: float = 50.0, smallest: float = 10.0, ratio: float = 0.85, plateau: float = 0.5, candidates: int = 2000, seed: int = 1, denoise: int = 1, edge: float = 0.0, crumb_radius: float = 16.0, crumb_share: float = 0.25) -> DataFrame:
    """(band, pass, idx, x, z, radius, value): for each band (band, row, col, h) discs whose plateaus don't overlap, then smaller stamps on what
    is left. A stamp's value is that of the nearest cell with data to its centre. Bands are groups of their own, seeded by seed + band, so the result doesn't depend on how they are run."""
    radii = G.tier_radii(largest, smallest, ratio)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        band = int(frame["band"].iloc[0])
        h = np.full((grid.rows, grid.cols), np.nan)
        h[frame["row"], frame["col"]] = frame["h"]
        mask = K.denoised(~np.isnan(h), denoise)
        discs, left = K.poisson_pack(mask, grid.cell_x, radii, plateau, edge, candidates, seed + band)
        crumbs = K.crumb_fill(left, grid.cell_x, crumb_radius, crumb_share)
        rows = [(band, 1, i, r, c, q) for i, (r, c, q) in enumerate(discs)] + [(band, 2, i, r, c, crumb_radius) for i, (r, c) in enumerate(crumbs)]
        return pd.DataFrame([(b, p, i, grid.min_x + (c + 0.5) * grid.cell_x, grid.min_z + (r + 0.5) * grid.cell_z, float(q), K.nearest_value(h, r, c)) for b, p, i, r, c, q in rows], columns=["band", "pass", "idx", "x", "z", "radius", "value"])

    return banded.groupBy("band").applyInPandas(run, "band int, pass int, idx int, x double, z double, radius double, value double")


def candidate_trials(banded: DataFrame, grid: Grid, bands: int = 3, seeds: int = 2, initial: int = 250, most: int = 16000, gain: float = 0.1, largest: float = 50.0, smallest: float = 10.0, ratio: float = 0.85, plateau: float = 0.5, seed: int = 1, denoise: int = 1, edge: float = 0.0) -> DataFrame:
    """(band, seed, candidates): how many candidates contour_stamps needs in each of some bands, evenly spread over them, for several seeds.
    Each trial starts from initial on its own, so all run side by side; a limit of numbers, not of time, keeps results the same. Bands without cells have no trial."""
    radii = G.tier_radii(largest, smallest, ratio)
    top = banded.agg(F.max("band")).first()[0]  # one number
    n = 0 if top is None else top + 1
    chosen = sorted({round(float(p)) for p in np.linspace(0, n - 1, min(bands, n))})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        band, k = int(frame["band"].iloc[0]), int(frame["seed"].iloc[0])
        mask = np.zeros((grid.rows, grid.cols), bool)
        mask[frame["row"], frame["col"]] = True
        mask = K.denoised(mask, denoise)
        found = [(band, k, K.enough_candidates(mask, grid.cell_x, radii, plateau, edge, initial, most, gain, k))] if mask.any() else []
        return pd.DataFrame(found, columns=["band", "seed", "candidates"])

    tried = banded.where(F.col("h").isNotNull() & F.col("band").isin(chosen)).select("band", "row", "col", F.explode(F.sequence(F.lit(seed), F.lit(seed + seeds - 1))).alias("seed"))
    return tried.groupBy("band", "seed").applyInPandas(run, "band int, seed int, candidates int")


def tuned_candidates(trials: DataFrame, initial: int = 250) -> DataFrame:
    """(candidates): one number that suits all trials, the largest; initial without any."""
    return trials.agg(F.coalesce(F.max("candidates"), F.lit(initial)).alias("candidates"))


def rectangles(raster: DataFrame, grid: Grid, key: str = "raster", least: int = 2, most: int = 10_000) -> DataFrame:
    """(key, idx, row, col, rows, cols): largest all-data rectangles, one after the other, until none has least cells a side."""

    def run(h: np.ndarray) -> pd.DataFrame:
        mask, out = ~np.isnan(h), []
        while len(out) < most:
            r, c, n, m = K.largest_rectangle(mask, least)
            if not n:
                break
            mask[r : r + n, c : c + m] = False
            out.append((len(out), r, c, n, m))
        return pd.DataFrame(out, columns=["idx", "row", "col", "rows", "cols"])

    return per_raster(raster, key, grid, run, "idx int, row int, col int, rows int, cols int")


def packed_circles(polygons: DataFrame, radius: float, ratio: float = 1.0, seed: int = 1, key: str = "poly") -> DataFrame:
    """(key, idx, x, z, radius) of circles thrown into each polygon; seeded by seed and key."""
    kind = polygons.schema[key].dataType.simpleString()

    def run(frames):
        for frame in frames:
            rows = [(k, i, *c) for k, ring in zip(frame[key], frame["ring"]) for i, c in enumerate(K.pack_circles(np.array([(p["x"], p["z"]) for p in ring]), radius, ratio, seed + int(k)))]
            yield pd.DataFrame(rows, columns=[key, "idx", "x", "z", "radius"])

    return dealt(polygons.select(key, "ring"), key).mapInPandas(run, f"{key} {kind}, idx int, x double, z double, radius double")


def scattered(raster: DataFrame, grid: Grid, radius: float, key: str = "raster", seed: int = 1, radii: DataFrame | None = None, **more: float) -> DataFrame:
    """(key, idx, x, z, radius, value, rank) of stamps thrown over each raster; the same for the same seed. radii (key, row, col, radius) says
    how large they are where; sites without any get no stamps."""
    kind, has_radii = raster.schema[key].dataType.simpleString(), radii is not None
    sized = raster.select(key, "row", "col", "h")
    if radii is not None:
        sized = sized.join(radii.select(key, "row", "col", "radius"), [key, "row", "col"], "left")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        h, wanted = np.full((2, grid.rows, grid.cols), np.nan)
        h[frame["row"], frame["col"]] = frame["h"].to_numpy(float, na_value=np.nan)
        if has_radii:
            wanted[frame["row"], frame["col"]] = frame["radius"].to_numpy(float, na_value=np.nan)
        thrown = K.scatter(h, grid.cell_x, radius, seed=seed, radii=wanted if has_radii else None, **more)
        rows = [(frame[key].iloc[0], i, grid.min_x + x, grid.min_z + z, r, v, k) for i, (x, z, r, v, k) in enumerate(thrown)]
        return pd.DataFrame(rows, columns=[key, "idx", "x", "z", "radius", "value", "rank"])

    return sized.groupBy(key).applyInPandas(run, f"{key} {kind}, idx int, x double, z double, radius double, value double, rank int")
