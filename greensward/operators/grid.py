"""Rasters as long tables keyed by (row, col): binning, resampling, sampling, statistics, bands.

A cell without data is absent or null, never NaN. The bounds are closed; the last cell holds the upper edge.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """A grid of rows x cols cells over [min_x, max_x] x [min_z, max_z]; row counts z, col counts x."""

    rows: int = 100
    cols: int = 100
    min_x: float = 0.0
    min_z: float = 0.0
    max_x: float = 2000.0
    max_z: float = 2000.0

    @property
    def cell_x(self) -> float:
        return (self.max_x - self.min_x) / self.cols

    @property
    def cell_z(self) -> float:
        return (self.max_z - self.min_z) / self.rows

    def inside(self, x: Column, z: Column) -> Column:
        return x.between(self.min_x, self.max_x) & z.between(self.min_z, self.max_z)

    def col_of(self, x: Column) -> Column:
        return F.least(F.floor((x - self.min_x) / self.cell_x), F.lit(self.cols - 1)).cast("int")

    def row_of(self, z: Column) -> Column:
        return F.least(F.floor((z - self.min_z) / self.cell_z), F.lit(self.rows - 1)).cast("int")

    def clamped(self, v: Column, low: float, cell: float, n: int) -> Column:
        return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((v - low) / cell))).cast("int")

    def centre_x(self, col: Column) -> Column:
        return self.min_x + (col + 0.5) * self.cell_x

    def centre_z(self, row: Column) -> Column:
        return self.min_z + (row + 0.5) * self.cell_z

    def cells(self, spark: SparkSession) -> DataFrame:
        """All (row, col)."""
        n = F.lit(self.cols)
        return spark.range(self.rows * self.cols).select(F.floor(F.col("id") / n).cast("int").alias("row"), (F.col("id") % n).cast("int").alias("col"))


def ground(points: DataFrame, grid: Grid, classes: tuple[int, ...] = (2, 8)) -> DataFrame:
    """(row, col, h): mean elevation of points of these classes; points outside are dropped."""
    kept = points.where(F.col("classification").isin(*classes) & grid.inside(F.col("x"), F.col("z")))
    return kept.groupBy(grid.row_of(F.col("z")).alias("row"), grid.col_of(F.col("x")).alias("col")).agg(F.avg("elevation").alias("h"))


def canopy(points: DataFrame, grid: Grid, classes: tuple[int, ...] = (3, 4, 5)) -> DataFrame:
    """(row, col, h): highest point of these classes; points outside count for the nearest edge cell."""
    kept = points.where(F.col("classification").isin(*classes))
    row, col = grid.clamped(F.col("z"), grid.min_z, grid.cell_z, grid.rows), grid.clamped(F.col("x"), grid.min_x, grid.cell_x, grid.cols)
    return kept.groupBy(row.alias("row"), col.alias("col")).agg(F.max("elevation").alias("h"))


def canopy_with_fallback(points: DataFrame, grid: Grid, classes: tuple[int, ...] = (3, 4, 5), fallback: tuple[int, ...] = (0, 1)) -> DataFrame:
    """canopy of classes or, if no point has one of them, of fallback; both are aggregated in one pass."""
    both = points.where(F.col("classification").isin(*classes, *fallback)).withColumn("first", F.col("classification").isin(*classes))
    row, col = grid.clamped(F.col("z"), grid.min_z, grid.cell_z, grid.rows), grid.clamped(F.col("x"), grid.min_x, grid.cell_x, grid.cols)
    cells = both.groupBy("first", row.alias("row"), col.alias("col")).agg(F.max("elevation").alias("h"))
    used = cells.agg(F.coalesce(F.max("first"), F.lit(True)).alias("used"))
    return cells.join(F.broadcast(used), cells["first"] == used["used"]).select("row", "col", "h")  # one row


def class_counts(points: DataFrame) -> DataFrame:
    return points.groupBy("classification").agg(F.count("*").alias("n"))


def downsample(raster: DataFrame, fine: Grid, coarse: Grid) -> DataFrame:
    """Mean of the fine cells whose centres lie in a coarse cell, without weights; any ratio."""
    x, z = fine.centre_x(F.col("col")), fine.centre_z(F.col("row"))
    return raster.where("h IS NOT NULL").groupBy(coarse.row_of(z).alias("row"), coarse.col_of(x).alias("col")).agg(F.avg("h").alias("h"))


def coverage(raster: DataFrame, grid: Grid) -> DataFrame:
    """One row: cells, filled, share, mean, lowest and highest."""
    n = grid.rows * grid.cols
    filled = F.count("h")
    return raster.agg(F.lit(n).cast("long").alias("cells"), filled.alias("filled"), (filled / n).alias("share"), F.avg("h").alias("mean_h"), F.min("h").alias("min_h"), F.max("h").alias("max_h"))


def error_stats(predicted: DataFrame, actual: DataFrame, mask: DataFrame | None = None, percentile: float = 0.98) -> DataFrame:
    """RMS, bias and a percentile of |error|, over all cells both have and over those of mask (row, col)."""
    e = predicted.select("row", "col", F.col("h").alias("p")).join(actual.select("row", "col", F.col("h").alias("a")), ["row", "col"]).where("p IS NOT NULL AND a IS NOT NULL")
    e = e.withColumn("e", F.col("p") - F.col("a"))
    if mask is not None:
        e = e.join(mask.select("row", "col").distinct().withColumn("m", F.lit(True)), ["row", "col"], "left")
    else:
        e = e.withColumn("m", F.lit(True))
    kept = F.when(F.col("m"), F.col("e"))
    return e.agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("e") * F.col("e"))).alias("rms"), F.avg("e").alias("bias"), F.sqrt(F.avg(kept * kept)).alias("masked_rms"),
        F.avg(kept).alias("masked_bias"), F.percentile(F.abs("e"), percentile).alias("abs_percentile"),
    )


def crop(points: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """Points in the closed bounds (min_x, min_z, max_x, max_z), moved so that its corner is the origin."""
    a, b, c, d = bounds
    return points.where(F.col("x").between(a, c) & F.col("z").between(b, d)).withColumns({"x": F.col("x") - a, "z": F.col("z") - b})


def select_window(bounds: tuple[float, float, float, float], size: float, centre: tuple[float, float] | None = None) -> tuple[float, float, float, float]:
    """A square window of this size in bounds, shifted rather than shrunk; an error if it doesn't fit."""
    a, b, c, d = bounds
    if size > c - a or size > d - b:
        raise ValueError(f"a window of {size} doesn't fit into {bounds}")
    x, z = centre or ((a + c) / 2, (b + d) / 2)
    x0, z0 = min(max(x - size / 2, a), c - size), min(max(z - size / 2, b), d - size)
    return x0, z0, x0 + size, z0 + size


def to_metres(points: DataFrame, horizontal: float, vertical: float, origin: tuple[float, float]) -> DataFrame:
    """Unit and origin projection of native coordinates."""
    return points.withColumns({"x": F.col("x") * horizontal - origin[0], "z": F.col("z") * horizontal - origin[1], "elevation": F.col("elevation") * vertical})


def merged_extent(tiles: DataFrame) -> DataFrame:
    """One row of (crs, min_x, min_y, max_x, max_y, point_count); fails where the tiles' systems differ."""
    one = F.assert_true(F.count_distinct(F.coalesce("crs", F.lit(""))) <= 1, "tiles of different coordinate systems")
    out = tiles.agg(one.alias("ok"), F.max("crs").alias("crs"), F.min("min_x").alias("min_x"), F.min("min_y").alias("min_y"), F.max("max_x").alias("max_x"), F.max("max_y").alias("max_y"), F.sum("point_count").alias("point_count"))
    return out.where("ok IS NULL").drop("ok")


def contour_levels(low: float, high: float, step: float) -> list[float]:
    """low + step, low + 2 step, ... below high."""
    n, out = 1, []
    while low + n * step < high:
        out.append(low + n * step)
        n += 1
    return out


def with_bands(raster: DataFrame, step: float) -> DataFrame:
    """raster with band, 0 for the lowest: half-open ranges of step from the lowest height; open at both ends; null cells are in none."""
    low = raster.agg(F.min("h").alias("low"), F.max("h").alias("high"))
    band = F.floor((F.col("h") - F.col("low")) / step)
    last = F.greatest(F.ceil((F.col("high") - F.col("low")) / step) - 1, F.lit(0))
    return raster.where("h IS NOT NULL").crossJoin(F.broadcast(low)).select("row", "col", "h", F.least(band, last).cast("int").alias("band"))  # one row


def band_summary(banded: DataFrame) -> DataFrame:
    return banded.groupBy("band").agg(F.count("*").alias("cells"), F.min("h").alias("min_h"), F.max("h").alias("max_h"), F.avg("h").alias("mean_h"))


def sample_nearest(sites: DataFrame, raster: DataFrame, grid: Grid) -> DataFrame:
    """sites (x, z, ...) with h of the cell they lie in; truncated, then clamped; null where there is no data."""
    col = F.greatest(F.lit(0), F.least(F.lit(grid.cols - 1), ((F.col("x") - grid.min_x) / grid.cell_x).cast("int")))
    row = F.greatest(F.lit(0), F.least(F.lit(grid.rows - 1), ((F.col("z") - grid.min_z) / grid.cell_z).cast("int")))
    return sites.withColumns({"row": row, "col": col}).join(raster.select("row", "col", "h"), ["row", "col"], "left")


def circle_cells(sites: DataFrame, raster: DataFrame, grid: Grid, radius: Column) -> DataFrame:
    """Pairs of a site and a cell with data whose centre lies within radius: each site is exploded over the cells of
    its box, so the join is an equi-join on cells."""
    x, z = F.col("x"), F.col("z")
    low = lambda v, m, c, n: F.greatest(F.lit(0), F.floor((v - radius - m) / c)).cast("int")
    high = lambda v, m, c, n: F.least(F.lit(n - 1), F.floor((v + radius - m) / c)).cast("int")
    c0, c1 = low(x, grid.min_x, grid.cell_x, grid.cols), high(x, grid.min_x, grid.cell_x, grid.cols)
    r0, r1 = low(z, grid.min_z, grid.cell_z, grid.rows), high(z, grid.min_z, grid.cell_z, grid.rows)
    boxed = sites.withColumns({"_r": radius, "_c0": c0, "_c1": c1, "_r0": r0, "_r1": r1}).where("_c0 <= _c1 AND _r0 <= _r1")
    cells = boxed.withColumn("row", F.explode(F.sequence("_r0", "_r1"))).withColumn("col", F.explode(F.sequence("_c0", "_c1")))
    dx, dz = grid.centre_x(F.col("col")) - x, grid.centre_z(F.col("row")) - z
    near = cells.where(dx * dx + dz * dz <= F.col("_r") * F.col("_r")).drop("_r", "_c0", "_c1", "_r0", "_r1")
    return near.join(raster.where("h IS NOT NULL").select("row", "col", "h"), ["row", "col"])


def sample_mean(sites: DataFrame, raster: DataFrame, grid: Grid, key: str, radius: Column, least: int = 1) -> DataFrame:
    """(key, n, mean_h) of the cells within radius of each site; null where fewer than least have data.

    Sites at one place with one radius are looked up once. Tables of sites are never broadcast, however small their files are."""
    at = sites.select(key, "x", "z", radius.alias("_radius"))
    place = ["x", "z", "_radius"]
    near = circle_cells(at.select(*place).distinct(), raster, grid, F.col("_radius")).groupBy(*place).agg(F.count("*").alias("n"), F.avg("h").alias("m"))
    return at.join(near.hint("merge"), place, "left").select(key, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.when(F.col("n") >= least, F.col("m")).alias("mean_h"))


def lower_water(raster: DataFrame, mask: DataFrame, depth: float) -> DataFrame:
    """Heights lowered by depth on the mask's cells; null stays null."""
    wet = mask.select("row", "col").distinct().withColumn("wet", F.lit(True))
    return raster.join(wet, ["row", "col"], "left").select("row", "col", F.when(F.col("wet"), F.col("h") - depth).otherwise(F.col("h")).alias("h"))


def quantised(h: Column, low: float = 0.0, high: float = 275.0) -> Column:
    """Heights as unsigned 16-bit steps between low and high, half to even."""
    return F.least(F.greatest(F.rint((h - low) / (high - low) * 65535), F.lit(0.0)), F.lit(65535.0)).cast("int")


def density_cdf(raster: DataFrame, radius: Column) -> DataFrame:
    """(row, col, p): share of the weight 1 / radius**2 up to and with each cell, in row-major order.

    Rows are summed first and only their totals are ordered globally, so no task sorts all cells."""
    weighted = raster.where("h IS NOT NULL").withColumn("w", 1 / (radius * radius))
    totals = weighted.groupBy("row").agg(F.sum("w").alias("of_row"))
    before = totals.select("row", (F.sum("of_row").over(W.orderBy("row").rowsBetween(W.unboundedPreceding, -1))).alias("before"), F.sum("of_row").over(W.partitionBy()).alias("total"))
    here = F.sum("w").over(W.partitionBy("row").orderBy("col").rowsBetween(W.unboundedPreceding, 0))
    return weighted.join(before, "row").select("row", "col", ((F.coalesce("before", F.lit(0.0)) + here) / F.col("total")).alias("p"))


def variation_radius(variation: DataFrame, radius: float, min_scale: float, gamma: float = 2.0) -> DataFrame:
    """(row, col, radius) from (row, col, v): the full radius where little varies, min_scale of it where most does; v is
    taken between its 5th and 95th percentiles, and flat fields keep the full radius."""
    span = variation.agg(F.percentile("v", 0.05).alias("p5"), F.percentile("v", 0.95).alias("p95"))
    t = F.least(F.greatest((F.col("v") - F.col("p5")) / F.nullif(F.col("p95") - F.col("p5"), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    shrunk = F.when(F.col("p95") - F.col("p5") < 1e-9, F.lit(radius)).otherwise(radius * (1 - F.pow(t, F.lit(gamma)) * (1 - min_scale)))
    return variation.crossJoin(F.broadcast(span)).select("row", "col", shrunk.alias("radius"))  # span is one row
