"""Ordered terrain stamps: lattices, weights, and the ordered composition of their effects.

A flatten stamp of weight w takes a height h to h + (v - h) w, a raise stamp to h + v w; both are affine maps
h -> a h + b, so blocks of consecutive stamps compose and the order, seq, is all that matters.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .grid import Grid
from .spatial import over_bins, with_point_bin

FLATTEN, RAISE = 0, 1


def hex_lattice(spark: SparkSession, grid: Grid, pitch: float = 50.0, bleed: float | None = None, radius: float = 100.0, brush: int = 8) -> DataFrame:
    """(seq, x, z, radius, brush): columns 2 pitch apart, rows sqrt(3) pitch, rows centred in the height, odd rows shifted by pitch
    and reaching up to bleed over both edges."""
    bleed = pitch if bleed is None else bleed
    width, height = grid.max_x - grid.min_x, grid.max_z - grid.min_z
    if width <= 0 or height <= 0:
        raise ValueError("the bounds have no area")
    across, up, eps = 2.0 * pitch, math.sqrt(3.0) * pitch, 1e-9
    rows = int(math.floor(height / up)) + 1
    start = grid.min_z + (height - (rows - 1) * up) / 2.0
    row = F.col("row")
    first = grid.min_x + F.when(row % 2 == 1, pitch).otherwise(0.0)
    back = F.floor((first - (grid.min_x - bleed) + eps) / across)
    ahead = F.floor((grid.max_x + bleed + eps - first) / across)
    sites = spark.range(rows).select(F.col("id").cast("int").alias("row")).select("row", first.alias("first"), F.explode(F.sequence(-back, ahead)).alias("k"))
    sites = sites.select("row", "k", (F.col("first") + F.col("k") * across).alias("x"), (start + row * up).alias("z"))
    return sites.select((row.cast("long") * 1_000_000 + F.col("k") + 1000).alias("seq"), "x", "z", F.lit(radius).alias("radius"), F.lit(brush).alias("brush"))


def raster_lattice(spark: SparkSession, raster: DataFrame, grid: Grid, size: float, spread: float = 1.0, bias: tuple[float, float] = (0.0, 0.0), plateau: float = 500 / 512) -> DataFrame:
    """(row, col, x, z, radius, value): squares of this size from the lower edges on; value is that of the cell at the unbiased
    centre, and sites without data are left out. The walk is longer by whole squares on the side a bias leaves."""
    radius = size / (2 * plateau) * spread

    def axis(low: float, high: float, shift: float) -> tuple[float, int]:
        low -= math.ceil(max(shift, 0.0) / size) * size
        high += math.ceil(max(-shift, 0.0) / size) * size
        return low, int(math.floor((high - low + radius * plateau - 1e-9) / size)) + 1

    bx, bz = size * bias[0], size * bias[1]
    (x0, nx), (z0, nz) = axis(grid.min_x, grid.max_x, bx), axis(grid.min_z, grid.max_z, bz)
    from .grid import sample_nearest

    i = F.col("id")
    sites = spark.range(nx * nz).select(F.floor(i / nx).cast("int").alias("i_row"), (i % nx).cast("int").alias("i_col"))
    sites = sites.select("i_row", "i_col", (x0 + F.col("i_col") * size).alias("x"), (z0 + F.col("i_row") * size).alias("z"))
    found = sample_nearest(sites, raster, grid).where("h IS NOT NULL")
    return found.select(F.col("i_row").alias("row"), F.col("i_col").alias("col"), (F.col("x") + bx).alias("x"), (F.col("z") + bz).alias("z"), F.lit(radius).alias("radius"), F.col("h").alias("value"))


def kernel(w: Column, r: Column) -> Column:
    """Weight at r in [0, 1], linear between 256 samples from the centre to the edge."""
    at = F.least(F.greatest(r, F.lit(0.0)), F.lit(1.0)) * 255
    i = F.least(F.lit(254), F.floor(at)).cast("int")
    return F.get(w, i) + (F.get(w, i + 1) - F.get(w, i)) * (at - i)


def plateau_share(w: Column, least: float = 0.95) -> Column:
    """Where the weight first falls under least, as a share of the radius: 0 if it never reaches it, 1 if it never falls."""
    below = F.array_position(F.transform(w, lambda v: v < least), True)
    return F.when(F.array_max(w) < least, 0.0).when(below == 0, 1.0).otherwise((below - 1) / 255.0)


def adjusted(stamps: DataFrame, turn: dict[int, float], stretch: dict[int, tuple[float, float]]) -> DataFrame:
    """Stamps with a brush's own rotation added and its scales multiplied; scales swap on odd quarter-turns."""

    def by_brush(values: dict[int, float], default: float) -> Column:
        out = F.lit(default)
        for b, v in values.items():
            out = F.when(F.col("brush") == b, float(v)).otherwise(out)
        return out

    offset = by_brush(turn, 0.0)
    swap = F.pmod(F.round(offset / 90).cast("int"), F.lit(2)) == 1
    sx, sz = F.when(swap, F.col("scale_z")).otherwise(F.col("scale_x")), F.when(swap, F.col("scale_x")).otherwise(F.col("scale_z"))
    mx, mz = by_brush({b: m[0] for b, m in stretch.items()}, 1.0), by_brush({b: m[1] for b, m in stretch.items()}, 1.0)
    return stamps.withColumns({"rotation": F.col("rotation") + offset, "scale_x": sx * mx, "scale_z": sz * mz})


def relative_radius(dx: Column, dz: Column) -> Column:
    """0 at a stamp's centre, 1 at its edge: Euclidean for circles, the larger rotated axis for squares."""
    angle = F.radians("rotation")
    across, along = dx * F.cos(angle) - dz * F.sin(angle), dx * F.sin(angle) + dz * F.cos(angle)
    square = F.greatest(F.abs(across) / F.col("scale_x"), F.abs(along) / F.col("scale_z"))
    return F.when(F.col("shape") == "square", square).otherwise(F.sqrt(dx * dx + dz * dz) / F.col("scale_x"))


def effects(sites: DataFrame, stamps: DataFrame, profiles: DataFrame, keys: list[str], bin_size: float = 128.0) -> DataFrame:
    """(keys, seq, tool, value, w) for each site and stamp that reaches it (r <= 1). Stamps are exploded over the bins of their
    reach, so this is an equi-join with an exact condition behind it; profiles are a small fixed table."""
    reach = F.when((F.col("shape") == "square"), F.sqrt(F.col("scale_x") * F.col("scale_x") + F.col("scale_z") * F.col("scale_z"))).otherwise(F.col("scale_x"))
    known = stamps.withColumnsRenamed({"x": "sx", "z": "sz"}).join(F.broadcast(profiles.select("brush", "shape")), "brush").withColumn("reach", reach)
    wide = over_bins(known, F.col("sx") - F.col("reach"), F.col("sz") - F.col("reach"), F.col("sx") + F.col("reach"), F.col("sz") + F.col("reach"), bin_size)
    met = with_point_bin(sites.select(*keys, "x", "z"), bin_size).join(wide, ["bin_x", "bin_z"])
    met = met.withColumn("r", relative_radius(F.col("x") - F.col("sx"), F.col("z") - F.col("sz"))).where("r <= 1")
    met = met.join(F.broadcast(profiles.select("brush", "w")), "brush")  # behind the shuffle
    return met.select(*keys, "seq", "tool", "value", kernel(F.col("w"), F.col("r")).alias("w"))


def fold(hits: DataFrame, keys: list[str], start: float = 0.0) -> DataFrame:
    """(keys, h): the stamps' effects applied in order of seq."""

    def step(h: Column, s: Column) -> Column:
        return F.when(s["tool"] == RAISE, h + s["value"] * s["w"]).otherwise(h + (s["value"] - h) * s["w"])

    ordered = F.array_sort(F.collect_list(F.struct("seq", "tool", "value", "w")))
    return hits.groupBy(*keys).agg(F.aggregate(ordered, F.lit(start), step).alias("h"))


def affine_blocks(hits: DataFrame, keys: list[str], block: int) -> DataFrame:
    """(keys, blk, a, b): the composed map h -> a h + b of each block of consecutive stamps."""

    def step(acc: Column, s: Column) -> Column:
        keep = F.when(s["tool"] == RAISE, 1.0).otherwise(1 - s["w"])
        return F.struct((acc["a"] * keep).alias("a"), (acc["b"] * keep + s["value"] * s["w"]).alias("b"))

    ordered = F.array_sort(F.collect_list(F.struct("seq", "tool", "value", "w")))
    one = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"))
    return hits.groupBy(*keys, F.floor(F.col("seq") / block).cast("int").alias("blk")).agg(F.aggregate(ordered, one, step).alias("m")).select(*keys, "blk", "m.a", "m.b")


def compose_blocks(blocks: DataFrame, keys: list[str], start: float = 0.0) -> DataFrame:
    """(keys, h): the blocks' maps applied in order; what a height needs per key is one pair per block."""
    ordered = F.array_sort(F.collect_list(F.struct("blk", "a", "b")))
    return blocks.groupBy(*keys).agg(F.aggregate(ordered, F.lit(start), lambda h, m: m["a"] * h + m["b"]).alias("h"))


def weights(w: np.ndarray, r: np.ndarray) -> np.ndarray:
    """kernel for arrays."""
    at = np.clip(r, 0.0, 1.0) * 255
    i = np.minimum(254, np.floor(at)).astype(int)
    return w[i] + (w[i + 1] - w[i]) * (at - i)


def tasks(grid: Grid, rows: DataFrame, tile: int) -> int:
    """So many tasks share the tiles: each row is much work, so they aren't merged by bytes."""
    spark = rows.sparkSession
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return min(most, math.ceil(grid.rows / tile) * math.ceil(grid.cols / tile))


MAPS = "tile_row int, tile_col int, blk int, hit binary, a binary, b binary"


def tile_cells(grid: Grid, tile_row: int, tile_col: int, tile: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows and the columns of a tile."""
    return np.arange(tile_row * tile, min((tile_row + 1) * tile, grid.rows)), np.arange(tile_col * tile, min((tile_col + 1) * tile, grid.cols))


def tile_maps(grid: Grid, stamps: DataFrame, profiles: DataFrame, tile: int, block: int) -> DataFrame:
    """Rows MAPS: the maps h -> a h + b that the stamps of each block of seq make of the heights at the centres of a tile's cells, and which cells they reach.

    Stamps, not their cells, are shuffled: each goes to the tiles its reach touches, so a course-wide one is a row per tile. A task applies the stamps of a
    tile and block in order to arrays of the tile; however many meet on a tile, a block bounds what a task holds. Profiles, a small fixed table, are
    joined behind the shuffle."""
    shape = profiles.select("brush", "shape")
    reach = F.when(F.col("shape") == "square", F.sqrt(F.col("scale_x") * F.col("scale_x") + F.col("scale_z") * F.col("scale_z"))).otherwise(F.col("scale_x"))
    known = stamps.select("seq", "x", "z", "scale_x", "scale_z", "value", "brush", "rotation", "tool").join(F.broadcast(shape), "brush").withColumn("reach", reach)

    def tiles(at: str, low: float, cell: float, n: int) -> Column:
        first, last = F.floor((F.col(at) - F.col("reach") - low) / cell), F.floor((F.col(at) + F.col("reach") - low) / cell)
        inside = F.sequence(F.floor(F.greatest(first, F.lit(0)) / tile).cast("int"), F.floor(F.least(last, F.lit(n - 1)) / tile).cast("int"))
        return F.explode(F.when((last >= 0) & (first < n), inside))

    spread = known.withColumn("tile_row", tiles("z", grid.min_z, grid.cell_z, grid.rows)).withColumn("tile_col", tiles("x", grid.min_x, grid.cell_x, grid.cols))
    keys = ["tile_row", "tile_col", "blk"]
    dealt = spread.withColumn("blk", F.floor(F.col("seq") / block).cast("int")).repartition(tasks(grid, stamps, tile), *keys).join(F.broadcast(profiles.select("brush", "w")), "brush")

    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        number = {n: table[n].to_numpy() for n in ("x", "z", "scale_x", "scale_z", "value", "brush", "rotation", "tool", "reach")}
        brush, first = np.unique(number["brush"], return_index=True)
        profile = {b: np.asarray(table["w"][int(i)].as_py()) for b, i in zip(brush.tolist(), first)}
        square = {b: table["shape"][int(i)].as_py() == "square" for b, i in zip(brush.tolist(), first)}
        at = [table[k][0].as_py() for k in keys]
        rows, cols = tile_cells(grid, at[0], at[1], tile)
        zs, xs = grid.min_z + (rows + 0.5) * grid.cell_z, grid.min_x + (cols + 0.5) * grid.cell_x
        a, b, hit = np.ones((len(rows), len(cols))), np.zeros((len(rows), len(cols))), np.zeros((len(rows), len(cols)), bool)
        for x, z, sx, sz, value, kind, rotation, tool, far in zip(*(v.tolist() for v in number.values())):
            box = slice(*np.searchsorted(zs, (z - far, z + far + 1e-6))), slice(*np.searchsorted(xs, (x - far, x + far + 1e-6)))
            dx, dz = (xs[box[1]] - x)[None, :], (zs[box[0]] - z)[:, None]
            if square[kind]:
                turn = math.radians(rotation)
                r = np.maximum(np.abs(dx * math.cos(turn) - dz * math.sin(turn)) / sx, np.abs(dx * math.sin(turn) + dz * math.cos(turn)) / sz)
            else:
                r = np.sqrt(dx * dx + dz * dz) / sx
            on = r <= 1
            w = np.where(on, weights(profile[kind], r), 0.0)
            hit[box] |= on
            if tool != RAISE:
                a[box] *= 1 - w
                b[box] *= 1 - w
            b[box] += value * w
        numbers = {k: pa.array([v], pa.int32()) for k, v in zip(keys, at)}
        return pa.table(numbers | {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("hit", hit), ("a", a), ("b", b))})

    return dealt.groupBy(*keys).applyInArrow(apply, MAPS)


def composed(grid: Grid, maps: DataFrame, tile: int, start: float = 0.0) -> DataFrame:
    """(row, col, h) of the cells that rows MAPS reach: a tile's blocks applied in order, a row of arrays each."""

    def compose(table: pa.Table) -> pa.Table:
        table = table.sort_by("blk")
        rows, cols = tile_cells(grid, table["tile_row"][0].as_py(), table["tile_col"][0].as_py(), tile)
        h, hit = np.full((len(rows), len(cols)), start), np.zeros((len(rows), len(cols)), bool)
        for on, a, b in zip(*(table[n].to_pylist() for n in ("hit", "a", "b"))):
            h = np.frombuffer(a).reshape(h.shape) * h + np.frombuffer(b).reshape(h.shape)
            hit |= np.frombuffer(on, bool).reshape(h.shape)
        i, j = np.nonzero(hit)
        return pa.table({"row": rows[i].astype(np.int32), "col": cols[j].astype(np.int32), "h": h[i, j]})

    return maps.repartition(tasks(grid, maps, tile), "tile_row", "tile_col").groupBy("tile_row", "tile_col").applyInArrow(compose, "row int, col int, h double")


def render(grid: Grid, stamps: DataFrame, profiles: DataFrame, start: float = 0.0, tile: int = 32, block: int = 16_384) -> DataFrame:
    """(row, col, h) of every cell a stamp reaches, at cell centres; others keep start and are left out. Blocks of a tile meet as a row of arrays each."""
    return composed(grid, tile_maps(grid, stamps, profiles, tile, block), tile, start)


def influence(grid: Grid, stamps: DataFrame, profiles: DataFrame) -> DataFrame:
    """(row, col, w): the largest weight any of the stamps has in a cell."""
    cells = grid.cells(stamps.sparkSession).withColumns({"x": grid.centre_x(F.col("col")), "z": grid.centre_z(F.col("row"))})
    return effects(cells, stamps, profiles, ["row", "col"]).groupBy("row", "col").agg(F.max("w").alias("w"))


def shifted_to_zero(rendered: DataFrame, stamps: DataFrame, span: float = 275.0) -> DataFrame:
    """Stamps with every value less the lowest rendered height; an error where heights span more than span."""
    low = rendered.agg(F.min("h").alias("low"), F.max("h").alias("high"))
    ok = F.assert_true(F.col("high") - F.col("low") <= span, F.lit(f"heights span more than {span} m"))
    return stamps.crossJoin(F.broadcast(low)).withColumn("ok", ok).where("ok IS NULL").withColumn("value", F.col("value") - F.col("low")).drop("low", "high", "ok")  # one row


def course_wide(seq: int, value: float, grid: Grid, tool: int = RAISE, margin: float = 100.0, brush: int = 72) -> dict:
    """A stamp over the whole course."""
    half_x, half_z = (grid.max_x - grid.min_x) / 2, (grid.max_z - grid.min_z) / 2
    return {"seq": seq, "x": grid.min_x + half_x, "z": grid.min_z + half_z, "scale_x": half_x + margin, "scale_z": half_z + margin, "value": value, "brush": brush, "rotation": 0.0, "tool": tool}


def exported(stamps: DataFrame, offset: float = 1000.0) -> DataFrame:
    """(seq, entry): the nested entry of a height stamp, centred on the origin, to 3 decimals."""
    r3 = lambda c: F.round(c, 3)
    entry = F.struct(
        F.col("tool").alias("tool"),
        F.struct(r3(F.col("x") - offset).alias("x"), F.lit("-Infinity").alias("y"), r3(F.col("z") - offset).alias("z")).alias("position"),
        F.struct(F.lit(0.0).alias("x"), r3(F.col("rotation")).alias("y"), F.lit(0.0).alias("z")).alias("rotation"),
        F.struct(r3(F.col("scale_x")).alias("x"), F.lit(1.0).alias("y"), r3(F.col("scale_z")).alias("z")).alias("scale"),
        F.col("brush").alias("type"), r3(F.col("value")).alias("value"), F.lit(-1).alias("holeId"), F.lit(0.0).alias("radius"),
    )
    return stamps.select("seq", entry.alias("entry"))


def migrated(entries: DataFrame) -> DataFrame:
    """Entries of older files, which have one radius, with scale_x and scale_z."""
    old = F.col("radius") if "radius" in entries.columns else F.lit(None).cast("double")
    out = entries
    for c in ("scale_x", "scale_z"):
        out = out.withColumn(c, F.coalesce(F.col(c), old) if c in entries.columns else old)
    for c, v in (("rotation", 0.0), ("tool", FLATTEN)):
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in entries.columns else F.lit(v))
    return out.drop("radius")


def plane_fit_rms(samples: DataFrame, key: str) -> DataFrame:
    """(key, n, rms) of the least-squares plane through (x, z, h) per key; 0 with fewer than three points or on a line.

    Sums are taken about the group's means, so the normal equations are a 2 x 2 system of covariances."""
    s = samples.groupBy(key).agg(
        F.count("*").alias("n"), F.covar_pop("x", "x").alias("xx"), F.covar_pop("z", "z").alias("zz"), F.covar_pop("x", "z").alias("xz"),
        F.covar_pop("x", "h").alias("xh"), F.covar_pop("z", "h").alias("zh"), F.covar_pop("h", "h").alias("hh"),
    )
    det = F.col("xx") * F.col("zz") - F.col("xz") * F.col("xz")
    p = (F.col("xh") * F.col("zz") - F.col("zh") * F.col("xz")) / F.nullif(det, F.lit(0.0))
    q = (F.col("zh") * F.col("xx") - F.col("xh") * F.col("xz")) / F.nullif(det, F.lit(0.0))
    rest = F.col("hh") - p * F.col("xh") - q * F.col("zh")
    return s.select(key, "n", F.when((F.col("n") < 3) | (det <= 0), 0.0).otherwise(F.sqrt(F.greatest(rest, F.lit(0.0)))).alias("rms"))


def candidate_scores(samples: DataFrame, hotspots: DataFrame, profiles: DataFrame, brushes: tuple[int, ...] = (8, 9, 10, 54)) -> DataFrame:
    """(hotspot, brush, tool, value, rms) of the best of all brushes and both tools for each hotspot.

    samples: (hotspot, x, z, actual, current); hotspots: (hotspot, x, z, radius, current). The value follows from the mean of actual; ties
    go to the first brush, then to flatten. brushes are a fixed handful, so candidates multiply rows by eight."""
    order = F.array(*map(F.lit, brushes))
    target = samples.groupBy("hotspot").agg(F.avg("actual").alias("target"))
    at = hotspots.select("hotspot", F.col("x").alias("hx"), F.col("z").alias("hz"), "radius", F.col("current").alias("centre")).join(target, "hotspot")
    tried = at.withColumn("brush", F.explode(order)).join(F.broadcast(profiles.select("brush", "w")), "brush").withColumn("tool", F.explode(F.array(F.lit(FLATTEN), F.lit(RAISE))))
    w0 = kernel(F.col("w"), F.lit(0.0))
    lift = (F.col("target") - F.col("centre")) / w0
    tried = tried.where(w0 > 0).withColumn("value", F.when(F.col("tool") == RAISE, lift).otherwise(F.col("centre") + lift))
    r = F.least(F.sqrt(F.pow(F.col("x") - F.col("hx"), F.lit(2)) + F.pow(F.col("z") - F.col("hz"), F.lit(2))) / F.col("radius"), F.lit(1.0))
    w = kernel(F.col("w"), r)
    after = F.when(F.col("tool") == RAISE, F.col("current") + F.col("value") * w).otherwise(F.col("current") + (F.col("value") - F.col("current")) * w)
    scored = samples.join(tried, "hotspot").groupBy("hotspot", "brush", "tool", "value").agg(F.sqrt(F.avg(F.pow(after - F.col("actual"), F.lit(2)))).alias("rms"))
    ranked = scored.groupBy("hotspot").agg(F.min(F.struct(F.round("rms", 9).alias("key"), F.array_position(order, F.col("brush")).alias("place"), "tool", "brush", "value", "rms")).alias("b"))
    return ranked.select("hotspot", "b.brush", "b.tool", "b.value", "b.rms")
