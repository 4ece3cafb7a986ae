"""Trees, holes, paths, splines and object groups: the last tables before export."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from .grid import Grid, sample_mean
from .spatial import at_places, in_polygons, kept_lines, nearest_kept, polygons_at
from .staging import cut, numbered, running_sum

HEIGHT, RADIUS, TYPE = "pga_tree_height", "pga_tree_radius", "pga_tree_type"
#: Leaf types that hint at a tree type.
LEAF_HINTS = {"needleleaved": "pine"}
#: Surface, width, handle length, tightness and second surface of each kind of spline.
SPLINES = {
    "bunker": ("bunker", 0.01, 1.0, True, "heavyrough", 2.5),
    "green": ("green", 1.7, 0.2, True, "heavyrough", 2.5),
    "tee": ("green", 1.7, 0.2, True, "heavyrough", 2.5),
    "fairway": ("fairway", 3.0, 3.0, False, "rough", 5.0),
    "rough": ("rough", 1.7, 3.0, False, "", 0.0),
    "heavyrough": ("heavyrough", 1.7, 3.0, False, "", 0.0),
    "building": ("surface2", 0.01, 0.2, True, "", 0.0),
    "wood": ("surface1", 0.01, 0.2, True, "", 0.0),
    "pavement": ("surface3", 0.01, 0.2, True, "", 0.0),
    "mulch": ("surface2", 0.01, 0.2, True, "", 0.0),
}


def tree_heights(trees: DataFrame, default: float = 10.0) -> DataFrame:
    """trees with height: the tag's number, or the default."""
    return trees.withColumn("height", F.coalesce(F.col("tags")[HEIGHT].try_cast("double"), F.lit(default)))


def tree_scales(trees: DataFrame, low: float = 0.5, high: float = 1.2) -> DataFrame:
    """trees with height and scale: from low for the lowest to high for the highest tree; 1 where all are about as high."""
    h = tree_heights(trees)
    span = h.agg(F.min("height").alias("min_h"), F.max("height").alias("max_h"))
    scale = F.when(F.col("max_h") - F.col("min_h") > 0.01, (F.col("height") - F.col("min_h")) * ((high - low) / (F.col("max_h") - F.col("min_h"))) + low).otherwise(1.0)
    return h.crossJoin(F.broadcast(span)).withColumn("scale", scale).drop("min_h", "max_h")  # one row


def tagged_trees(found: DataFrame) -> DataFrame:
    """Detected trees (x, z, radius, height) with their measures as tags."""
    return found.withColumn("tags", F.create_map(F.lit(RADIUS), F.round("radius", 2).cast("string"), F.lit(HEIGHT), F.round("height", 2).cast("string")))


def hinted_trees(trees: DataFrame, woods: DataFrame) -> DataFrame:
    """Trees without a type get that of the first wood polygon (poly, ring, hint) they stand in."""
    untyped = trees.where(F.col("tags")[TYPE].isNull()).select("tree", "x", "z")
    first = in_polygons(untyped, woods.where("hint IS NOT NULL"), "tree").groupBy("tree").agg(F.min("poly").alias("poly"))
    hint = first.join(woods.select("poly", "hint"), "poly").select("tree", "hint")
    return trees.join(hint, "tree", "left").withColumn("tags", F.when(F.col("hint").isNotNull(), F.map_concat("tags", F.create_map(F.lit(TYPE), "hint"))).otherwise(F.col("tags"))).drop("hint")


def relocated(trees: DataFrame, segments: DataFrame, keepout: float = 2.85, margin: float = 0.05, rounds: int = 8) -> DataFrame:
    """(tree, x, z, moved): trees nearer than keepout to a segment (path, x1, z1, x2, z2) are pushed out along the normal of the
    nearest one, to the side they lean to; up to so many rounds, all trees of a round at once. Trees that are still too near keep their last place.

    Where a tree goes depends on its place alone, so places go through the rounds, and trees only meet them at the end. A place that isn't pushed in a
    round has settled."""
    place = ["from_x", "from_z", "x", "z", "moved"]
    dx, dz = F.col("seg.x2") - F.col("seg.x1"), F.col("seg.z2") - F.col("seg.z1")
    length = F.sqrt(dx * dx + dz * dz)
    nx, nz = -dz / length, dx / length
    side = F.when((F.col("x") - F.col("seg.x1")) * nx + (F.col("z") - F.col("seg.z1")) * nz >= 0, 1.0).otherwise(-1.0)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((F.col("x") - F.col("seg.x1")) * dx + (F.col("z") - F.col("seg.z1")) * dz) / (length * length)))
    push = (keepout + margin) * side
    hit = F.col("seg").isNotNull() & (F.col("distance") < keepout) & (length > 0)
    now, settled = trees.select("x", "z").distinct().select(F.col("x").alias("from_x"), F.col("z").alias("from_z"), "x", "z", F.lit(0).alias("moved")), []
    with kept_lines(segments, keepout) as lines:
        for _ in range(rounds):
            after = cut(nearest_kept(now, lines, keepout).select(
                "from_x", "from_z",
                F.when(hit, F.col("seg.x1") + t * dx + nx * push).otherwise(F.col("x")).alias("x"),
                F.when(hit, F.col("seg.z1") + t * dz + nz * push).otherwise(F.col("z")).alias("z"),
                (F.col("moved") + F.when(hit, 1).otherwise(0)).alias("moved"),
                F.coalesce(hit, F.lit(False)).alias("hit"),
            ))
            settled.append(after.where("NOT hit").select(place))
            now = after.where("hit").select(place)
            if now.isEmpty():
                break
    gone = reduce(DataFrame.unionByName, settled, now).where("moved > 0").select(F.col("from_x").alias("x"), F.col("from_z").alias("z"), F.struct("x", "z", "moved").alias("to"))
    to = lambda c: F.coalesce(F.col("to")[c], F.col(c))
    return trees.select("tree", "x", "z", F.lit(0).alias("moved")).join(gone.hint("merge"), ["x", "z"], "left").select("tree", to("x").alias("x"), to("z").alias("z"), to("moved").alias("moved"))


def hole_waypoints(holes: DataFrame) -> DataFrame:
    """holes with exactly three points: a middle one is added to two, and of more the first, second and last stay; fewer than two: no hole."""
    p = F.col("pts")
    a, b = F.get(p, F.lit(0)), F.element_at(p, -1)
    half = F.struct(((a["x"] + b["x"]) / 2).alias("x"), ((a["z"] + b["z"]) / 2).alias("z"))
    three = F.when(F.size(p) == 2, F.array(a, half, b)).otherwise(F.array(a, F.get(p, F.lit(1)), b))
    return holes.where(F.size("pts") >= 2).withColumn("pts", three)


def ordered_holes(holes: DataFrame) -> DataFrame:
    """(hole, seq, par, pts): of equal numbers the last one counts; missing numbers are -1; a number of 0 becomes one more than the different
    numbers known when it is met.

    First places of numbers cut the holes, in order, into stretches in which only zeros are met. Within one each zero gets one more than the last, up to
    the first number that was known already, which all further ones get. So only the stretches (a row for each different number) are gone through in
    order; the zeros are numbered by running sums over ranges."""
    h = hole_waypoints(holes).select("seq", F.coalesce("ref", F.lit(-1)).alias("ref"), "par", "pts")
    firsts = h.where("ref <> 0").groupBy("ref").agg(F.min("seq").alias("seq")).select("seq", "ref")
    met = running_sum(firsts.unionByName(h.where("ref = 0").select("seq", "ref")), "stretch", F.col("ref") != 0, F.col("seq"))
    zeros = numbered(met.where("ref = 0").select("seq", "stretch"), "k", F.col("seq"))
    counts = zeros.groupBy("stretch").agg(F.count("*").alias("zeros"), F.min("k").alias("k"))
    stretches = met.where("ref <> 0").select("stretch", "ref").join(counts, "stretch", "full")

    def number(frame: pd.DataFrame) -> pd.DataFrame:
        known: set[int] = set()
        given: list[tuple[int, int]] = []
        n, out = 0, []
        for stretch, ref, zeros_, k in frame.sort_values("stretch")[["stretch", "ref", "zeros", "k"]].itertuples(index=False):
            if stretch:
                n += not any(low <= ref <= high for low, high in given)
                known.add(int(ref))
            if zeros_ > 0:
                stop = min((r for r in known if r > n), default=1 << 40)
                out.append((stretch, n - int(k) + 1, stop))
                given.append((n + 1, min(n + int(zeros_), stop - 1)))
                n = given[-1][1]
        return pd.DataFrame(out, columns=["stretch", "shift", "stop"])

    rule = stretches.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(number, "stretch long, shift long, stop long")
    numbers = zeros.join(rule, "stretch").select("seq", F.least(F.col("k") + F.col("shift"), "stop").cast("int").alias("ref"))
    every = h.where("ref <> 0").unionByName(h.where("ref = 0").drop("ref").join(numbers, "seq").select("seq", "ref", "par", "pts"))
    return every.groupBy(F.col("ref").alias("hole")).agg(F.max_by(F.struct("seq", "par", "pts"), "seq").alias("h")).select("hole", "h.seq", "h.par", "h.pts")


def merged_groups(rows: DataFrame, key: list[str], item: Column, seq: str) -> DataFrame:
    """(key, n, items): items of equal keys in one array, in the order of seq."""
    got = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("s"), item.alias("item")))).alias("g"))
    return got.select(*key, F.size("g").cast("long").alias("n"), F.transform("g", lambda g: g["item"]).alias("items"))


def fill_rows(specs: DataFrame) -> DataFrame:
    """(category, type, ratio, source, ids): the features that share a fill, as a sorted list in one string."""
    ids = F.array_sort(F.collect_set("osm_id"))
    return specs.groupBy("category", "type", "ratio", "source").agg(F.array_join(F.transform(ids, lambda i: i.cast("string")), ", ").alias("ids"))


def resolved_specs(specs: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Specs with their catalog entry, and those that have none."""
    keys = ["category", "type"]
    return specs.join(catalog, keys), specs.join(catalog, keys, "left_anti")


def pearls(paths: DataFrame, spacing: float) -> DataFrame:
    """(path, k, x, z, yaw): points at equal distances of about spacing along each polyline (path, i, x, z), each with the heading to
    the next; the last point only ends the line."""
    w = W.partitionBy("path").orderBy("i")
    seg = paths.withColumns({"nx": F.lead("x").over(w), "nz": F.lead("z").over(w)}).where("nx IS NOT NULL")
    seg = seg.withColumn("len", F.sqrt(F.pow(F.col("nx") - F.col("x"), F.lit(2)) + F.pow(F.col("nz") - F.col("z"), F.lit(2)))).where("len > 0")
    upto = F.sum("len").over(w.rowsBetween(W.unboundedPreceding, 0))
    seg = seg.withColumns({"stop": upto, "start": upto - F.col("len"), "total": F.sum("len").over(W.partitionBy("path"))})
    n = F.greatest(F.lit(2), F.floor(F.col("total") / spacing).cast("int") + 1)
    line = seg.groupBy("path").agg(F.max("total").alias("total")).withColumn("n", n)
    sites = line.select("path", "total", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).withColumn("d", F.col("total") * F.col("k") / (F.col("n") - 1))
    on = sites.join(seg.drop("total"), "path").where("d >= start AND (d < stop OR k = n - 1) AND d <= stop + 1e-9")
    on = on.groupBy("path", "k", "n", "d").agg(F.max_by(F.struct("x", "z", "nx", "nz", "len", "start"), "start").alias("s"))
    t = (F.col("d") - F.col("s.start")) / F.col("s.len")
    at = on.select("path", "k", (F.col("s.x") + (F.col("s.nx") - F.col("s.x")) * t).alias("x"), (F.col("s.z") + (F.col("s.nz") - F.col("s.z")) * t).alias("z"))
    v = W.partitionBy("path").orderBy("k")
    return at.withColumn("yaw", F.degrees(F.atan2(F.lead("x").over(v) - F.col("x"), F.lead("z").over(v) - F.col("z"))))


def cart_path_stamps(paths: DataFrame, raster: DataFrame, grid: Grid, spacing: float, radius: float, reach: float, brush: int = 15) -> DataFrame:
    """(path, k, x, z, scale_x, scale_z, value, brush, rotation, tool): a stamp at each pearl but the last, as high as the ground about it; none without ground."""
    p = pearls(paths, spacing).where("yaw IS NOT NULL").withColumn("site", F.struct("path", "k"))
    h = sample_mean(p, raster, grid, "site", F.lit(reach)).where("mean_h IS NOT NULL")
    return p.join(h, "site").select("path", "k", "x", "z", F.lit(radius).alias("scale_x"), F.lit(radius).alias("scale_z"), F.col("mean_h").alias("value"), F.lit(brush).alias("brush"), F.col("yaw").alias("rotation"), F.lit(0).alias("tool"))


def splines(features: DataFrame, offset: float = 1000.0) -> DataFrame:
    """(osm_id, surface, second, second_width, width, points): closed splines of area features (osm_id, kind, pts); unknown kinds have none."""
    spark = features.sparkSession
    params = spark.createDataFrame([(k, *v) for k, v in SPLINES.items()], "kind string, surface string, width double, handle double, tight boolean, second string, second_width double")
    moved = F.transform("pts", lambda p: F.struct((p["x"] - offset).alias("x"), (p["z"] - offset).alias("z")))

    def drawn(pts: Column) -> Column:
        return G.let(G.is_clockwise(pts), lambda cw: G.let(G.shrunk(pts, F.col("width") / 2, cw), lambda inner: G.waypoints(inner, F.col("handle"), cw, F.col("tight"))))

    points = G.let(G.let(moved, lambda p: G.without_near_points(p, F.lit(True))), drawn)
    return features.join(F.broadcast(params), "kind").select("osm_id", "kind", "surface", "second", "second_width", "width", points.alias("points"))


def water_levels(waters: DataFrame, sites: DataFrame, percentile: float = 0.9) -> DataFrame:
    """(poly, n, level): the percentile of heights (site, x, z, h) that lie in each water polygon; null level without any."""
    at = sites.groupBy("x", "z", "h").agg(F.count("*").alias("n"))
    inside = at_places(at, polygons_at(at.select("x", "z").distinct(), waters, "poly", 64.0)).repartition("poly")
    level = inside.groupBy("poly").agg(F.sum("n").alias("n"), F.percentile("h", percentile, F.col("n")).alias("level"))
    return waters.select("poly").join(level.hint("merge"), "poly", "left").select("poly", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "level")
