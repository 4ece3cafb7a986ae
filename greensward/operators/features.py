"""Map features: classification of tagged ways, assembly from nodes, masks, clipping, transverse Mercator and Lambert projections."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the tag scheme.
UNMASKED_KINDS = ("fairway", "green", "tee", "hole")
ROADWAYS = ("primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified", "residential", "living_street")
NO_FOOT = ("motorway", "motorway_link", "trunk", "trunk_link")
GOLF_AREAS = {
    "green": "green", "tee": "tee", "bunker": "bunker", "fairway": "fairway", "driving_range": "fairway", "rough": "rough",
    "water_hazard": "water", "lateral_water_hazard": "water", "clubhouse": "building",
}


def classified(ways: DataFrame, tags: str = "tags") -> DataFrame:
    """Ways with kind (null if unknown), is_area and mask; the first tag that decides wins."""
    t = lambda k: F.col(tags)[k]
    area = F.coalesce(t("area") == "yes", F.lit(False))
    known = lambda kind, is_area: F.struct(F.lit(kind).alias("kind"), (F.lit(is_area) if isinstance(is_area, bool) else is_area).alias("is_area"))
    nothing = F.lit(None).cast("struct<kind:string,is_area:boolean>")

    golf = nothing
    for value, kind in reversed(GOLF_AREAS.items()):
        golf = F.when(t("golf") == value, known(kind, True)).otherwise(golf)
    golf = F.when(t("golf") == "hole", known("hole", False)).when(t("golf").isin("cartpath", "path"), F.struct(t("golf").alias("kind"), area.alias("is_area"))).otherwise(golf)

    cart = F.coalesce(t("golf_cart") != "no", F.lit(False))
    foot = F.coalesce(t("foot"), F.when(t("highway").isin(*NO_FOOT), "no").otherwise("yes"))
    highway = (
        F.when(cart, known("cartpath", area))
        .when((t("highway") == "service") & (t("service") == "driveway"), known("driveway", area))
        .when(t("highway") == "service", known("service_road", area))
        .when(t("highway").isin(*ROADWAYS), known("roadway", area))
        .when(foot != "no", known("path", area))
        .otherwise(nothing)
    )
    found = (
        F.when(t("pga_scatter").isNotNull(), known("vegetation", True))
        .when(t("area:highway") == "footway", known("pavement", True))
        .when(t("leisure") == "golf_course", known("heavyrough", True))
        .when(t("golf").isNotNull(), golf)
        .when(t("waterway").isNotNull(), known("water", area))
        .when(t("building").isNotNull(), known("building", True))
        .when(t("natural").isin("wood", "water"), F.struct(t("natural").alias("kind"), F.lit(True).alias("is_area")))
        .when(t("natural") == "fell", known("mulch", True))
        .when(t("landuse") == "flowerbed", known("mulch", True))
        .when(t("highway").isNotNull() & ~t("highway").isin("proposed", "construction"), highway)
        .when((t("amenity") == "parking") & cart, known("cartpath", True))
        .when(t("amenity") == "parking", known("pavement", True))
        .otherwise(nothing)
    )
    return ways.withColumn("_k", found).select(*ways.columns, F.col("_k.kind").alias("kind"), F.col("_k.is_area").alias("is_area"), (~F.col("_k.kind").isin(*UNMASKED_KINDS)).alias("mask"))


def assembled(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """(osm_id, pts): ways (osm_id, node_ids) with their nodes' (x, z) in order; ways with a missing node are left out."""
    refs = ways.select("osm_id", F.posexplode("node_ids").alias("i", "node"))
    met = refs.join(nodes.select(F.col("node"), "x", "z"), "node", "left")
    whole = met.groupBy("osm_id").agg(F.array_sort(F.collect_list(F.struct("i", "x", "z"))).alias("p"), F.count("x").alias("has"), F.count("*").alias("of")).where("has = of")
    return whole.select("osm_id", F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["z"].alias("z"))).alias("pts"))


def kind_counts(features: DataFrame) -> DataFrame:
    return features.where("kind IS NOT NULL").groupBy("kind").agg(F.count("*").alias("n"))


def toggled(features: DataFrame, scope: Column) -> DataFrame:
    """Masks of the features in scope: all on if any is off, else all off."""
    all_on = features.where(scope).agg(F.coalesce(F.bool_and("mask"), F.lit(False)).alias("all_on"))
    return features.crossJoin(F.broadcast(all_on)).withColumn("mask", F.when(scope, ~F.col("all_on")).otherwise(F.col("mask"))).drop("all_on")  # one row


def shifted(features: DataFrame, dx: float, dz: float, pts: str = "pts") -> DataFrame:
    return features.withColumn(pts, F.transform(pts, lambda p: F.struct((p["x"] + dx).alias("x"), (p["z"] + dz).alias("z"))))


def clipped_rings(polygons: DataFrame, bounds: tuple[float, float, float, float], ring: str = "ring") -> DataFrame:
    """Rings clipped to a box, one half-plane after the other (Sutherland-Hodgman); those left with fewer than three points go.

    The half-planes are folded as data, since each step refers to the ring before it many times."""
    x0, z0, x1, z1 = bounds
    planes = F.array(*[F.struct(F.lit(by_x).alias("by_x"), F.lit(float(v)).alias("limit"), F.lit(low).alias("low")) for by_x, v, low in ((True, x0, False), (True, x1, True), (False, z0, False), (False, z1, True))])
    return polygons.withColumn(ring, F.aggregate(planes, F.col(ring), _half_plane)).where(F.size(ring) >= 3)


def _half_plane(ring: Column, plane: Column) -> Column:
    def along(p: Column) -> Column:
        return F.when(plane["by_x"], p["x"]).otherwise(p["z"])

    def ok(p: Column) -> Column:
        return F.when(plane["low"], along(p) <= plane["limit"]).otherwise(along(p) >= plane["limit"])

    def cut(p: Column, i: Column) -> Column:
        q = F.get(ring, (i + F.size(ring) - 1) % F.size(ring))
        t = (plane["limit"] - along(q)) / F.nullif(along(p) - along(q), F.lit(0.0))
        met = F.struct((q["x"] + (p["x"] - q["x"]) * t).alias("x"), (q["z"] + (p["z"] - q["z"]) * t).alias("z"))
        none = F.slice(F.array(p), 1, 0)
        return F.concat(F.when(ok(p) != ok(q), F.array(met)).otherwise(none), F.when(ok(p), F.array(p)).otherwise(none))

    return F.flatten(F.transform(ring, cut))


def largest_parts(parts: DataFrame, key: str, area: Column) -> DataFrame:
    """Of the parts of each key the largest."""
    rest = [c for c in parts.columns if c != key]
    return parts.groupBy(key).agg(F.max_by(F.struct(*rest), area).alias("p")).select(key, *[F.col(f"p.{c}").alias(c) for c in rest])


WGS84 = (6378137.0, 1 / 298.257223563)


def transverse_mercator(lat: Column, lon: Column, lon0: float, lat0: float = 0.0, k0: float = 0.9996, east: float = 500000.0, north: float = 0.0, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column]:
    """Easting and northing in metres by Krueger's series to the sixth order of the third flattening."""
    a, f = ellipsoid
    n = f / (2 - f)
    big = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    e = math.sqrt(f * (2 - f))
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2

    phi, lam = F.radians(lat), F.radians(lon - lon0)
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    y, x = xi, eta
    for j, c in enumerate(alpha, 1):
        y = y + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        x = x + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    p0 = math.radians(lat0)
    t0 = math.sinh(math.atanh(math.sin(p0)) - e * math.atanh(e * math.sin(p0)))
    xi0 = math.atan(t0)
    m0 = xi0 + sum(c * math.sin(2 * j * xi0) for j, c in enumerate(alpha, 1))
    return east + k0 * big * x, north + k0 * big * (y - m0)


def lambert_conformal(lat: Column, lon: Column, lat1: float, lat2: float, lat0: float, lon0: float, east: float = 0.0, north: float = 0.0, ellipsoid: tuple[float, float] = WGS84) -> tuple[Column, Column]:
    """Easting and northing in metres on a cone with two standard parallels."""
    a, f = ellipsoid
    e = math.sqrt(f * (2 - f))

    def m(p: float) -> float:
        return math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)

    def t(p: float) -> float:
        return math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)

    p0, p1, p2 = map(math.radians, (lat0, lat1, lat2))
    n = math.sin(p1) if lat1 == lat2 else (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big = a * m(p1) / (n * t(p1) ** n)
    phi = F.radians(lat)
    s = e * F.sin(phi)
    rho = big * F.pow(F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(e / 2)), F.lit(n))
    theta = n * F.radians(lon - lon0)
    return east + rho * F.sin(theta), north + big * t(p0) ** n - rho * F.cos(theta)
