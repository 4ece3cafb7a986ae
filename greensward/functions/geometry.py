"""Column functions on arrays of points (structs of x and z), and small scalar helpers."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: as a lambda's variable it isn't copied to each place where it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def before(pts: Column, i: Column) -> Column:
    """The point before place i, around the end."""
    return F.get(pts, (i + F.size(pts) - 1) % F.size(pts))


def after(pts: Column, i: Column) -> Column:
    return F.get(pts, (i + 1) % F.size(pts))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], F.lit(2)) + F.pow(a["z"] - b["z"], F.lit(2)))


def tangent(a: Column, b: Column) -> Column:
    return F.atan2(b["z"] - a["z"], b["x"] - a["x"])


def is_clockwise(pts: Column) -> Column:
    """Sign of the shoelace sum of a closed ring; zero counts as clockwise."""
    parts = F.transform(pts, lambda p, i: (p["x"] - before(pts, i)["x"]) * (p["z"] + before(pts, i)["z"]))
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) >= 0


def without_near_points(pts: Column, closed: Column, epsilon: float = 0.5) -> Column:
    """Without points that lie within epsilon of the one kept before them and, if closed, a last one that meets the first. What would
    have fewer than two points stays as it was."""
    empty = F.slice(pts, 1, 0)
    kept = F.aggregate(pts, empty, lambda acc, p: F.when((F.size(acc) == 0) | (distance(F.element_at(acc, -1), p) > epsilon), F.concat(acc, F.array(p))).otherwise(acc))

    def cut(k: Column) -> Column:
        meets = closed & (F.size(k) > 2) & (distance(F.get(k, F.lit(0)), F.element_at(k, -1)) <= epsilon)
        return F.when(meets, F.slice(k, 1, F.size(k) - 1)).otherwise(k)

    return let(let(kept, cut), lambda c: F.when((F.size(pts) < 2) | (F.size(c) < 2), pts).otherwise(c))


def shrunk(pts: Column, by: Column, clockwise: Column) -> Column:
    """Every point moved inwards along its normal."""

    def move(p: Column, i: Column) -> Column:
        normal = tangent(before(pts, i), after(pts, i)) - math.pi / 2 + F.when(clockwise, 0.0).otherwise(math.pi)
        return F.struct((p["x"] + F.cos(normal) * by).alias("x"), (p["z"] + F.sin(normal) * by).alias("z"))

    return F.when(by == 0, pts).otherwise(F.transform(pts, move))


def waypoints(pts: Column, handle: Column, clockwise: Column, tight: Column, cap: float | None = 0.3) -> Column:
    """Points with two handles each, as an array of struct(pointOne, pointTwo, waypoint), to 3 decimals. A handle is no longer than
    cap times the shorter neighbouring side."""

    def point(x: Column, z: Column) -> Column:
        return F.struct(F.round(x, 3).alias("x"), F.round(z, 3).alias("y"))

    def build(t: Column, i: Column) -> Column:
        p, n = before(pts, i), after(pts, i)
        angle = tangent(p, n)
        limit = F.least(distance(p, t), distance(t, n)) * (cap or 0.0)
        size = F.when(limit > 0, F.least(handle, limit)).otherwise(handle)
        in_one, in_two = angle - 1.1 * math.pi / 2, angle - 0.9 * math.pi / 2
        one = F.when(~tight, angle + math.pi).when(clockwise, in_one).otherwise(in_two + math.pi)
        two = F.when(~tight, angle).when(clockwise, in_two).otherwise(in_one + math.pi)
        return F.struct(
            point(t["x"] + size * F.cos(one), t["z"] + size * F.sin(one)).alias("pointOne"),
            point(t["x"] + size * F.cos(two), t["z"] + size * F.sin(two)).alias("pointTwo"),
            point(t["x"], t["z"]).alias("waypoint"),
        )

    return F.transform(pts, build)


def bezier_points(p0: Column, p1: Column, p2: Column, p3: Column, last: Column) -> Column:
    """Points of a cubic Bezier segment: as many steps as the control polygon is long, 8 at least; the end only where last."""
    steps = F.greatest(F.lit(8), (distance(p0, p1) + distance(p1, p2) + distance(p2, p3)).cast("int"))

    def at(s: Column) -> Column:
        t = s / steps
        m = 1 - t
        value = lambda c: m * m * m * p0[c] + 3 * m * m * t * p1[c] + 3 * m * t * t * p2[c] + t * t * t * p3[c]
        return F.struct(value("x").alias("x"), value("z").alias("z"))

    return F.transform(F.sequence(F.lit(0), F.when(last, steps).otherwise(steps - 1)), at)


def cluster_count(radius: Column, spacing: Column) -> Column:
    """How many items of this spacing a circle holds: the area in squares of it, half to even, one at least."""
    return F.greatest(F.lit(1), F.rint(math.pi * F.pow(radius / spacing, F.lit(2))).cast("int"))


def snapped(h: Column, low: float, step: float, steps: int) -> Column:
    """A height snapped to low + k step, k from 0 to steps, half to even."""
    return low + F.least(F.greatest(F.rint((h - low) / step), F.lit(0.0)), F.lit(float(steps))) * step


def last_segment(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_version(stem: Column) -> Column:
    """A file stem without a trailing _N."""
    return F.regexp_replace(stem, r"_\d+$", "")


def tier_radii(largest: float, smallest: float, ratio: float, least_step: float = 1.0) -> list[float]:
    """Radii from largest to smallest, each less by the share 1 - ratio or by least_step, whichever is more."""
    if largest <= smallest or not 0 < ratio < 1:
        return [largest]
    out, r = [], largest
    while r > smallest:
        out.append(r)
        r -= max(r * (1 - ratio), least_step)
    return [*out, smallest]


def circle_ring(x: float, z: float, radius: float) -> tuple[list[tuple[float, float]], float]:
    """Four points of a circle and the handle length that makes Bezier arcs of them."""
    return [(x + radius, z), (x, z + radius), (x - radius, z), (x, z - radius)], 0.55228 * radius
