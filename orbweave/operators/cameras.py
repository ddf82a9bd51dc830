"""Cameras around objects: directions, places and axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def orbit_directions(k: Column, views: int, elevation: float) -> list[Column]:
    """Unit vectors at equal azimuths and one elevation (degrees)."""
    az, el = k * 2 * F.pi() / views, F.radians(F.lit(elevation))
    return [F.cos(el) * F.cos(az), F.cos(el) * F.sin(az), F.sin(el)]


def sphere_directions(k: Column, views: int) -> list[Column]:
    """Unit vectors spread evenly over the sphere, along a spiral by the golden ratio."""
    i = k + 0.5
    phi, theta = F.acos(1 - 2 * i / views), F.pi() * (1 + F.sqrt(F.lit(5.0))) * i
    return [F.cos(theta) * F.sin(phi), F.sin(theta) * F.sin(phi), F.cos(phi)]


def frames_of(points: DataFrame, group: str) -> DataFrame:
    """(group, cx, cy, cz, reach): the middle of each group's box and its longest side."""
    spans = [F.max(c) - F.min(c) for c in "xyz"]
    return points.groupBy(group).agg(*[((F.min(c) + F.max(c)) / 2).alias(f"c{c}") for c in "xyz"], F.greatest(*spans).alias("reach"))


def place_cameras(frames: DataFrame, views: int, directions, distance: float) -> DataFrame:
    """`frames` with k, x, y, z: `views` cameras each, `distance` times the reach away from the
    middle, along directions(k, views). A group of one point has them all in its middle."""
    each = frames.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(views - 1).cast("long"))))
    far = F.col("reach") * distance
    return each.select("*", *[(F.col(f"c{a}") + far * v).alias(a) for a, v in zip("xyz", directions(F.col("k"), views))])


def look_at(cameras: DataFrame) -> DataFrame:
    """`cameras` (x, y, z, cx, cy, cz) with unit axes right_*, up_*, back_* of a camera that
    looks at the middle; z is up, or y where it looks along z. One in its middle has nulls."""
    back = [F.col(a) - F.col(f"c{a}") for a in "xyz"]
    n = F.sqrt(back[0] * back[0] + back[1] * back[1] + back[2] * back[2])
    c = cameras.select("*", *[F.when(n > 0, b / n).alias(f"back_{a}") for a, b in zip("xyz", back)])
    bx, by, bz = (F.col(f"back_{a}") for a in "xyz")
    pole = F.abs(bz) > 0.999
    ux, uy, uz = F.lit(0.0), F.when(pole, 1.0).otherwise(0.0), F.when(pole, 0.0).otherwise(1.0)
    right = [uy * bz - uz * by, uz * bx - ux * bz, ux * by - uy * bx]
    m = F.sqrt(right[0] * right[0] + right[1] * right[1] + right[2] * right[2])
    c = c.select("*", *[(r / m).alias(f"right_{a}") for a, r in zip("xyz", right)])
    rx, ry, rz = (F.col(f"right_{a}") for a in "xyz")
    up = [by * rz - bz * ry, bz * rx - bx * rz, bx * ry - by * rx]
    return c.select("*", *[u.alias(f"up_{a}") for a, u in zip("xyz", up)])
