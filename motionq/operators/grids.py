"""Small operators on grids, positions and frame sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionq.functions import rotation as R
from motionq.operators.histograms import smeared


def warp(grid: DataFrame, keys: list[str], dx: int, dy: int, rows: int, cols: int) -> DataFrame:
    """``(keys, x, y, v)`` moved by whole cells; what leaves the canvas is cut."""
    x, y = F.col("x") + F.lit(dx), F.col("y") + F.lit(dy)
    return grid.where(x.between(0, rows - 1) & y.between(0, cols - 1)).select(*keys, x.alias("x"), y.alias("y"), "v")


def blur(grid: DataFrame, keys: list[str], width: int = 5, sigma: float | None = None) -> DataFrame:
    """``(keys, x, y, v)``: Gaussian blur of the present cells, absent ones being 0; ``sigma`` by the width if not given.

    One axis after the other; cells next to present ones appear.
    """
    half = width // 2
    s = sigma or 0.3 * ((width - 1) * 0.5 - 1) + 0.8
    one = [math.exp(-(i * i) / (2 * s * s)) for i in range(-half, half + 1)]
    moved = smeared(grid.select(*keys, "x", "y", "v"), keys, [w / sum(one) for w in one], ["v"])
    return moved.withColumn("v", F.round("v", 6))


def translation(a: DataFrame, b: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """``(keys, dx, dy)``: mean position in ``b`` less mean position in ``a``; keys of one side only are left out."""
    mean = lambda df, s: df.groupBy(*keys).agg(F.avg(x).alias(f"{s}x"), F.avg(y).alias(f"{s}y"))
    both = mean(a, "a").join(mean(b, "b"), keys)
    return both.select(*keys, F.round(F.col("bx") - F.col("ax"), 6).alias("dx"), F.round(F.col("by") - F.col("ay"), 6).alias("dy"))


def playback(tick: Column, first: Column, last: Column) -> Column:
    """The frame shown at a tick when frames first..last repeat."""
    return first + F.pmod(tick, last - first + 1)


def unproject(x: Column, y: Column, depth: Column, inverse: list[list[float]], width: int, height: int) -> Column:
    """Canvas position and depth (0..1) to space, by the inverse of the 4 x 4 view-projection matrix."""
    ndc = [x / F.lit(width / 2) - 1, F.lit(1.0) - y / F.lit(height / 2), depth * 2 - 1, F.lit(1.0)]
    p = [sum((F.lit(float(m)) * c for m, c in zip(row, ndc, strict=True)), F.lit(0.0)) for row in inverse]
    return F.struct(*[F.try_divide(p[i], p[3]).alias(n) for i, n in enumerate("xyz")])


def vertex_normals(mesh: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, vertex, nx, ny, nz)``: unit sums of the normals of the triangles at each vertex, weighted by their area.

    ``mesh(keys, face, corner, vertex, x, y, z)``: the first three corners of a face count. Vertices without area have nulls.
    """
    at = lambda c, i: F.max(F.when(F.col("corner") == i, F.col(c))).alias(f"{c}{i}")
    faces = mesh.groupBy(*keys, "face").agg(*[at(c, i) for c in "xyz" for i in range(3)])
    d = {f"{c}{i}": F.col(f"{c}{i}") - F.col(f"{c}0") for c in "xyz" for i in (1, 2)}
    cross = [d[f"{a}1"] * d[f"{b}2"] - d[f"{b}1"] * d[f"{a}2"] for a, b in ("yz", "zx", "xy")]
    normal = faces.select(*keys, "face", *[n.alias(f"n{c}") for n, c in zip(cross, "xyz", strict=True)])
    sums = mesh.join(normal, [*keys, "face"]).groupBy(*keys, "vertex").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])
    size = F.sqrt(sum((F.col(f"n{c}") * F.col(f"n{c}") for c in "xyz"), F.lit(0.0)))
    return sums.select(*keys, "vertex", *[F.round(F.try_divide(f"n{c}", size), 6).alias(f"n{c}") for c in "xyz"])


def inside_sphere(v: Column, centre: Column, radius: Column) -> Column:
    return R.let(R.sub(v, centre), lambda d: R.dot3(d, d)) <= radius * radius


def inside_capsule(v: Column, a: Column, b: Column, radius: Column) -> Column:
    """Within ``radius`` of the segment from ``a`` to ``b``."""
    way, off = R.sub(b, a), R.sub(v, a)
    t = F.greatest(F.least(F.coalesce(F.try_divide(R.dot3(off, way), R.dot3(way, way)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return inside_sphere(v, R.let(t, lambda t: R.add(a, R.scale(way, t))), radius)


def inside_cylinder(v: Column, a: Column, b: Column, radius: Column) -> Column:
    """Between the discs of ``radius`` about ``a`` and ``b``; a cylinder without height holds nothing."""
    way, off = R.sub(b, a), R.sub(v, a)
    t = F.try_divide(R.dot3(off, way), R.dot3(way, way))
    return F.coalesce(R.let(t, lambda t: t.between(0.0, 1.0) & inside_sphere(v, R.add(a, R.scale(way, t)), radius)), F.lit(False))


def plane_side(v: Column, point: Column, normal: Column) -> Column:
    """Signed distance to the plane through ``point`` with unit ``normal``."""
    return R.dot3(R.sub(v, point), normal)


def posture_range(frames: DataFrame, keys: list[str], frame: str, interval: int = 5) -> DataFrame:
    """``(keys, first, last, ticks)``: the range 0 to n - 1 of a sequence of n different frames, and its marks every ``interval``."""
    n = frames.where(F.col(frame).isNotNull()).groupBy(*keys).agg(F.countDistinct(frame).alias("n"))
    return n.select(*keys, F.lit(0).cast("long").alias("first"), (F.col("n") - 1).alias("last"), F.expr(f"(n - 1) div {interval} + 1").alias("ticks"))
