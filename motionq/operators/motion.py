"""Poses and rotations over time: distances, interpolation, up-sampling."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionq.functions import vec
from motionq.functions.numeric import spline, spline_at
from motionq.operators import series


def pose_distance(a: vec.Vec, b: vec.Vec) -> Column:
    """Sum over bones (three values each) of the norm of the difference; null when lengths differ."""
    ca, cb = vec.col(a), vec.col(b)
    d = F.zip_with(ca, cb, lambda x, y: (x - y) * (x - y))
    bones = F.sequence(F.lit(0), F.floor((F.size(ca) - 1) / 3).cast("int"))
    norms = F.transform(bones, lambda i: F.sqrt(F.aggregate(F.slice(d, i * 3 + 1, 3), F.lit(0.0), lambda s, v: s + v)))
    return F.when(F.size(ca) == F.size(cb), F.aggregate(norms, F.lit(0.0), lambda s, v: s + v))


def pose_distance_long(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The same over rows ``(keys, bone, rx, ry, rz)`` joined by bone with pose ``b(bone, rx, ry, rz)``."""
    q = b.select("bone", *[F.col(c).alias(f"q{c}") for c in ("rx", "ry", "rz")])
    d = sum(((F.col(c) - F.col(f"q{c}")) * (F.col(c) - F.col(f"q{c}")) for c in ("rx", "ry", "rz")), F.lit(0.0))
    return a.join(q, "bone").groupBy(*keys).agg(F.round(F.sum(F.sqrt(d)), 6).alias("distance"))


def interpolate(frames: DataFrame, keys: list[str], order: str, tie: str, vector: str, weight: float, width: int) -> DataFrame:
    """Adds ``between``: ``weight * previous + (1 - weight) * this`` pose; null for the first, or other lengths."""
    rows = series.with_previous(frames, keys, order, tie, [vector], width)
    before = F.col("prev")[vector]
    mixed = F.zip_with(before, vector, lambda a, b: a * F.lit(weight) + b * F.lit(1 - weight))
    return rows.withColumn("between", F.when(F.size(before) == F.size(vector), mixed)).drop("prev")


def unwrap(v: np.ndarray) -> np.ndarray:
    """Axis angles (rows) with whole turns added so that each is nearest to the one before."""
    out = np.array(v, float)
    for i in range(1, len(out)):
        n = np.linalg.norm(out[i])
        axis = out[i] / n if n > 1e-12 else out[i - 1] / max(np.linalg.norm(out[i - 1]), 1e-12)
        out[i] += axis * np.round(axis @ (out[i - 1] - out[i]) / (2 * np.pi)) * 2 * np.pi
    return out


def angular_velocity(v: np.ndarray, dv: np.ndarray) -> np.ndarray:
    """Angular velocity of rotations given as axis angles ``v`` with derivatives ``dv``."""
    theta = np.linalg.norm(v, axis=1, keepdims=True)
    small = theta < 1e-6
    t = np.where(small, 1, theta)
    a = np.where(small, 0.5, (1 - np.cos(t)) / t**2)
    b = np.where(small, 1 / 6, (t - np.sin(t)) / t**3)
    w = np.cross(v, dv)
    return dv + a * w + b * np.cross(v, w)


def overlapping(keys_: DataFrame, group: list[str], part: str, time: str) -> DataFrame:
    """Keys of a series cut into parts, with the first key of each part also as the last of the part before it.

    Parts without keys are passed over. One summary row a part tells which comes before which.
    """
    rest = [c for c in keys_.columns if c not in (*group, part, time)]
    order = F.struct(time, *rest)
    first = keys_.groupBy(*group, part).agg(F.min(order).alias("_first"))
    before = first.withColumn("_before", F.lag(part).over(Window.partitionBy(*group).orderBy(part))).where("_before is not null")
    ends = before.select(*group, F.col("_before").alias(part), "_first.*")
    return keys_.unionByName(ends)


def up_sample(keys_: DataFrame, group: list[str], fps: float, kind: str = "natural", nearest: bool = True, bone: str | None = None) -> DataFrame:
    """``(group, t, rx, ry, rz, wx, wy, wz)``: cubic spline through axis-angle keys ``(group, t, rx, ry, rz)`` at a new rate.

    A group is one bone of one clip (or of a segment of it): bounded by the length of a take. With ``bone``, a column that
    follows the group in the result, a group holds all bones of a take and each is taken for itself. With ``nearest``,
    keys are first unwrapped. ``kind``: natural, clamped (ends at rest) or periodic. Keys at one time: the first counts.
    """
    by = [*group, bone] if bone else group
    types = ", ".join(f"{k} {keys_.schema[k].dataType.simpleString()}" for k in by)

    def one(t: np.ndarray, v: np.ndarray) -> np.ndarray:
        first = np.concatenate([[True], np.diff(t) > 0])
        t, v = t[first], v[first]
        v = unwrap(v) if nearest else v
        at = np.arange(int(np.floor((t[-1] - t[0]) * fps + 1e-9)) + 1) / fps + t[0]
        m = spline(t, v, kind)
        r, d = spline_at(t, v, m, at), spline_at(t, v, m, at, 1)
        return np.column_stack([at, r, angular_velocity(r, d)])

    def work(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        t, *v = (rows.column(c).to_numpy() for c in ("t", "rx", "ry", "rz"))
        own = pc.rank(rows.column(bone), tiebreaker="min").to_numpy() if bone else np.zeros(len(t), np.int64)
        order = np.lexsort((*v[::-1], t, own))
        parts = np.split(order, np.flatnonzero(np.diff(own[order].astype(np.int64))) + 1)
        v = np.column_stack(v)
        found = [one(t[p], v[p]) for p in parts]
        again = pa.array(np.repeat([p[0] for p in parts], [len(x) for x in found]))
        values = np.concatenate(found)
        return pa.table({**{k: rows.column(k).take(again) for k in by}, **{c: values[:, i] for i, c in enumerate(("t", "rx", "ry", "rz", "wx", "wy", "wz"))}})

    rows = keys_.select(*by, "t", "rx", "ry", "rz").dropna(subset=["t", "rx", "ry", "rz", *([bone] if bone else [])])
    return rows.groupBy(*group).applyInArrow(work, f"{types}, t double, rx double, ry double, rz double, wx double, wy double, wz double")


def joint_probability(points: DataFrame, box: tuple[tuple[float, float], ...], bins: int, group: list[str], columns: list[str]) -> DataFrame:
    """``(group, bins of each column, p)``: share of a group's positions in each cell of a bounding box; others are left out."""
    inside = F.lit(True)
    for c, (lo, hi) in zip(columns, box, strict=True):
        inside = inside & (F.col(c) >= lo) & (F.col(c) <= hi)
    cells = [vec.bin_index(F.col(c), lo, hi, bins).alias(f"{c}_bin") for c, (lo, hi) in zip(columns, box, strict=True)]
    n = points.where(inside).groupBy(*group, *cells).agg(F.count("*").alias("n"))
    total = n.groupBy(*group).agg(F.sum("n").alias("t"))
    return n.join(total, group).withColumn("p", F.round(F.col("n") / F.col("t"), 6)).drop("n", "t")


def frame_at(time_ms: Column, fps: float, frames: Column) -> Column:
    """The frame (from 0) that is shown at a time when a sequence of ``frames`` runs at ``fps`` and repeats."""
    return F.pmod(F.floor(time_ms * F.lit(fps / 1000.0)).cast("long"), frames.cast("long"))
