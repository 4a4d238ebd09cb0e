"""Queries on grids and frame sequences."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionq.operators import grids, motion
from motionq.plans import histograms
from motionq.plans.common import U_SQL, Catalogue, read, usable_points

query = Catalogue()
_S = 0.3 * ((5 - 1) * 0.5 - 1) + 0.8
_K = [math.exp(-(i * i) / (2 * _S * _S)) for i in range(-2, 3)]
_W = ", ".join(f"({a - 2}, {b - 2}, {p * q / sum(_K) ** 2!r}::double)" for a, p in enumerate(_K) for b, q in enumerate(_K))


@query(f"with {histograms._GRID} select img, x + 3 x, y - 2 y, round(v, 4) v from g where x + 3 between 0 and 29 and y - 2 between 0 and 29")
def warp_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.warp(histograms.grid(spark, sf_dir), ["img"], 3, -2, 30, 30).withColumn("v", F.round("v", 4))


@query(f"with {histograms._GRID}, w as (select * from (values {_W}) t(a, b, w)) select img, x + a x, y + b y, round(sum(v * w), 6) v from g, w group by 1, 2, 3")
def blur_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.blur(histograms.grid(spark, sf_dir), ["img"])


@query(f"""with {U_SQL}, c as (select clip, coords[1] x, coords[2] y, frame % 2 half from u where clip is not null and frame is not null)
select clip, round(avg(x) filter (where half = 1) - avg(x) filter (where half = 0), 6) dx, round(avg(y) filter (where half = 1) - avg(y) filter (where half = 0), 6) dy from c group by clip having min(half) = 0 and max(half) = 1""")
def joint_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the odd and the even frames of a clip."""
    u = usable_points(spark, sf_dir).where("clip is not null and frame is not null and size(coords) >= 2")
    c = u.select("clip", "frame", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))
    return grids.translation(c.where("frame % 2 = 0"), c.where("frame % 2 = 1"), ["clip"])


@query("select unit_path, t.range tick, first_frame + (t.range * 5) % (last_frame - first_frame + 1) frame from units, range(10) t where last_frame >= first_frame")
def playback_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames shown at the first ten ticks of five frames each."""
    u = read(spark, sf_dir, "units").where("last_frame >= first_frame").withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(9)).cast("array<long>")))
    return u.select("unit_path", "tick", grids.playback(F.col("tick") * 5, F.col("first_frame"), F.col("last_frame")).alias("frame"))


@query("select unit_path, t.range tick, (floor(t.range * 30 * 0.024::double))::bigint % (last_frame - first_frame + 1) frame from units, range(50) t where last_frame >= first_frame")
def playback_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames shown at ticks of 30 milliseconds at 24 frames a second."""
    u = read(spark, sf_dir, "units").where("last_frame >= first_frame").withColumn("tick", F.explode(F.sequence(F.lit(0), F.lit(49)).cast("array<long>")))
    return u.select("unit_path", "tick", motion.frame_at(F.col("tick") * 30, 24.0, F.col("last_frame") - F.col("first_frame") + 1).alias("frame"))
