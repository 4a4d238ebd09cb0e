"""Vectors, matrices, frames and quaternions; small selections of a viewer."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionq.functions import matrix as M
from motionq.functions import numeric
from motionq.functions import rotation as R
from motionq.operators import grids, lsh
from motionq.plans import sketches
from motionq.plans.common import E_SQL, Catalogue, read, vectors
from motionq.plans.motion import _Q_SQL, _T_SQL, trajectories
from motionq.tables import fresh

query = Catalogue()
_R_SQL = f"""{_Q_SQL}, r as (select view_id, [1 - 2 * (y * y + z * z), 2 * (x * y - s * z), 2 * (x * z + s * y), 2 * (x * y + s * z), 1 - 2 * (x * x + z * z), 2 * (y * z - s * x),
2 * (x * z - s * y), 2 * (y * z + s * x), 1 - 2 * (x * x + y * y)] m from q)"""


def turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras with the quaternion ``q`` and matrix ``m`` of their rotations."""
    c = read(spark, sf_dir, "camera").withColumn("q", R.q_euler(R.to_axes(F.col("rotations"))))
    return c.withColumn("m", R.q_to_matrix(F.col("q")))


@query(f"""with {_R_SQL}, i as (select view_id, i.range::int i, m, m[1 + 3 * (i.range % 3) + i.range // 3] back from r, range(9) i)
select view_id, i, round(m[i + 1], 6) m, round(case when i % 4 = 0 then 1 else 0 end + 0.5::double * back, 6) product, round(back / 1.25::double, 6) damped, round(m[1 + i // 3] * m[7 + i % 3], 6) "outer" from i""")
def matrix_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotation matrices: products with the transpose, sums, damped inverses, outer products of their rows."""
    t = turned(spark, sf_dir).select("view_id", "m", M.transpose(F.col("m"), 3).alias("t"))
    product = M.plus(M.multiply(F.col("m"), F.col("t"), 3, 3), F.col("t"), 0.5)
    outer = M.outer(M.part(F.col("m"), 3, 0, 0, 0, 2), M.part(F.col("m"), 3, 2, 2, 0, 2))
    cells = F.arrays_zip(F.col("m"), product.alias("product"), M.inverse(F.col("m"), 3, 0.5).alias("damped"), outer.alias("outer"))
    rows = t.select("view_id", F.posexplode(cells).alias("i", "c"))
    return rows.select("view_id", "i", *[(F.round(F.col("c")[n], 6) + 0.0).alias(n) for n in ("m", "product", "damped", "outer")])


@query(f"""with {_R_SQL}, d as (select view_id, m, c.cam_target[1] tx, c.cam_target[2] ty, c.cam_target[3] tz, c.cam_target[1] - c.cam_position[1] x, c.cam_target[2] - c.cam_position[2] y, c.cam_target[3] - c.cam_position[3] z from r join camera c using (view_id))
select view_id, round(m[1] * x + m[4] * y + m[7] * z, 6) x, round(m[2] * x + m[5] * y + m[8] * z, 6) y, round(m[3] * x + m[6] * y + m[9] * z, 6) z, round(tx, 6) tx, round(ty, 6) ty, round(tz, 6) tz from d""")
def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets in the frames of their cameras, and back."""
    t = turned(spark, sf_dir).withColumn("f", M.frame(F.col("m"), R.from_array(F.col("cam_position"))))
    t = t.withColumn("p", M.apply_point(M.frame_inverse(F.col("f")), R.from_array(F.col("cam_target")))).withColumn("t", M.apply_point(F.col("f"), F.col("p")))
    return t.select("view_id", *[(F.round(F.col("p")[c], 6) + 0.0).alias(c) for c in "xyz"], *[(F.round(F.col("t")[c], 6) + 0.0).alias(f"t{c}") for c in "xyz"])


@query("""with p as (select view_id, cam_position p, [cam_position[1] + 1 + view_id, cam_position[2] + 2, cam_position[3]] a from camera)
select view_id, round((1 + view_id) / sqrt((1 + view_id) * (1 + view_id) + 4), 6) x, round(2 / sqrt((1 + view_id) * (1 + view_id) + 4), 6) y, 1.0::double normal, round(sqrt((1 + view_id) * (1 + view_id) + 4::double), 6) ahead from p""")
def point_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames from three points of a level plane: x axis, normal, and the point ahead seen from inside."""
    c = read(spark, sf_dir, "camera").withColumn("o", R.from_array(F.col("cam_position")))
    ahead = R.add(F.col("o"), R.vec3(F.col("view_id") + 1, 2, 0))
    c = c.withColumn("a", ahead).withColumn("f", M.from_points(F.col("o"), F.col("a"), R.add(F.col("o"), R.vec3(-1, 3, 0))))
    axis = M.apply_vector(F.col("f"), R.vec3(1, 0, 0))
    return c.select(
        "view_id", F.round(axis["x"], 6).alias("x"), F.round(axis["y"], 6).alias("y"), F.round(M.apply_vector(F.col("f"), R.vec3(0, 0, 1))["z"], 6).alias("normal"), F.round(M.apply_point(M.frame_inverse(F.col("f")), F.col("a"))["x"], 6).alias("ahead")
    )


@query(f"""with {_Q_SQL}, n as (select *, sqrt(s * s + z * z) n, sqrt(x * x + y * y + z * z) v from q)
select view_id, round(abs(s / n), 6) twist_s, round(abs(z / n), 6) twist_z, round(s, 6) s, round(x, 6) x, round(y, 6) y, round(z, 6) z, round(2 * acos(greatest(least(s, 1), -1)), 6) angle, round(case when v < 1e-16 then 0 else x / v * acos(greatest(least(s, 1), -1)) end, 6) log_x from n""")
def quaternion_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twist about z, swing times twist, axis angle and logarithm of the camera rotations."""
    t = turned(spark, sf_dir)
    swing, twist = R.q_decompose(F.col("q"), R.vec3(0, 0, 1))
    t = t.withColumns({"swing": swing, "twist": twist, "aa": R.q_to_axis_angle(F.col("q")), "log": R.q_log(F.col("q"))})
    whole = R.q_mul(F.col("swing"), F.col("twist"))
    back = R.q_exp(F.col("log"))
    same = F.abs(R.q_dot(back, F.col("q"))) > 0.999999
    t = t.withColumn("w", whole).where(same)
    return t.select(
        "view_id", F.round(F.abs(F.col("twist.s")), 6).alias("twist_s"), F.round(F.abs(F.col("twist.z")), 6).alias("twist_z"), *[(F.round(F.col("w")[c], 6) + 0.0).alias(c) for c in ("s", "x", "y", "z")],
        F.round(R.length(F.col("aa")), 6).alias("angle"), (F.round(F.col("log.x"), 6) + 0.0).alias("log_x"),
    )


@query(f"""with {_T_SQL}, v as (select id, coords[1] ax, coords[2] ay, coords[3] az, coords[4] bx, coords[5] "by", coords[6] bz from t where len(coords) >= 6),
d as (select *, ax * bx + ay * "by" + az * bz p, sqrt(ax * ax + ay * ay + az * az) la, sqrt(bx * bx + "by" * "by" + bz * bz) lb from v)
select id, round(abs(p) / nullif(lb, 0), 4) along, round(-ay, 4) x, round(ax, 4) y, round(az, 4) z, round(case when la * lb > 0 then case when ax * "by" - ay * bx < 0 then -1 else 1 end * acos(greatest(least(p / (la * lb), 1), -1)) end, 6) angle from d""")
def vector3_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projection on each other, quarter turn about z, and signed angle about z of the first two coordinate triples."""
    at = lambda i: F.get("coords", F.lit(i))
    t = trajectories(spark, sf_dir).where("size(coords) >= 6").select("id", R.vec3(at(0), at(1), at(2)).alias("a"), R.vec3(at(3), at(4), at(5)).alias("b"))
    a, b, z = F.col("a"), F.col("b"), R.vec3(0, 0, 1)
    turn = R.rotate_about(a, z, F.lit(math.pi / 2))
    return t.select("id", F.round(R.length(R.project(a, b)), 4).alias("along"), *[(F.round(turn[c], 4) + 0.0).alias(c) for c in "xyz"], (F.round(R.signed_angle(a, b, z), 6) + 0.0).alias("angle"))


@query(f"""with {_T_SQL}, v as (select id, radians(coords[1]) x, radians(coords[2]) y, radians(coords[3]) z from t where len(coords) >= 3), n as (select *, sqrt(x * x + y * y + z * z) n from v where sqrt(x * x + y * y + z * z) > 0.01 and sqrt(x * x + y * y + z * z) < 3)
select id, round(cos(n / 2), 6) s, round(x * sin(n / 2) / n, 6) x, round(n, 5) angle, round(n, 5) nearest from n""")
def axis_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations given as axis angles below half a turn, to quaternions and back, also from a whole turn further."""
    at = lambda i: F.radians(F.get("coords", F.lit(i)))
    t = trajectories(spark, sf_dir).where("size(coords) >= 3").select("id", R.vec3(at(0), at(1), at(2)).alias("v"))
    t = t.where((R.length(F.col("v")) > 0.01) & (R.length(F.col("v")) < 3)).withColumn("q", R.axis_angle_to_q(F.col("v")))
    further = R.add(F.col("v"), R.scale(R.unit(F.col("v")), F.lit(2 * math.pi)))
    near = R.nearest_axis_angle(further, F.col("v"))
    return t.select("id", F.round(F.col("q.s"), 6).alias("s"), (F.round(F.col("q.x"), 6) + 0.0).alias("x"), F.round(R.length(R.q_to_axis_angle(F.col("q"))), 5).alias("angle"), F.round(R.length(near), 5).alias("nearest"))


@query("select view_id, 1.0::double radius, round(case when view_id = 0 then 0 end, 6) y from camera where view_id = 0 union all select view_id, 1.0, null from camera where view_id > 0")
def nurbs_arc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of a quarter circle as a rational curve: all at distance 1; y where the curve begins."""
    control, weights, knots = np.array([[1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]), np.array([1, math.sqrt(0.5), 1]), np.array([0, 0, 0, 1, 1, 1.0])

    @F.pandas_udf("x double, y double")
    def point(u: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([numeric.nurbs_point(control, weights, knots, 2, float(x)) for x in u], columns=["x", "y"])

    p = read(spark, sf_dir, "camera").select("view_id", point(F.col("view_id") / 20.0).alias("p"))
    return p.select("view_id", F.round(F.sqrt(F.col("p.x") * F.col("p.x") + F.col("p.y") * F.col("p.y")), 6).alias("radius"), F.when(F.col("view_id") == 0, F.round("p.y", 6)).alias("y"))


@query(f"""with {_T_SQL}, p as (select id, coords[1] x, coords[2] y, coords[3] z from t where len(coords) >= 3)
select x * x + y * y + z * z <= 900 sphere, x * x + y * y <= 400 and z between -30 and 30 cylinder, x * x + y * y + pow(greatest(abs(z) - 30, 0), 2) <= 400 capsule, x >= 5 beyond, count(*) n from p group by all""")
def solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions inside a sphere, a cylinder and a capsule about the z axis, and beyond a plane."""
    at = lambda i: F.get("coords", F.lit(i))
    v, low, high = R.vec3(at(0), at(1), at(2)), R.vec3(0, 0, -30), R.vec3(0, 0, 30)
    p = trajectories(spark, sf_dir).where("size(coords) >= 3")
    return p.groupBy(
        grids.inside_sphere(v, R.vec3(0, 0, 0), F.lit(30.0)).alias("sphere"), grids.inside_cylinder(v, low, high, F.lit(20.0)).alias("cylinder"), grids.inside_capsule(v, low, high, F.lit(20.0)).alias("capsule"),
        (grids.plane_side(v, R.vec3(5, 0, 0), R.vec3(1, 0, 0)) >= 0).alias("beyond"),
    ).agg(F.count("*").alias("n"))


@query(f"with {_T_SQL} select clip, 0::bigint first, count(distinct frame) - 1 last, (count(distinct frame) - 1) // 5 + 1 ticks from t group by clip")
def posture_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids.posture_range(trajectories(spark, sf_dir), ["clip"], "frame")


@query(f"with {_T_SQL} select id, clip, frame, coords[7] x, coords[8] y, coords[9] z from t where len(coords) >= 9")
def joint_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trajectory of joint 2 of each pose."""
    at = lambda i: F.get("coords", F.lit(i))
    return trajectories(spark, sf_dir).where("size(coords) >= 9").select("id", "clip", "frame", at(6).alias("x"), at(7).alias("y"), at(8).alias("z"))


@query(f"with {E_SQL} select vec_id, label, round(sum(v), 6) total from e where vec_id = 7 group by all")
def pick_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One result by its id."""
    e = vectors(spark, sf_dir).where("vec_id = 7")
    return e.select("vec_id", "label", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query(f"with {sketches._U_SQL}, s as (select table_id, bucket, count(*) n from t group by 1, 2) select sum(n)::bigint \"rows\", count(*) buckets, max(n) largest from s group by table_id")
def index_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket table built of the records of even ids, with the others appended, read again."""
    path, r = fresh(spark), sketches.records(spark, sf_dir)
    for half in (0, 1):
        lsh.bucket_table(r.where(F.col("id") % 2 == half), sketches.LSH, "id", "v").write.mode("append").parquet(path)
    return lsh.statistics(spark.read.parquet(path)).drop("table_id")


@query(f"with {E_SQL} select vec_id, count(*) filter (where ((vec_id * 7919 + (i - 1) * 104729 + 3 * 15485863) % 1009 * 48271 % 1009 < 302)) zeros, round(sum(v) filter (where ((vec_id * 7919 + (i - 1) * 104729 + 3 * 15485863) % 1009 * 48271 % 1009 >= 302)), 6) total from e where v <> 0 group by vec_id")
def degraded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of the vectors with three tenths of their values set to 0."""
    d = lsh.degraded(vectors(spark, sf_dir), "vec_id", "v", 0.3)
    zeros = F.size(F.filter("v", lambda x: x == 0)).cast("long")
    return d.select("vec_id", zeros.alias("zeros"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))
