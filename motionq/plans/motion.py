"""Trajectories, curves, rotations and refinement. Trajectories are ``points`` of a clip by frame; x and y are the first two coordinates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motionq.functions import batch, vec
from motionq.functions import rotation as R
from motionq.operators import curves, motion, refine, series
from motionq.plans.common import U_SQL, Catalogue, read, usable_points, vector_of, vectors

query = Catalogue()
#: Frames in a block of a series.
BLOCK = 4096
_T_SQL = f"{U_SQL}, t as (select id, clip, frame, coords[1] x, coords[2] y, coords from u where clip is not null and frame is not null)"


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = usable_points(spark, sf_dir).where("clip is not null and frame is not null and size(coords) >= 2")
    return u.select("id", "clip", "frame", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"), "coords")


@query(f"""with {_T_SQL}, l as (select *, sqrt(pow(x - lag(x) over w, 2) + pow(y - lag(y) over w, 2)) s from t window w as (partition by clip order by frame, id)),
c as (select id, clip, sum(coalesce(s, 0)) over (partition by clip order by frame, id) l, sum(coalesce(s, 0)) over (partition by clip) a from l)
select id, clip, round(l, 2) length, round(l / nullif(a, 0), 6) chord from c""")
def chord_param(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = series.chord_parameter(trajectories(spark, sf_dir), ["clip"], "frame", "id", "x", "y", BLOCK)
    return c.select("id", "clip", F.round("length", 2).alias("length"), F.round("chord", 6).alias("chord"))


@query("""select event_id, round(sum(abs(value)) over (partition by user_id order by ts, event_id), 4) total from events""")
def cum_curvature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running integral of an absolute value along each user's series; seconds order the blocks."""
    e = read(spark, sf_dir, "events").withColumn("s", F.unix_micros(F.col("ts").cast("timestamp")))
    r = series.running_total(e, ["user_id"], "s", "event_id", F.abs("value"), 86_400_000_000)
    return r.select("event_id", F.round("total", 4).alias("total"))


@query(f"""with {_T_SQL}, l as (select id, clip, coords c, lag(coords) over (partition by clip order by frame, id) p from t)
select id, round(list_sum(list_transform(range(1, len(c) + 1), lambda i: 0.25::double * p[i] + 0.75::double * c[i])), 4) total, len(c)::int n from l where len(p) = len(c)""")
def pose_lerp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pose between each frame and the one before it in its clip."""
    rows = motion.interpolate(trajectories(spark, sf_dir), ["clip"], "frame", "id", "coords", 0.25, BLOCK).where("between is not null")
    return rows.select("id", F.round(vec.total("between"), 4).alias("total"), F.size("between").alias("n"))


#: Equal parts into which a segment is cut by ordinal; a row counts in each part by the share of it that lies there.
PARTS = 64


@query(f"""with {_T_SQL}, o as (select clip, frame // 64 seg, (row_number() over (partition by clip, frame // 64 order by frame, id) - 1) i, x, count(*) over (partition by clip, frame // 64) n from t),
v as (select clip, seg, j, sum(x * (least((i + 1) * {PARTS}, (j + 1) * n) - greatest(i * {PARTS}, j * n)) / n) v from o join range({PARTS}) p(j) on i * {PARTS} < (j + 1) * n and j * n < (i + 1) * {PARTS} group by 1, 2, 3 having max(n) > 1),
k as (select clip, seg from o group by 1, 2 having min(x) < max(x)), q as (select j, v q from v join (select * from k order by clip, seg limit 1) using (clip, seg))
select clip, seg, round(corr(v, q), 6) score from v join k using (clip, seg) join q using (j) group by 1, 2 order by score desc nulls last, clip, seg limit 50""")
def curve_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of 64 frames, by all their values of x brought to equal length, correlated with the first segment that varies."""
    return whole_curves(trajectories(spark, sf_dir))


def whole_curves(t: DataFrame) -> DataFrame:
    t = t.select("clip", F.expr("frame div 64").alias("seg"), "frame", "id", "x")
    segment = Window.partitionBy("clip", "seg")
    t = t.withColumns({"i": F.row_number().over(segment.orderBy("frame", "id")) - 1, "n": F.count("*").over(segment), "least": F.min("x").over(segment), "most": F.max("x").over(segment)})
    t = t.where("least < most").withColumn("j", F.explode(F.expr(f"sequence(i * {PARTS} div n, ((i + 1) * {PARTS} - 1) div n)")))
    share = F.expr(f"(least((i + 1) * {PARTS}, (j + 1) * n) - greatest(i * {PARTS}, j * n)) / n")
    v = t.groupBy("clip", "seg", "j").agg(F.sum(F.col("x") * share).alias("v"))
    per = v.groupBy("clip", "seg").agg(F.array_sort(F.collect_list(F.struct("j", "v"))).alias("s")).select("clip", "seg", F.transform("s", lambda r: r["v"]).alias("x"))
    q = per.orderBy("clip", "seg").first()
    return per.select("clip", "seg", F.round(batch.against("x", list(q["x"]) if q else [0.0] * PARTS), 6).alias("score")).orderBy(F.desc_nulls_last("score"), "clip", "seg").limit(50)


@query(f"""with {_T_SQL}, g as (select clip, frame // 256 seg, count(*) points, min(x) < max(x) or min(y) < max(y) varies from t group by 1, 2)
select clip, seg, case when varies then 117 else 0 end::int n, varies and points > 1 as "moves" from g""")
def curve_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arc-length curve features of segments of 256 frames: their sizes, and which segments have a length."""
    t = trajectories(spark, sf_dir).withColumn("seg", F.expr("frame div 256"))
    f = curves.features(t, ["clip", "seg"], "frame", "x", "y")
    return f.select("clip", "seg", F.size("feature").alias("n"), (F.col("total") > 0).alias("moves"))


def drawn_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each view three quarters of a circle of radius ``view_id + 1``, and a line, in 400 points each."""
    at = read(spark, sf_dir, "camera").select("view_id", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("i"))
    turn, r = F.col("i") * F.lit(1.5 * math.pi / 399), (F.col("view_id") + 1).cast("double")
    circle = at.select("view_id", F.lit("circle").alias("kind"), "i", (r * F.cos(turn)).alias("x"), (r * F.sin(turn)).alias("y"))
    return circle.unionByName(at.select("view_id", F.lit("line").alias("kind"), "i", (F.col("i") * 3.0).alias("x"), (F.col("i") * 4.0).alias("y")))


def _middle(version: int):
    """Size, total and middle curvature of the features of a version."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = curves.features(drawn_curves(spark, sf_dir), ["view_id", "kind"], "i", "x", "y", version=version)
        k = F.get("feature", F.lit(62 if version == 1 else 20)) if version < 3 else F.get("feature", F.lit(4))
        return f.select("view_id", "kind", F.size("feature").alias("n"), F.round("total", 0).alias("total"), (F.round(k, 2) + 0.0).alias("middle"))

    return run


_TURN = 1.5 * math.pi
for _version, _circle, _line in (
    (1, f"117 n, round({_TURN!r}::double * (view_id + 1), 0) total, round(1.0::double / (view_id + 1), 2) middle", "117, 1995.0::double, 0.0::double"),
    (2, f"40 n, round({_TURN!r}::double, 0) total, round(1.0::double / (view_id + 1), 2) middle", "40, 0.0::double, 0.0::double"),
    (3, f"10 n, round({_TURN!r}::double, 0) total, 0.0::double middle", "0, 0.0::double, null"),
):
    _f = _middle(_version)
    _f.__name__ = f"curve_v{_version}"
    query(f"select view_id, 'circle' kind, {_circle} from camera union all select view_id, 'line', {_line} from camera")(_f)


@query(f"""with {_T_SQL}, r as (select clip, frame, least(len(coords) // 3, 100) bones, coords from t where len(coords) >= 3), b as (select clip, frame, (bone.range)::int bone, radians(coords[3 * bone.range + 1]) rx, radians(coords[3 * bone.range + 2]) ry, radians(coords[3 * bone.range + 3]) rz from r, range(34) bone where bone.range < bones),
k as (select * from b qualify row_number() over (partition by clip, frame, bone order by rx, ry, rz) = 1)
select clip, frame, bone, round(rx, 6) rx, round(ry, 6) ry, round(rz, 6) rz from k""")
def up_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rotations of all bones at 60 frames a second through keys at 30, seen at the keys.

    Takes of 256 frames, each with the first key of the take after it, so that no time between keys is left out.
    """
    t = trajectories(spark, sf_dir).where("size(coords) >= 3").withColumn("seg", F.expr("frame div 256"))
    bones = F.sequence(F.lit(0), (F.floor(F.size("coords") / 3) - 1).cast("int"))
    t = t.select("clip", "seg", "frame", F.explode(bones).alias("bone"), "coords")
    r = lambda i: F.radians(F.get("coords", F.col("bone") * 3 + i))
    k = t.select("clip", "bone", "seg", (F.col("frame") / 30.0).alias("t"), r(0).alias("rx"), r(1).alias("ry"), r(2).alias("rz"))
    up = motion.up_sample(motion.overlapping(k, ["clip", "bone"], "seg", "t"), ["clip", "seg"], 60.0, nearest=False, bone="bone")
    at = k.select("clip", "bone", "seg", F.round(F.col("t") * 60).cast("long").alias("tick")).distinct()
    up = up.withColumn("tick", F.round(F.col("t") * 60).cast("long")).join(at, ["clip", "bone", "seg", "tick"])
    return up.select("clip", F.expr("tick div 2").alias("frame"), "bone", *[F.round(c, 6).alias(c) for c in ("rx", "ry", "rz")])


_Q_SQL = """a as (select view_id, radians(rotations[1]) / 2 x, radians(rotations[2]) / 2 y, radians(rotations[3]) / 2 z from camera),
q as (select view_id, cos(x) * cos(y) * cos(z) - sin(x) * sin(y) * sin(z) s, sin(x) * cos(y) * cos(z) + cos(x) * sin(y) * sin(z) x, cos(x) * sin(y) * cos(z) - sin(x) * cos(y) * sin(z) y, cos(x) * cos(y) * sin(z) + sin(x) * sin(y) * cos(z) z from a)"""


@query(f"""with {_Q_SQL}, d as (select a.view_id a, b.view_id b, a.s * b.x - a.x * b.s - a.y * b.z + a.z * b.y x, a.s * b.y + a.x * b.z - a.y * b.s - a.z * b.x y, a.s * b.z - a.x * b.y + a.y * b.x - a.z * b.s z from q a join q b on a.view_id < b.view_id)
select a, b, round(2 * asin(least(sqrt(x * x + y * y + z * z), 1)), 6) distance from d""")
def orientation_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between the cameras (a fixed small table)."""
    q = read(spark, sf_dir, "camera").select("view_id", R.q_euler(R.to_axes(F.col("rotations"))).alias("q"))
    a, b = (q.select(F.col("view_id").alias(n), F.col("q").alias(f"q{n}")) for n in "ab")
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(R.orientation_distance(F.col("qa"), F.col("qb")), 6).alias("distance"))


@query("""with r as (select view_id, -radians(rotations[1]) a, -radians(rotations[2]) b, -radians(rotations[3]) c, cam_position[1] + cam_target[1] + pan[1] x, cam_position[2] + cam_target[2] + pan[2] y, cam_position[3] + cam_target[3] z from camera),
s as (select *, cos(a) * y - sin(a) * z y1, sin(a) * y + cos(a) * z z1 from r), t as (select *, cos(b) * x + sin(b) * z1 x2, -sin(b) * x + cos(b) * z1 z2 from s)
select view_id, round(cos(c) * x2 - sin(c) * y1, 6) x, round(sin(c) * x2 + cos(c) * y1, 6) y, round(z2, 6) z from t""")
def camera_world(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = R.camera_position(*(F.col(c) for c in ("rotations", "cam_target", "pan", "cam_position")))
    return read(spark, sf_dir, "camera").select("view_id", p.alias("p")).select("view_id", *[F.round(F.col("p")[c], 6).alias(c) for c in "xyz"])


@query(f"""with {_T_SQL}, v as (select id, coords[1] ax, coords[2] ay, coords[3] az, coords[4] bx, coords[5] "by", coords[6] bz from t),
d as (select *, ax * bx + ay * "by" + az * bz p, sqrt(ax * ax + ay * ay + az * az) la, sqrt(bx * bx + "by" * "by" + bz * bz) lb from v)
select id, round(la, 4) la, round(p, 4) dot, round(abs(ay * bz - az * "by") + abs(az * bx - ax * bz) + abs(ax * "by" - ay * bx), 4) cross_l1, round(case when la * lb > 0 then acos(greatest(least(p / (la * lb), 1), -1)) end, 6) angle from d""")
def vector3_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, dot, cross and angle of the first two coordinate triples."""
    at = lambda i: F.get("coords", F.lit(i))
    t = trajectories(spark, sf_dir).select("id", R.vec3(at(0), at(1), at(2)).alias("a"), R.vec3(at(3), at(4), at(5)).alias("b"))
    a, b = F.col("a"), F.col("b")
    c = R.cross(a, b)
    return t.select("id", F.round(R.length(a), 4).alias("la"), F.round(R.dot3(a, b), 4).alias("dot"), F.round(F.abs(c["x"]) + F.abs(c["y"]) + F.abs(c["z"]), 4).alias("cross_l1"), F.round(R.angle(a, b), 6).alias("angle"))


@query(f"""with {_T_SQL}, i as (select * from t where abs(x) <= 100 and abs(y) <= 100), n as (select clip, greatest(least(floor((x + 100.0::double) / 25.0::double), 7), 0)::int x_bin, greatest(least(floor((y + 100.0::double) / 25.0::double), 7), 0)::int y_bin, count(*) n from i group by all)
select clip, x_bin, y_bin, round(n / sum(n) over (partition by clip), 6) p from n""")
def joint_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return motion.joint_probability(trajectories(spark, sf_dir), ((-100.0, 100.0), (-100.0, 100.0)), 8, ["clip"], ["x", "y"])


#: Particles and steps of the swarm; it has a dimension for each value of the vectors.
PARTICLES, STEPS = 10, 5


def _pso_sql() -> str:
    u = lambda *k: f"((((({k[0]}) * 7919 + ({k[1]}) * 104729 + ({k[2]}) * 1299709 + ({k[3]}) * 15485863 + 32452843)::bigint % 2147483647) * 48271) % 2147483647) / 2147483647.0::double"
    out = [
        f"q as (select i - 1 d, v q from (select generate_subscripts(embedding, 1) i, unnest(embedding)::double v from embeddings where vec_id = 0))",
        f"x0 as (select p.range pid, d.range d, {u('p.range', '0', 'd.range', '0')} * 200.0::double + -100.0::double x, 0.0::double v from range({PARTICLES}) p, range(64) d)",
        "s0 as (select x0.*, x p, -corr(x, q) over (partition by pid) pc from x0 join q using (d))",
    ]
    for n in range(STEPS):
        out += [
            f"g{n} as (select d, p g from s{n} where pid = (select pid from s{n} order by pc, pid limit 1))",
            f"m{n} as (select pid, d, x + v x, v, p, pc from s{n})",
            f"c{n} as (select m{n}.*, -corr(x, q) over (partition by pid) c from m{n} join q using (d))",
            f"s{n + 1} as (select pid, d, x, greatest(least(v * 0.8::double + 1.9::double * ({u('pid', n + 1, 'd', 1)}) * (g - x) + 1.9::double * ({u('pid', n + 1, 'd', 2)}) * (p - x), 10), -10) v, case when c < pc then x else p end p, case when c < pc then c else pc end pc from c{n} join g{n} using (d))",
        ]
    return f"with {', '.join(out)} select d::int d, round(p, 3) x, round(pc, 5) cost from s{STEPS} where pid = (select pid from s{STEPS} order by pc, pid limit 1)"


@query(_pso_sql())
def pso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten particles look for the direction that correlates best with vector 0: its search score is the fitness."""
    q = vector_of(vectors(spark, sf_dir), 0)
    best, cost, _ = refine.refine(refine.start(spark, PARTICLES, len(q)), lambda x: -F.coalesce(vec.pearson(x, q), F.lit(-1.0)), STEPS)
    return spark.createDataFrame([(i, round(x, 3) + 0.0, round(cost, 5)) for i, x in enumerate(best)], "d int, x double, cost double")


@query("""select view_id, round((view_id % 5 - 2) * 0.5::double, 1) dx, round((view_id % 3 - 1) * 0.6::double, 1) dy from camera""")
def refine_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauss-Newton alignment of a drawn spot with each view's, which is shifted by a known part of a cell."""
    cells = read(spark, sf_dir, "camera").select("view_id", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(31))))
    spot = lambda cx, cy: F.exp(-((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy)) / 50.0) * 100.0
    db = cells.withColumn("v", spot(15.0 + (F.col("view_id") % 5 - 2) * 0.5, 15.0 + (F.col("view_id") % 3 - 1) * 0.6))
    sketch = spark.range(32).select(F.col("id").alias("x")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(31)))).withColumn("v", spot(F.lit(15.0), F.lit(15.0)))
    out = refine.aligned(db, sketch, ["view_id"])
    return out.select("view_id", (F.round("dx", 1) + 0.0).alias("dx"), (F.round("dy", 1) + 0.0).alias("dy"))
