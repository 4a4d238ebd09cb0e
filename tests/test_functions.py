import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionq.functions import numeric as N
from motionq.functions import rotation as R
from motionq.functions import vec
from motionq.operators import lsh


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_vectors(spark):
    r = one(spark, vec.dot([1, 2], [3, 4]), vec.l1([1, 2], [3, 5]), vec.linf([1, 2], [3, 5]), vec.l2sq([1, 2], [3, 5]), vec.argmax([1, 3, 3]))
    assert tuple(r) == (11.0, 5.0, 3.0, 13.0, 1)


def test_pearson_bounds_and_nulls(spark):
    r = one(spark, vec.pearson([1, 2, 4], [1, 2, 4]), vec.pearson([1, 2, 4], [-1, -2, -4]), vec.pearson([1, 1], [1, 2]), vec.pearson([1, 2], [1, 2, 3]), vec.pearson([], []))
    assert r[0] == pytest.approx(1) and r[1] == pytest.approx(-1) and r[2] is None and r[3] is None and r[4] is None


def test_bins(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (0.5,), (1.0,), (9.0,)], "x double")
    assert [r[0] for r in df.select(vec.bin_index(F.col("x"), 0, 1, 4)).collect()] == [0, 0, 2, 3, 3]


def test_quaternions(spark):
    v = R.vec3(0.3, -0.4, 1.2)
    q = R.axis_angle_to_q(v)
    back = R.q_to_axis_angle(q)
    turned = R.q_rotate(R.q_axis(2, F.lit(math.pi / 2)), R.vec3(1, 0, 0))
    r = one(spark, R.q_norm(q).alias("n"), back.alias("b"), turned.alias("t"), R.orientation_distance(q, q).alias("d"), R.nearest_axis_angle(R.vec3(0, 0, 0.1), R.vec3(0, 0, 6.3)).alias("w"))
    assert r.n == pytest.approx(1) and r.d == pytest.approx(0, abs=1e-7)
    assert (r.b.x, r.b.y, r.b.z) == pytest.approx((0.3, -0.4, 1.2)) and (r.t.x, r.t.y) == pytest.approx((0, 1))
    assert r.w.z == pytest.approx(0.1 + 2 * math.pi)


def test_vectors3(spark):
    a, b = R.vec3(1, 0, 0), R.vec3(0, 2, 0)
    r = one(spark, R.angle(a, b), R.signed_angle(b, a, R.vec3(0, 0, 1)), R.cross(a, b)["z"], R.mix(a, b, 0.25)["y"], R.unit(R.vec3(0, 0, 0))["x"], R.rotate_about(a, R.vec3(0, 0, 1), F.lit(math.pi))["x"])
    assert r[0] == pytest.approx(math.pi / 2) and r[1] == pytest.approx(-math.pi / 2) and r[2] == 2 and r[3] == 1.5 and r[4] is None and r[5] == pytest.approx(-1)


@pytest.mark.parametrize("kind", ["natural", "clamped", "periodic"])
def test_spline_goes_through_knots(kind):
    t = np.array([0.0, 1, 2.5, 4])
    y = np.array([0.0, 2, 1, 0])
    m = N.spline(t, y, kind)
    assert N.spline_at(t, y, m, t) == pytest.approx(y)
    d = N.spline_at(t, y, m, np.array([0.0, 4]), 1)
    if kind == "clamped":
        assert d == pytest.approx([0, 0], abs=1e-9)
    if kind == "periodic":
        assert d[0] == pytest.approx(d[1])


def test_long_spline_uses_the_same_equations():
    t = np.arange(100.0)
    y = np.sin(t)
    assert N.spline_at(t, y, N.spline(t, y), np.array([10.5])) == pytest.approx([math.sin(10.5)], abs=0.02)


def test_frames():
    m = N.transform((1, 2, 3), (0, 0, 1), 0.7)
    assert N.frame_inverse(m) @ m == pytest.approx(np.eye(4))
    assert N.matrix_inverse(np.diag([2.0, 4])) == pytest.approx(np.diag([0.5, 0.25]))
    control = np.array([[0.0, 0], [1, 2], [2, 0]])
    assert N.nurbs_point(control, np.ones(3), np.array([0, 0, 0, 1, 1, 1.0]), 2, 0.5) == pytest.approx([1, 1])


def test_planner_values():
    """Values computed from the formulas; success 0.9."""
    assert lsh.collision(4, 1) == pytest.approx(0.80053, abs=1e-5)
    assert [(lsh.tables(k, 0.9), lsh.halves(k, 0.9)) for k in (2, 4, 8, 10, 16, 20)] == [(3, 4), (5, 5), (13, 9), (21, 11), (80, 22), (196, 35)]
    p = lsh.plan(64, 10_000, [0.5, 1, 2, 5], 1.0, memory=1e6)
    assert p.count * 10_000 <= 1e6 / 12 or p.k == 2


def test_batches_score_as_columns_do(spark):
    from motionq.functions import batch, vec

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=5).round(3).tolist()) for i in range(20)] + [(20, None), (21, []), (22, [1.0]), (23, [2.0] * 5), (24, [1.0, None, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    q = [0.5, -1.0, 2.0, 0.0, 1.0]
    for kind in ("pearson", "l2sq", "l2", "l1", "linf", 3.0):
        plain = vec.pearson("v", q) if kind == "pearson" else vec.distance("v", q, kind)
        for r in df.select("id", plain.alias("a"), batch.against("v", q, kind).alias("b")).collect():
            if r.id == 23 and kind == "pearson":
                assert r.b is None
            elif r.a is None or r.id == 24:
                assert r.b is None
            else:
                assert r.b == pytest.approx(r.a, abs=1e-12)
    assert df.where("id < 0").select(batch.against("v", q).alias("s")).count() == 0
    part = df.withColumn("part", (F.col("id") % 3).cast("int")).select("id", batch.by_part("part", "v", {0: q, 1: [1.0]}, {0: 2.0, 1: 1.0}).alias("s"))
    got = {r.id: r.s for r in part.collect()}
    want = {r.id: r.s for r in df.select("id", (vec.pearson("v", q) * 2).alias("s")).collect()}
    assert all(got[i] == (pytest.approx(want[i]) if i % 3 == 0 and i < 20 else None) for i in got)


def test_matrices_and_frames(spark):
    from motionq.functions import matrix as M
    from motionq.functions import rotation as R

    one = spark.range(1)
    a, b = [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]], [[1.0, 0.5, 2.0], [0.0, 1.0, -1.0]]
    col = lambda m: F.array(*[F.lit(x) for r in m for x in r])
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(M.multiply(col(a), col(b), 2, 3)) == pytest.approx((np.array(a) @ np.array(b)).ravel().tolist())
    assert get(M.multiply(col(a), col(a), 2, 2)) is None
    assert get(M.transpose(col(a), 2)) == np.array(a).T.ravel().tolist()
    assert get(M.part(col(a), 2, 1, 2, 1, 1)) == [4.0, 6.0] and get(M.identity(2)) == [1.0, 0.0, 0.0, 1.0]
    assert get(M.outer(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(3.0), F.lit(4.0)))) == [3.0, 4.0, 6.0, 8.0]
    assert get(M.inverse(col([[2.0, 0.0], [0.0, 4.0]]), 2)) == [0.5, 0.0, 0.0, 0.25] and get(M.inverse(col([[0.0, 0.0], [0.0, 0.0]]), 2)) is None
    level = M.from_points(R.vec3(1, 1, 1), R.vec3(2, 1, 1), R.vec3(1, 3, 1))
    p = get(M.apply_point(level, R.vec3(1, 2, 3)))
    assert (p.x, p.y, p.z) == (2.0, 3.0, 4.0)
    line = get(M.from_points(R.vec3(0, 0, 0), R.vec3(1, 0, 0), R.vec3(2, 0, 0)))
    assert line[1] is None and line[15] == 1.0
    none = get(M.multiply(F.lit(None).cast("array<double>"), col(b), 2, 3))
    assert none is None


def test_splines_of_many_knots():
    from motionq.functions.numeric import spline, spline_at

    t = np.linspace(0, 2 * np.pi, 4001)
    for kind, slopes in (("natural", (0, 0)), ("clamped", (1, 1)), ("periodic", (0, 0))):
        m = spline(t, np.sin(t), kind, slopes)
        at = np.linspace(0.1, 6, 50)
        assert spline_at(t, np.sin(t), m, at) == pytest.approx(np.sin(at), abs=1e-9)
    y = np.array([0.0, 1.0, 0.0, -1.0, 0.0])
    m = spline(np.arange(5.0), y, "periodic")
    assert m[0] == m[-1] and spline_at(np.arange(5.0), y, m, np.array([0.0]), 1) == pytest.approx(spline_at(np.arange(5.0), y, m, np.array([4.0]), 1))
