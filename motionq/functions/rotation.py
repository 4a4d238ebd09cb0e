"""Column functions on 3-vectors ``struct<x,y,z>``, quaternions ``struct<s,x,y,z>``, axis angles and 4x4 frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY, SMALL = 1.0e-16, 1.0e-4


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once: nested calls stay as small as they are written."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def vec3(x, y, z) -> Column:
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(as_col(x).alias("x"), as_col(y).alias("y"), as_col(z).alias("z"))


def from_array(a: Column) -> Column:
    return vec3(F.get(a, F.lit(0)), F.get(a, F.lit(1)), F.get(a, F.lit(2)))


def add(a: Column, b: Column) -> Column:
    return vec3(a["x"] + b["x"], a["y"] + b["y"], a["z"] + b["z"])


def sub(a: Column, b: Column) -> Column:
    return vec3(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def scale(a: Column, k) -> Column:
    return vec3(a["x"] * k, a["y"] * k, a["z"] * k)


def dot3(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return vec3(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def length(a: Column) -> Column:
    return F.sqrt(dot3(a, a))


def unit(a: Column) -> Column:
    """The vector over its length; null components where the length is 0."""
    n = length(a)
    return vec3(F.try_divide(a["x"], n), F.try_divide(a["y"], n), F.try_divide(a["z"], n))


def angle(a: Column, b: Column) -> Column:
    """Angle in [0, pi]; null if either is 0."""
    c = F.try_divide(dot3(a, b), length(a) * length(b))
    return F.acos(F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))


def project(a: Column, onto: Column) -> Column:
    return scale(onto, F.try_divide(dot3(a, onto), dot3(onto, onto)))


def signed_angle(a: Column, b: Column, axis: Column) -> Column:
    """Angle from ``a`` to ``b``, negative where ``a x b`` points against ``axis``."""
    return F.when(dot3(cross(a, b), axis) < 0, -angle(a, b)).otherwise(angle(a, b))


def rotate_about(v: Column, axis: Column, theta: Column) -> Column:
    """``v`` turned by ``theta`` about the unit ``axis`` (Rodrigues)."""
    c, s = F.cos(theta), F.sin(theta)
    return add(add(scale(v, c), scale(cross(axis, v), s)), scale(axis, dot3(axis, v) * (F.lit(1.0) - c)))


def mix(a: Column, b: Column, weight_a) -> Column:
    """``weight_a * a + (1 - weight_a) * b``: the weight belongs to the first."""
    w = weight_a if isinstance(weight_a, Column) else F.lit(float(weight_a))
    return add(scale(a, w), scale(b, F.lit(1.0) - w))


def quat(s, x, y, z) -> Column:
    as_col = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(as_col(s).alias("s"), as_col(x).alias("x"), as_col(y).alias("y"), as_col(z).alias("z"))


def q_mul(a: Column, b: Column) -> Column:
    return quat(
        a["s"] * b["s"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
        a["s"] * b["x"] + a["x"] * b["s"] + a["y"] * b["z"] - a["z"] * b["y"],
        a["s"] * b["y"] - a["x"] * b["z"] + a["y"] * b["s"] + a["z"] * b["x"],
        a["s"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["s"],
    )


def q_conj(a: Column) -> Column:
    return quat(a["s"], -a["x"], -a["y"], -a["z"])


def q_dot(a: Column, b: Column) -> Column:
    return a["s"] * b["s"] + a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def q_norm(a: Column) -> Column:
    return F.sqrt(q_dot(a, a))


def q_inverse(a: Column) -> Column:
    n = q_dot(a, a)
    c = q_conj(a)
    return quat(F.try_divide(c["s"], n), F.try_divide(c["x"], n), F.try_divide(c["y"], n), F.try_divide(c["z"], n))


def q_lerp(a: Column, b: Column, t) -> Column:
    """Normalised linear interpolation, the shorter way round."""
    w = t if isinstance(t, Column) else F.lit(float(t))
    sign = F.when(q_dot(a, b) < 0, -1.0).otherwise(1.0)
    return let(quat(*[a[k] * (F.lit(1.0) - w) + b[k] * w * sign for k in ("s", "x", "y", "z")]), _normal)


def _normal(q: Column) -> Column:
    return quat(*[F.try_divide(q[k], q_norm(q)) for k in ("s", "x", "y", "z")])


def q_rotate(q: Column, v: Column) -> Column:
    turn = lambda q: let(q_mul(q, quat(0.0, v["x"], v["y"], v["z"])), lambda p: q_mul(p, q_conj(q)))
    return let(let(q, turn), lambda p: vec3(p["x"], p["y"], p["z"]))


def q_axis(axis: int, theta: Column) -> Column:
    """Turn by ``theta`` about coordinate axis 0, 1 or 2."""
    h = theta / F.lit(2.0)
    return quat(F.cos(h), *[F.sin(h) if i == axis else 0.0 for i in range(3)])


def q_euler(angles: Column, order: str = "xyz") -> Column:
    """Rotation about the named axes in turn (the first is applied last), angles in radians by axis name."""
    out = None
    for name in order:
        q = q_axis("xyz".index(name), angles[name])
        out = q if out is None else q_mul(out, q)
    return out


def q_to_matrix(q: Column) -> Column:
    """Row-major 3x3 array."""
    s, x, y, z = (q[k] for k in ("s", "x", "y", "z"))
    one, two = F.lit(1.0), F.lit(2.0)
    return F.array(
        one - two * (y * y + z * z), two * (x * y - s * z), two * (x * z + s * y),
        two * (x * y + s * z), one - two * (x * x + z * z), two * (y * z - s * x),
        two * (x * z - s * y), two * (y * z + s * x), one - two * (x * x + y * y),
    )


def orientation_distance(a: Column, b: Column) -> Column:
    """``2 asin(min(|v(conj(a) b)|, 1))``."""
    half = lambda d: F.asin(F.least(F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"]), F.lit(1.0)))
    return F.lit(2.0) * let(let(a, lambda x: let(b, lambda y: q_mul(q_conj(x), y))), half)


def q_decompose(q: Column, axis: Column) -> tuple[Column, Column]:
    """``(swing, twist)`` with ``q = swing * twist``, the twist turning about the unit ``axis``; null for half turns across it."""
    along = lambda q: q["x"] * axis["x"] + q["y"] * axis["y"] + q["z"] * axis["z"]
    twist = let(q, lambda q: let(along(q), lambda d: _normal(quat(q["s"], axis["x"] * d, axis["y"] * d, axis["z"] * d))))
    return let(q, lambda q: let(twist, lambda t: q_mul(q, q_conj(t)))), twist


def q_log(q: Column) -> Column:
    """Half of the axis angle of a unit quaternion."""
    return scale(q_to_axis_angle(q), F.lit(0.5))


def q_exp(v: Column) -> Column:
    """The unit quaternion whose ``q_log`` is ``v``."""
    return axis_angle_to_q(scale(v, F.lit(2.0)))


def orthogonal(v: Column) -> tuple[Column, Column]:
    """Two unit vectors that make a right-handed system with the unit vector ``v``."""
    side = F.when(F.abs(v["x"]) < 0.9, vec3(1, 0, 0)).otherwise(vec3(0, 1, 0))
    first = let(side, lambda s: unit(cross(v, s)))
    return first, let(first, lambda f: cross(v, f))


def axis_angle_to_q(v: Column) -> Column:
    def turned(v: Column) -> Column:
        theta = length(v)
        k = F.when(theta < SMALL, F.lit(0.5) - theta * theta / F.lit(48.0)).otherwise(F.try_divide(F.sin(theta / F.lit(2.0)), theta))
        return quat(F.cos(theta / F.lit(2.0)), v["x"] * k, v["y"] * k, v["z"] * k)

    return let(let(v, turned), _normal)


def q_to_axis_angle(q: Column) -> Column:
    def scaled(q: Column) -> Column:
        theta = F.lit(2.0) * F.acos(F.greatest(F.least(q["s"], F.lit(1.0)), F.lit(-1.0)))
        n = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
        k = F.when(n < TINY, F.lit(0.0)).otherwise(F.try_divide(theta, n))
        return vec3(q["x"] * k, q["y"] * k, q["z"] * k)

    return let(q, scaled)


def nearest_axis_angle(v: Column, ref: Column) -> Column:
    """The equivalent of ``v`` (whole turns added along its axis) that is closest to ``ref``."""
    whole = F.lit(2.0 * 3.141592653589793)

    def near(v: Column, ref: Column) -> Column:
        along = F.when(length(v) < TINY, unit(ref)).otherwise(unit(v))
        return let(along, lambda a: add(v, scale(a, F.round(dot3(a, sub(ref, v)) / whole) * whole)))

    return let(v, lambda x: let(ref, lambda y: near(x, y)))


def to_axes(rotations: Column) -> Column:
    """``array<double>`` of degrees as ``struct<x,y,z>`` of radians."""
    r = lambda i: F.radians(F.get(rotations, F.lit(i)))
    return vec3(r(0), r(1), r(2))


def camera_position(rotations: Column, target: Column, pan: Column, position: Column) -> Column:
    """Position in model space: shift by target and pan, then turn back about x, y and z (degrees)."""
    r = to_axes(rotations)
    at = lambda a, i: F.get(a, F.lit(i))
    x = at(position, 0) + at(target, 0) + at(pan, 0)
    y = at(position, 1) + at(target, 1) + at(pan, 1)
    z = at(position, 2) + at(target, 2)
    cx, sx, cy, sy, cz, sz = (f(-r[a]) for a in "xyz" for f in (F.cos, F.sin))
    y, z = cx * y - sx * z, sx * y + cx * z
    x, z = cy * x + sy * z, -sy * x + cy * z
    x, y = cz * x - sz * y, sz * x + cz * y
    return vec3(x, y, z)
