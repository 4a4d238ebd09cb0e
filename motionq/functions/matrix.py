"""Column functions on small row-major matrices (``array<double>``) and 4 x 4 frames. Null arrays give null."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from motionq.functions import rotation as R
from motionq.functions.numeric import matrix_inverse


def _at(m: Column, i) -> Column:
    return F.get(m, i if isinstance(i, Column) else F.lit(i))


def identity(n: int) -> Column:
    return F.array(*[F.lit(1.0 if i % (n + 1) == 0 else 0.0) for i in range(n * n)])


def multiply(a: Column, b: Column, inner: int, cols: int) -> Column:
    """``a`` (any rows x inner) times ``b`` (inner x cols); null if the sizes don't fit."""
    cell = lambda t: F.aggregate(F.sequence(F.lit(0), F.lit(inner - 1)), F.lit(0.0), lambda s, l: s + _at(a, F.floor(t / cols).cast("int") * inner + l) * _at(b, l * cols + t % cols))
    rows = F.floor(F.size(a) / inner).cast("int")
    fits = (F.size(a) % inner == 0) & (F.size(b) == inner * cols)
    return F.when(fits, F.transform(F.sequence(F.lit(0), rows * cols - 1), cell))


def transpose(m: Column, cols: int) -> Column:
    rows = F.floor(F.size(m) / cols).cast("int")
    return F.transform(F.sequence(F.lit(0), F.size(m) - 1), lambda t: _at(m, t % rows * cols + F.floor(t / rows).cast("int")))


def plus(a: Column, b: Column, weight: float = 1.0) -> Column:
    """``a + weight * b``; null elements where the sizes differ."""
    return F.zip_with(a, b, lambda x, y: x + y * F.lit(weight))


def outer(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: x * y)))


def part(m: Column, cols: int, r0: int, r1: int, c0: int, c1: int) -> Column:
    """Rows ``r0`` to ``r1`` and columns ``c0`` to ``c1``, ends included."""
    return F.flatten(F.transform(F.sequence(F.lit(r0), F.lit(r1)), lambda r: F.slice(m, r * cols + c0 + 1, F.lit(c1 - c0 + 1))))


def inverse(m: Column, rows: int, damping: float = 0.0) -> Column:
    """Inverse of a square matrix, or with ``damping`` the damped pseudo-inverse; null where there is none."""

    @F.pandas_udf("array<double>")
    def inverted(column: pd.Series) -> pd.Series:
        out = []
        for v in column:
            try:
                out.append(None if v is None else matrix_inverse(np.reshape(v, (rows, -1)), damping).ravel())
            except (np.linalg.LinAlgError, ValueError):
                out.append(None)
        return pd.Series(out, index=column.index, dtype=object)

    return inverted(m)


def frame(turn: Column, origin: Column) -> Column:
    """The 4 x 4 frame of a 3 x 3 rotation and the position of its origin (a vector)."""
    rows = [[_at(turn, 3 * i + j) for j in range(3)] + [origin[c]] for i, c in enumerate("xyz")]
    return F.array(*[x for r in rows for x in r], *[F.lit(float(i == 3)) for i in range(4)])


def from_vectors(x: Column, y: Column, z: Column, origin: Column) -> Column:
    """The frame whose axes are the given vectors."""
    return frame(F.array(*[v[c] for c in "xyz" for v in (x, y, z)]), origin)


def from_points(origin: Column, ahead: Column, side: Column) -> Column:
    """The right-handed frame at ``origin`` whose x axis points ``ahead`` and whose z axis is normal to the plane of the three points.

    Null elements where they lie on a line.
    """
    x = R.unit(R.sub(ahead, origin))
    return R.let(x, lambda a: R.let(R.unit(R.cross(a, R.sub(side, origin))), lambda c: from_vectors(a, R.cross(c, a), c, origin)))


def frame_inverse(m: Column) -> Column:
    """Inverse of a rigid frame: transposed rotation, turned back origin."""
    back = [-sum((_at(m, 4 * k + i) * _at(m, 4 * k + 3) for k in range(3)), F.lit(0.0)) for i in range(3)]
    return F.array(*[c for i in range(3) for c in (*[_at(m, 4 * k + i) for k in range(3)], back[i])], *[F.lit(float(i == 3)) for i in range(4)])


def apply_point(m: Column, v: Column) -> Column:
    return R.vec3(*[_at(m, 4 * i) * v["x"] + _at(m, 4 * i + 1) * v["y"] + _at(m, 4 * i + 2) * v["z"] + _at(m, 4 * i + 3) for i in range(3)])


def apply_vector(m: Column, v: Column) -> Column:
    """Turned, but not moved."""
    return R.vec3(*[_at(m, 4 * i) * v["x"] + _at(m, 4 * i + 1) * v["y"] + _at(m, 4 * i + 2) * v["z"] for i in range(3)])
