"""Numpy helpers: small matrices, frames, splines, rational curves."""

from __future__ import annotations

import math

import numpy as np


def matrix_inverse(m: np.ndarray, damping: float = 0.0) -> np.ndarray:
    """Inverse, or with ``damping`` the damped pseudo-inverse ``m' (m m' + damping^2 I)^-1``."""
    m = np.asarray(m, float)
    if not damping:
        return np.linalg.inv(m)
    return m.T @ np.linalg.inv(m @ m.T + damping**2 * np.eye(len(m)))


def transform(translation=(0, 0, 0), axis=(0, 0, 1), angle: float = 0.0) -> np.ndarray:
    """4x4 frame: turn by ``angle`` about ``axis``, then move by ``translation``."""
    x, y, z = np.asarray(axis, float) / np.linalg.norm(axis)
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    out = np.eye(4)
    out[:3, :3] += math.sin(angle) * k + (1 - math.cos(angle)) * (k @ k)
    out[:3, 3] = translation
    return out


def frame_inverse(m: np.ndarray) -> np.ndarray:
    """Inverse of a rigid frame: transposed rotation, turned back translation."""
    out = np.eye(4)
    out[:3, :3] = m[:3, :3].T
    out[:3, 3] = -m[:3, :3].T @ m[:3, 3]
    return out


def spline(t: np.ndarray, y: np.ndarray, kind: str = "natural", slopes: tuple[float, float] = (0.0, 0.0)) -> np.ndarray:
    """Second derivatives at the knots of the cubic spline through ``(t, y)``; ``y`` may have columns.

    ``kind``: natural, clamped (end slopes given) or periodic (``y[0]`` is taken for ``y[-1]``).
    One or two knots give straight lines.
    """
    y = np.asarray(y, float)
    n = len(t)
    if n < 3 and kind != "clamped" or n < 2:
        return np.zeros_like(y)
    h = np.diff(t)
    rise = np.diff(y, axis=0) / h.reshape((-1,) + (1,) * (y.ndim - 1))
    if kind == "periodic":
        m = _cyclic(np.roll(h, 1), 2 * (np.roll(h, 1) + h), h, 6 * (rise - np.roll(rise, 1, axis=0)))
        return np.concatenate([m, m[:1]])
    low, mid, up, rhs = np.zeros(n), np.ones(n), np.zeros(n), np.zeros_like(y)
    low[1:-1], mid[1:-1], up[1:-1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
    rhs[1:-1] = 6 * np.diff(rise, axis=0)
    if kind == "clamped":
        mid[0], up[0], low[-1], mid[-1] = 2 * h[0], h[0], h[-1], 2 * h[-1]
        rhs[0], rhs[-1] = 6 * (rise[0] - slopes[0]), 6 * (slopes[1] - rise[-1])
    elif kind != "natural":
        raise ValueError(kind)
    return _thomas(low, mid, up, rhs)


def _thomas(low: np.ndarray, mid: np.ndarray, up: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solution of a tridiagonal system given by its diagonals (``low[0]`` and ``up[-1]`` don't count)."""
    mid, x = mid.astype(float), np.array(rhs, float)
    for i in range(1, len(mid)):
        w = low[i] / mid[i - 1]
        mid[i] -= w * up[i - 1]
        x[i] -= w * x[i - 1]
    x[-1] /= mid[-1]
    for i in range(len(mid) - 2, -1, -1):
        x[i] = (x[i] - up[i] * x[i + 1]) / mid[i]
    return x


def _cyclic(low: np.ndarray, mid: np.ndarray, up: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """As ``_thomas``, where ``low[0]`` joins the first row with the last and ``up[-1]`` the last with the first."""
    n = len(mid)
    if n < 3:
        a = np.diag(mid.astype(float))
        for i in range(n):
            a[i, i - 1] += low[i]
            a[i, (i + 1) % n] += up[i]
        return np.linalg.solve(a, rhs)
    g = -mid[0]
    inner = mid.astype(float)
    inner[0] -= g
    inner[-1] -= up[-1] * low[0] / g
    u = np.zeros(n)
    u[0], u[-1] = g, up[-1]
    x, z = _thomas(low, inner, up, rhs), _thomas(low, inner, up, u)
    ratio = (x[0] + low[0] / g * x[-1]) / (1 + z[0] + low[0] / g * z[-1])
    return x - z.reshape((-1,) + (1,) * (x.ndim - 1)) * ratio


def spline_at(t: np.ndarray, y: np.ndarray, m: np.ndarray, at: np.ndarray, order: int = 0) -> np.ndarray:
    """Value (order 0) or derivative of the spline with second derivatives ``m``; clamped to the ends."""
    y = np.asarray(y, float)
    at = np.clip(at, t[0], t[-1])
    if len(t) == 1:
        return np.repeat(y[:1], len(at), 0) if order == 0 else np.zeros((len(at), *y.shape[1:]))
    k = np.clip(np.searchsorted(t, at, side="right") - 1, 0, len(t) - 2)
    shape = (-1,) + (1,) * (y.ndim - 1)
    h, a = (t[k + 1] - t[k]).reshape(shape), (t[k + 1] - at).reshape(shape)
    b = (at - t[k]).reshape(shape)
    if order == 0:
        return (m[k] * a**3 + m[k + 1] * b**3) / (6 * h) + (y[k] / h - m[k] * h / 6) * a + (y[k + 1] / h - m[k + 1] * h / 6) * b
    if order == 1:
        return (m[k + 1] * b**2 - m[k] * a**2) / (2 * h) + (y[k + 1] - y[k]) / h - (m[k + 1] - m[k]) * h / 6
    return (m[k] * a + m[k + 1] * b) / h


def nurbs_point(control: np.ndarray, weights: np.ndarray, knots: np.ndarray, degree: int, u: float) -> np.ndarray:
    """Point of a rational B-spline curve (Cox-de Boor)."""
    n = len(control)
    if u >= knots[-degree - 1]:
        span = n - 1
    else:
        span = int(np.searchsorted(knots, u, side="right") - 1)
    basis = np.zeros(n + degree + 1)
    basis[span] = 1
    for p in range(1, degree + 1):
        for i in range(n):
            left, right = knots[i + p] - knots[i], knots[i + p + 1] - knots[i + 1]
            basis[i] = ((u - knots[i]) / left * basis[i] if left else 0) + ((knots[i + p + 1] - u) / right * basis[i + 1] if right else 0)
    w = basis[:n] * weights
    return (w[:, None] * control).sum(0) / w.sum()
