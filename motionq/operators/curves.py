"""Curve features of drawn strokes and trajectories: splines, equal-arc samples, curvature."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from motionq.functions.numeric import spline, spline_at

#: Samples at equal arc length; sub-steps of a knot interval for arc length; step of version 3.
SAMPLES, FINE, TURN = 40, 32, 0.5


def _chord(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chord parameters without repeated points."""
    step = np.hypot(np.diff(x), np.diff(y))
    keep = np.concatenate([[True], step > 0])
    x, y = x[keep], y[keep]
    t = np.concatenate([[0], np.cumsum(np.hypot(np.diff(x), np.diff(y)))])
    return t / t[-1] if len(t) > 1 else t, x, y


def by_arc(x, y, samples: int = SAMPLES):
    """``(s, points, second derivatives, length)``: the curve as a spline over arc length."""
    t, x, y = _chord(np.asarray(x, float), np.asarray(y, float))
    if len(t) < 2:
        return None
    xy = np.stack([x, y], 1)
    m = spline(t, xy)
    fine = np.unique(np.concatenate([np.linspace(a, b, FINE + 1) for a, b in zip(t[:-1], t[1:], strict=True)]))
    speed = np.linalg.norm(spline_at(t, xy, m, fine, 1), axis=1)
    middle = np.linalg.norm(spline_at(t, xy, m, (fine[1:] + fine[:-1]) / 2, 1), axis=1)
    arc = np.concatenate([[0], np.cumsum((speed[:-1] + 4 * middle + speed[1:]) / 6 * np.diff(fine))])
    s = np.linspace(0, arc[-1], samples)
    points = spline_at(t, xy, m, np.interp(s, arc, fine))
    return s, points, spline(s, points), arc[-1]


def _curvature(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    down = (d1[:, 0] ** 2 + d1[:, 1] ** 2) ** 1.5
    return np.divide(d1[:, 0] * d2[:, 1] - d2[:, 0] * d1[:, 1], down, out=np.zeros(len(d1)), where=down > 0)


def feature(x, y, n: int = SAMPLES, version: int = 1) -> tuple[list[float], float]:
    """Feature and total of a curve; empty and 0 for fewer than two different points.

    1: dx, dy and curvature at ``n - 1`` equal arc steps; total is the length. 2: curvature at ``n`` equal steps of
    the integral of its absolute value; total is that integral. 3: curvature of arc length as a function of that
    integral, every TURN of it (so the length varies); total as in 2.
    """
    got = by_arc(x, y)
    if got is None:
        return [], 0.0
    s, points, m, length = got
    if version == 1:
        at = np.arange(n - 1) * length / (n - 1)
        d1, d2 = spline_at(s, points, m, at, 1), spline_at(s, points, m, at, 2)
        return np.column_stack([d1, _curvature(d1, d2)]).ravel().tolist(), float(length)
    at = np.linspace(0, length, SAMPLES * FINE + 1)
    k = _curvature(spline_at(s, points, m, at, 1), spline_at(s, points, m, at, 2))
    turn = np.concatenate([[0], np.cumsum((np.abs(k[1:]) + np.abs(k[:-1])) / 2 * np.diff(at))])
    total = float(turn[-1])
    if version == 2:
        return np.interp(np.linspace(0, total, n), turn, k).tolist(), total
    if total < 2 * TURN:
        return [], total
    axis = np.linspace(0, total, SAMPLES)
    arc = np.interp(axis, turn, at)
    m2 = spline(axis, arc)
    where = np.arange(0, total, TURN)
    d1, d2 = spline_at(axis, arc, m2, where, 1), spline_at(axis, arc, m2, where, 2)
    return (d2 / (1 + d1**2) ** 1.5).tolist(), total


def features(points: DataFrame, keys: list[str], order: str, x: str, y: str, n: int = SAMPLES, version: int = 1) -> DataFrame:
    """``(keys, feature, total)`` of each curve. A curve (stroke, or segment of a trajectory) is one group:
    cut long series into segments first. Null coordinates are skipped."""
    key_types = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([order, x, y])
        values, total = feature(pdf[x].to_numpy(), pdf[y].to_numpy(), n, version)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "feature": [values], "total": [total]})

    some = points.select(*keys, order, x, y).dropna(subset=[*keys, x, y])
    return some.groupBy(*keys).applyInPandas(work, f"{key_types}, feature array<double>, total double")
