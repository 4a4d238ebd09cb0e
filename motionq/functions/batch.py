"""Scores of a column of vectors against given vectors, one matrix product for each Arrow batch.

The same results as the Columns of ``vec``, several times faster where one side is known; only the vectors travel.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from motionq.functions import vec


def rows_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and matrix of the rows that have ``width`` values, none of them null."""
    offsets, values = column.offsets.to_numpy(), column.values
    good = np.diff(offsets) == width
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    if values.null_count:
        gaps = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
        good &= gaps[offsets[1:]] == gaps[offsets[:-1]]
    rows = np.flatnonzero(good)
    flat = np.asarray(values.to_numpy(zero_copy_only=False), float)
    return rows, flat[offsets[rows][:, None] + np.arange(width)]


def measured(x: np.ndarray, q: np.ndarray, kind: str | float) -> np.ndarray:
    """Scores of the rows of ``x``; NaN where a correlation is not defined."""
    if kind == "pearson":
        if not len(q) or q.min() == q.max():
            return np.full(len(x), np.nan)
        y, z = q - q.mean(), x - x.mean(1, keepdims=True)
        with np.errstate(invalid="ignore", divide="ignore"):
            out = (z @ y) / np.sqrt((z * z).sum(1) * (y * y).sum())
        return np.where(x.min(1) == x.max(1), np.nan, out)
    d = x - q
    if kind in ("l2sq", "l2"):
        d2 = np.einsum("ij,ij->i", d, d)
        return d2 if kind == "l2sq" else np.sqrt(d2)
    if kind == "l1":
        return np.abs(d).sum(1)
    return np.abs(d).max(1) if kind == "linf" else (np.abs(d) ** kind).sum(1) ** (1 / kind)


def against(vector: vec.Vec, query: Sequence[float], kind: str | float = "pearson") -> Column:
    """``vec.pearson``, or ``vec.distance`` by the norm ``kind``, with a known vector; null as there."""
    q = np.array(query, float)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out, none = np.zeros(len(column)), np.ones(len(column), bool)
        rows, x = rows_of(column, len(q))
        if len(rows) and len(q):
            out[rows] = measured(x, q, kind)
            none[rows] = np.isnan(out[rows]) if kind == "pearson" else False
        return pa.array(out, mask=none)

    return score(F.col(vector) if isinstance(vector, str) else vector)


def by_part(part: str, vector: str, queries: Mapping[int, Sequence[float]], weights: Mapping[int, float] | None = None) -> Column:
    """Correlation of each row with the query of its ``part``, times the weight of that part; null without either."""
    known = {int(p): np.array(q, float) for p, q in queries.items()}

    @F.arrow_udf("double")
    def score(parts: pa.Array, column: pa.Array) -> pa.Array:
        out, none = np.zeros(len(column)), np.ones(len(column), bool)
        at = parts.fill_null(-1).to_numpy(zero_copy_only=False)
        for p, q in known.items():
            mine = np.flatnonzero(at == p)
            if len(mine) and len(q):
                rows, x = rows_of(column.take(pa.array(mine)), len(q))
                found = measured(x, q, "pearson")
                out[mine[rows]] = found * (weights[p] if weights else 1.0)
                none[mine[rows]] = np.isnan(found)
        return pa.array(out, mask=none)

    return score(F.col(part), F.col(vector))


def filled(places: Column, values: Column, size: int) -> Column:
    """Arrays of ``size`` with ``values`` at the given 0-based ``places`` (of each row, equally many), and 0 elsewhere."""

    @F.arrow_udf("array<double>")
    def fill(at: pa.Array, v: pa.Array) -> pa.Array:
        out = np.zeros((len(at), size))
        offsets = at.offsets.to_numpy()
        row = np.repeat(np.arange(len(at)), np.diff(offsets))
        out[row, at.flatten().to_numpy()] = v.flatten().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * size), pa.array(out.ravel()))

    return fill(places, values)
