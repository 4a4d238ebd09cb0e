"""Connected components and Arrow/numpy helpers shared by the operators here."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionq.tables import dropped, partitions, shared_dir, table

__all__ = ["components", "dropped", "list_parts", "merge_labels", "partitions", "rows_of", "shared_dir", "table"]

# ---------------------------------------------------------------- connected components


def merge_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the groups of ``a[i]`` and ``b[i]``; ``labels[x]`` is a root, smallest wins."""
    labels = labels.copy()
    while len(a):
        la, lb = labels[a], labels[b]
        differ = la != lb
        if not differ.any():
            break
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            further = labels[labels]
            if np.array_equal(further, labels):
                break
            labels = further
    return labels


def _finish(batches):
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    a, b = t.column("a").to_numpy(), t.column("b").to_numpy()
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    labels = merge_labels(np.arange(len(ids)), at[: len(a)], at[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[labels])], names=["id", "root"])


def components(edges: DataFrame, small: int = 2_000_000) -> DataFrame:
    """``(id, root)`` of every end of ``edges(a, b)``; ``root`` is the smallest id of the component.

    While there are more than ``small`` edges, rounds of local contraction in DataFrame
    operations: every vertex goes to its neighbour of lowest hash, edges are renamed and made
    distinct. The checked, bounded rest (16 bytes an edge) is finished in one task.
    Loops and repeated edges do no harm; no edges give no rows.
    """
    edges = table(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    levels: list[DataFrame] = []
    while edges.count() > small:
        seed = len(levels)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        own = F.struct(F.xxhash64("a", F.lit(seed)).alias("h"), F.col("a").alias("v"))
        other = F.struct(F.xxhash64("b", F.lit(seed)).alias("h"), F.col("b").alias("v"))
        hook = table(both.groupBy("a").agg(F.least(F.min(own), F.min(other)).alias("m")).select("a", F.col("m.v").alias("to")))
        levels.append(hook)
        left = hook.select("a", F.col("to").alias("ta"))
        right = hook.select(F.col("a").alias("b"), F.col("to").alias("tb"))
        before, edges = edges, table(
            edges.join(left, "a").join(right, "b").where("ta <> tb")
            .select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        )
        dropped(before)
    found = edges.repartition(1).mapInArrow(_finish, "id long, root long")
    if not levels:
        return found
    for hook in reversed(levels):
        up = hook.select(F.col("a").alias("id"), "to").join(found.select(F.col("id").alias("to"), "root"), "to", "left")
        before, found = found, table(up.select("id", F.coalesce("root", "to").alias("root")))
        dropped(before, hook)
    least = found.groupBy("root").agg(F.min("id").alias("least"))
    return found.join(least, "root").select("id", F.col("least").alias("root"))


# ---------------------------------------------------------------- Arrow lists


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, lengths (0 where null), values (nulls as NaN) and the per-row count of null values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values
    gaps = values.is_null().to_numpy(zero_copy_only=False) if values.null_count else None
    flat = values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    if gaps is None:
        missing = np.zeros(len(lengths), np.int64)
    else:
        total = np.concatenate([[0], np.cumsum(gaps)])
        missing = total[offsets[1:]] - total[offsets[:-1]]
    if column.null_count:
        lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    return offsets[:-1], lengths, flat, missing


def rows_of(flat: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The rows ``flat[start : start + width]`` as a matrix."""
    return flat[starts[:, None] + np.arange(width)]
