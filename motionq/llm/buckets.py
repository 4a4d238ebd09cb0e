"""From bucket rows to candidate pairs, without ever holding a whole bucket.

Rows ``(bucket, k, f)`` are hash partitioned and sorted by bucket, then streamed. Buckets of at most
BIG keys give their pairs; the rows of larger ones come out as such, for ``block_pairs`` to spread
over tasks that each compare two blocks of at most about BLOCK keys. Buckets that a sample shows to
be crowded are large from the start: their rows are spread by key and meet no single task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionq.llm.shared import partitions

BIG, BLOCK = 128, 2048
#: Rows that one task should sort.
TASK_ROWS = 4_000_000
#: Keys of the sample that shows crowded buckets, how many of them must share one, and most such buckets.
SAMPLE_KEYS, CROWD, MOST_CROWDED = 6_000, 12, 10_000
FOUND = "bucket long, a long, b long, f int"


def _batch(bucket, a, b, f):
    n = len(a)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays(
        [none if bucket is None else pa.array(bucket), pa.array(a), none if b is None else pa.array(b), pa.nulls(n, pa.int32()) if f is None else pa.array(f)],
        names=["bucket", "a", "b", "f"],
    )


def _stream(batches, fits, big, crowded):
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)]
    over = None  # the bucket that is being passed on as large
    for batch in batches:
        new = [batch.column(i).to_numpy() for i in range(2)]
        new.append(batch.column(2).to_numpy() if batch.num_columns > 2 else np.zeros(batch.num_rows, np.int32))
        bucket, k, f = (np.concatenate(x) for x in zip(held, new, strict=True))
        if not len(k):
            continue
        fresh = np.ones(len(k), bool)
        fresh[1:] = (bucket[1:] != bucket[:-1]) | (k[1:] != k[:-1])
        bucket, k, f = bucket[fresh], k[fresh], f[fresh]
        if over is not None:
            more = np.searchsorted(bucket != over, True) if bucket[0] == over else 0
            if more:
                yield _batch(bucket[:more], k[:more], None, f[:more])
                if more == len(k):
                    held = [x[:0] for x in (bucket, k, f)]
                    continue
                bucket, k, f = bucket[more:], k[more:], f[more:]
            over = None
        last = len(k) - int((bucket[::-1] != bucket[-1]).argmax()) if (bucket != bucket[-1]).any() else 0
        if len(k) - last > big or _among(bucket[-1:], crowded)[0]:
            over = bucket[-1]
            yield _batch(bucket[last:], k[last:], None, f[last:])
            held = [x[:0] for x in (bucket, k, f)]
        else:
            held = [bucket[last:], k[last:], f[last:]]
        yield from _groups(bucket[:last], k[:last], f[:last], fits, big, crowded)
    yield from _groups(*held, fits, big, crowded)


def _among(bucket: np.ndarray, crowded: np.ndarray) -> np.ndarray:
    if not len(crowded):
        return np.zeros(len(bucket), bool)
    return crowded[np.minimum(np.searchsorted(crowded, bucket), len(crowded) - 1)] == bucket


def _groups(bucket, k, f, fits, big, crowded):
    if not len(k):
        return
    start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    size = np.diff(np.append(start, len(k)))
    spread = np.repeat(size, size)
    large = (spread > big) | _among(bucket, crowded)
    if large.any():
        yield _batch(bucket[large], k[large], None, f[large])
    small = np.flatnonzero((spread > 1) & ~large)
    for step in range(1, big):
        at = small[small + step < len(k)]
        at = at[bucket[at] == bucket[at + step]]
        if not len(at):
            break
        small = at
        at = at[fits(f[at], f[at + step])]
        if len(at):
            yield _batch(None, np.minimum(k[at], k[at + step]), np.maximum(k[at], k[at + step]), None)


def crowds(keys: DataFrame, to_rows: Callable[[DataFrame], DataFrame], total: int, big: int = BIG) -> list[int]:
    """Buckets that many of a bounded sample of ``keys(k, ...)`` fall into; ``to_rows`` gives the bucket rows of keys.

    Only where rows are sent depends on it, never which pairs are found.
    """
    share = min(1.0, SAMPLE_KEYS / max(total, 1))
    if total <= big:
        return []
    some = keys.where(F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 30)) <= int(share * (1 << 30))).dropDuplicates(["k"])
    counts = to_rows(some).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > max(CROWD, big * share))
    return sorted(r.bucket for r in counts.orderBy(F.desc("n"), "bucket").limit(MOST_CROWDED).collect())


def collide(rows: DataFrame, expected: int, fits: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, big: int = BIG, crowded: list[int] | None = None) -> DataFrame:
    """FOUND rows: pairs ``(null, a, b, null)``, ``a < b``, and rows of large buckets ``(bucket, k, null, f)``.

    ``rows`` has ``bucket``, ``k`` and may have ``f``, which ``fits`` needs: ``fits(f of one, f of other)`` may refuse pairs and must be symmetric. Pairs may repeat.
    ``crowded`` buckets (see ``crowds``) count as large whatever their size.
    """
    fits = fits or (lambda a, b: np.ones(len(a), bool))
    n = partitions(rows.sparkSession, -(-expected // TASK_ROWS))
    rows = rows.select("bucket", "k", *[c for c in rows.columns if c == "f"])
    place = F.when(F.col("bucket").isin(crowded), F.xxhash64("bucket", "k")).otherwise(F.col("bucket")) if crowded else F.col("bucket")
    known = np.array(crowded or [], np.int64)
    return rows.repartition(n, place).sortWithinPartitions("bucket", "k").mapInArrow(lambda it: _stream(it, fits, big, known), FOUND)


def block_pairs(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of large buckets once for every pair of blocks ``i <= j`` they are in, with own block ``o``.

    ``rows`` has ``bucket`` and ``k``, and what else is to travel. Group the result by
    ``bucket, i, j`` to compare all pairs of a bucket, each in exactly one task (within block
    ``i`` only where ``i = j``).
    """
    count = rows.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    out = rows.join(count, "bucket").withColumn("o", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    out = out.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return out.withColumns({"i": F.least("o", "x"), "j": F.greatest("o", "x")}).drop("x", "blocks")


def across(o: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the two sides of a block pair."""
    return np.flatnonzero(o == i), np.flatnonzero(o == j)
