"""All similar pairs of sets, by an extended-prefix join with adaptive prefix lengths.

Tokens are ordered rarest first. If the overlap of two sets is at least ``o``, their prefixes of
``size - o + l`` tokens share at least ``l`` tokens (Wang, Li and Feng 2012). So the sets are joined
on all combinations of ``l`` tokens of such prefixes. ``l`` is chosen for each size of the smaller
set by estimated cost: a longer prefix makes more combinations, but far fewer candidates. Candidates
are verified exactly. Equal sets are one class throughout and are expanded only in the result.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionq.llm import buckets
from motionq.llm.shared import list_parts, partitions, table

#: A token with less than 1 / HEAVY of all occurrences counts as rare; there are at most HEAVY others.
HEAVY = 200_000
#: Classes on whose prefixes the cost of each prefix length is estimated.
SAMPLE = 2_000
#: Shared tokens that may be asked for, and cost of a candidate in units of a combination row.
LENGTHS, CANDIDATE = (1, 2, 3), 0.5
#: Combinations that one set may make at most for its own size.
MOST = 20_000
#: Combinations made at once, and how often the sets of crowded combinations are joined again on longer ones.
BATCH_KEYS, ROUNDS = 1_000_000, 2


def as_sets(df: DataFrame, key: str, values: str = "h", empty: int | None = -1) -> DataFrame:
    """``(id, s)``: the sorted distinct values without nulls and ``empty``; rows without values are left out."""
    keep = (lambda v: v.isNotNull()) if empty is None else (lambda v: v.isNotNull() & (v != empty))
    s = F.array_sort(F.array_distinct(F.filter(values, keep)))
    return df.select(F.col(key).cast("long").alias("id"), s.alias("s")).where("id is not null and size(s) > 0")


def need(size: int, threshold: float, smaller: bool) -> int:
    """Least overlap of a set of ``size`` with a partner not smaller (``smaller``) or not larger than it."""
    share = 2 * threshold / (1 + threshold) if smaller else threshold
    return max(1, ceil(share * size - 1e-9))


def prefix(size: int, length: int, threshold: float, smaller: bool) -> int:
    """Tokens of the prefix; 0 if no partner can share ``length``. A larger set may have to give all its tokens."""
    o = need(size, threshold, smaller)
    return 0 if length > (o if smaller else size) else min(size, size - o + length)


class Order:
    """The global token order: heavy tokens by their count, after all rare ones, which go by hash."""

    def __init__(self, heavy: pa.Table):
        values, counts = heavy.column("v").to_numpy(), heavy.column("n").to_numpy()
        order = np.argsort(values)
        self.values, self.counts = values[order], counts[order]

    def count(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.zeros(tokens.shape, np.int64)
        at = np.minimum(np.searchsorted(self.values, tokens), len(self.values) - 1)
        return np.where(self.values[at] == tokens, self.counts[at], 0)

    def sort(self, tokens: np.ndarray) -> np.ndarray:
        """Rows of ``tokens``, rarest first."""
        mixed = (tokens.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        order = np.lexsort((mixed, self.count(tokens)), axis=1)
        return np.take_along_axis(tokens, order, 1)


def _matrices(column):
    starts, sizes, flat, _ = list_parts(column)
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, flat[starts[rows][:, None] + np.arange(size)]


def choose(sample: pa.Table, order: Order, classes: int, threshold: float) -> dict[int, int]:
    """The number of shared prefix tokens to ask for, by size of the smaller set.

    Cost of ``l``: combination rows plus expected candidates, tokens taken as independent.
    Sizes that the sample lacks take the length of the nearest size below that has one, else 1.
    """
    chosen: dict[int, int] = {}
    for size, _, x in _matrices(sample.column("s")):
        x = order.sort(x)
        f = np.maximum(order.count(x), 1) / classes
        best = None
        for length in LENGTHS:
            p, q = prefix(size, length, threshold, True), prefix(size, length, threshold, False)
            if not p:
                continue
            e = np.zeros((length + 1, len(x)))
            e[0] = 1
            for j in range(q):  # elementary symmetric sums: expected share of classes with a given combination
                for l in range(length, 0, -1):
                    e[l] += e[l - 1] * f[:, j]
            cost = comb(q, length) + CANDIDATE * classes * e[length].mean()
            if best is None or cost < best[0]:
                best = cost, length
        chosen[size] = best[1]
    return chosen


def _length(size: int, chosen: dict[int, int], threshold: float) -> int:
    below = [s for s in chosen if s <= size]
    length = min(chosen[max(below)] if below else 1, need(size, threshold, True))
    while length > 1 and comb(prefix(size, length, threshold, False), length) > MOST:
        length -= 1  # a large set that the sample lacked
    return length


def _combinations(batches, order: Order, chosen: dict[int, int], threshold: float):
    for batch in batches:
        k = batch.column("k").to_numpy()
        for size, rows, x in _matrices(batch.column("s")):
            x = order.sort(x).astype(np.int64).astype(np.uint64)
            own = _length(size, chosen, threshold)
            smallest = max(1, ceil(threshold * size - 1e-9))
            for length in sorted({_length(s, chosen, threshold) for s in range(smallest, size + 1)}):
                q = prefix(size, length, threshold, False)
                p = prefix(size, length, threshold, True) if length == own else 0
                if not q:  # no partner of a size that asks for so many
                    continue
                picks = np.array(list(combinations(range(q), length)))
                index = (picks < p).all(1).astype(np.int32)
                step = max(1, BATCH_KEYS // len(picks))
                for at in range(0, len(rows), step):
                    some = x[at : at + step]
                    key = np.full((len(some), len(picks)), length, np.uint64)
                    for l in range(length):
                        key = key * np.uint64(0x9E3779B97F4A7C15) + some[:, picks[:, l]]
                        key ^= key >> np.uint64(29)
                        key *= np.uint64(0xBF58476D1CE4E5B9)
                    flag = np.broadcast_to(size * 2 + index, key.shape)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(key.view(np.int64).ravel()), pa.array(np.repeat(k[rows[at : at + step]], len(picks))), pa.array(flag.ravel().astype(np.int32))],
                        names=["bucket", "k", "f"],
                    )


def _fits(threshold: float):
    def fits(f, g):
        small, large = np.minimum(f >> 1, g >> 1), np.maximum(f >> 1, g >> 1)
        asks = np.where(f >> 1 == g >> 1, (f | g) & 1, np.where(f >> 1 < g >> 1, f & 1, g & 1))
        return (asks == 1) & (small >= threshold * large - 1e-9)

    return fits


def _in_blocks(t: pa.Table, threshold: float) -> pa.Table:
    """Similar pairs of one block pair of a large bucket, compared as a token incidence matrix."""
    t = t.combine_chunks()
    left, right = buckets.across(t.column("o").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py())
    k, f = t.column("k").to_numpy(), t.column("f").to_numpy()
    starts, sizes, flat, _ = list_parts(t.column("s"))
    _, code = np.unique(flat, return_inverse=True)
    fits, out = _fits(threshold), []
    width = int(code.max()) + 1

    def incidence(rows):
        m = np.zeros((len(rows), width), np.float32)
        for i, r in enumerate(rows):
            m[i, code[starts[r] : starts[r] + sizes[r]]] = 1
        return m

    for a in np.array_split(left, max(1, len(left) * width // 8_000_000)):
        for b in np.array_split(right, max(1, len(right) * width // 8_000_000)):
            both = incidence(a) @ incidence(b).T
            ok = both >= threshold * (sizes[a][:, None] + sizes[b][None] - both) - 1e-6
            p, q = np.nonzero(ok & (k[a][:, None] != k[b][None]))
            p, q = a[p], b[q]
            use = fits(f[p], f[q])
            out.append(np.stack([np.minimum(k[p], k[q]), np.maximum(k[p], k[q])], 1)[use])
    out = np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), np.int64)
    return pa.table({"a": out[:, 0], "b": out[:, 1]})


def class_pairs(classes: DataFrame, threshold: float, big: int = buckets.BIG, block: int = buckets.BLOCK, lengths: dict[int, int] | None = None, rounds: int = ROUNDS) -> DataFrame:
    """``(a, b)``, ``a < b``: keys of different sets of ``classes(c, s)`` with Jaccard similarity >= threshold.

    Sets that share a combination with more than ``big`` others are joined again among themselves, asking for one more
    shared token, up to ``rounds`` times; only what is crowded even then is compared in pairs of blocks.
    """
    total = classes.select(F.sum(F.size("s")).alias("n"), F.count("*").alias("c")).first()
    if not total.c:
        return classes.select(F.col("c").alias("a"), F.col("c").alias("b")).limit(0)
    counts = classes.select(F.explode("s").alias("v")).groupBy("v").agg(F.count("*").alias("n"))
    order = Order(counts.where(F.col("n") >= total.n / HEAVY).toArrow())  # at most HEAVY rows
    chosen = lengths or choose(classes.orderBy(F.xxhash64("c")).limit(SAMPLE).toArrow(), order, total.c, threshold)
    found = _meeting(classes, order, chosen, threshold, total.c, big)
    similar = [_checked(found, classes, threshold)]
    large = found.where("bucket is not null").select("bucket", F.col("a").alias("k"), "f")
    while large.head(1) and rounds:
        crowded = table(classes.join(large.select(F.col("k").alias("c")).distinct(), "c", "left_semi"))
        longer = {size: length + 1 for size, length in chosen.items()}
        sizes = [r.n for r in crowded.select(F.size("s").alias("n")).distinct().collect()]  # distinct sizes only
        if all(_length(n, longer, threshold) == _length(n, chosen, threshold) for n in sizes):
            break  # no longer combinations
        chosen, rounds = longer, rounds - 1
        found = _meeting(crowded, order, chosen, threshold, crowded.count(), big)
        similar.append(_checked(found, crowded, threshold))
        large = found.where("bucket is not null").select("bucket", F.col("a").alias("k"), "f")
    if large.head(1):
        large = large.join(classes.select(F.col("c").alias("k"), "s"), "k")
        blocks = buckets.block_pairs(large, block)
        blocks = blocks.repartition(partitions(classes.sparkSession, -(-large.count() // block)), "bucket", "i", "j")
        similar.append(blocks.groupBy("bucket", "i", "j").applyInArrow(lambda t: _in_blocks(t, threshold), "a long, b long"))
    out = similar[0]
    for more in similar[1:]:
        out = out.unionByName(more)
    return out if len(similar) == 1 else out.distinct()


def _meeting(classes: DataFrame, order: Order, chosen: dict[int, int], threshold: float, total: int, big: int) -> DataFrame:
    combined = lambda df: df.mapInArrow(lambda it: _combinations(it, order, chosen, threshold), "bucket long, k long, f int")
    keyed = classes.select(F.col("c").alias("k"), "s")
    return table(buckets.collide(combined(keyed), total * 60, _fits(threshold), big, buckets.crowds(keyed, combined, total, big)))


def _checked(found: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The similar ones of the candidate pairs."""
    pairs = table(found.where("bucket is null").select("a", "b").distinct())
    both = F.size(F.array_intersect("x", "y"))
    checked = pairs.join(classes.select(F.col("c").alias("a"), F.col("s").alias("x")), "a").join(classes.select(F.col("c").alias("b"), F.col("s").alias("y")), "b")
    return checked.where(both >= threshold * (F.size("x") + F.size("y") - both) - 1e-9).select("a", "b")


def similar_pairs(sets: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``(id_a, id_b)``, ``id_a < id_b``: all pairs of ``sets(id, s)`` with Jaccard similarity >= threshold.

    Repeated rows of an id count once (an id with several sets has the pairs of each, but none with
    itself). Equal sets are similar; empty or null sets have no pairs. For two tables, pass their
    union (ids must differ).
    """
    members, classes = classed(sets)
    across = class_pairs(classes, threshold, **options)
    one, two = members.select(F.col("c").alias("a"), F.col("id").alias("p")), members.select(F.col("c").alias("b"), F.col("id").alias("q"))
    different = across.join(one, "a").join(two, "b").where("p <> q").select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))
    equal = one.join(two.withColumnRenamed("b", "a"), "a").where("p < q").select(F.col("p").alias("id_a"), F.col("q").alias("id_b"))
    return different.unionByName(equal).distinct()


def classed(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members(id, c)`` and ``classes(c, s)``: equal sets under their smallest id."""
    sets = table(sets.distinct())
    classes = table(sets.groupBy("s").agg(F.min("id").alias("c")).select("c", "s"))
    members = sets.withColumn("h", F.xxhash64("s")).join(classes.withColumn("h", F.xxhash64("s")).withColumnRenamed("s", "t"), "h").where("s = t")
    return table(members.select("id", "c")), classes
