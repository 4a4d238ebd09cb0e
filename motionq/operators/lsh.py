"""Locality-sensitive hashing for radius search, with its cost planner; bucket tables are DataFrames."""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionq.functions import vec
from motionq.operators import skew

#: Bucket width, in units of the radius.
WIDTH = 4.0


def collision(w: float, c: float) -> float:
    """Chance that one hash of width ``w`` agrees on two points at distance ``c``."""
    if c <= 0:
        return 1.0
    x = w / c
    return math.erf(x / math.sqrt(2)) - math.sqrt(2 / math.pi) / x * (1 - math.exp(-x * x / 2))


def tables(k: int, success: float, width: float = WIDTH) -> int:
    """Independent tables of ``k`` hashes needed to find a point at the radius with chance ``success``."""
    return math.ceil(math.log(1 - success) / math.log(1 - collision(width, 1) ** k))


def halves(k: int, success: float, width: float = WIDTH) -> int:
    """Half-keys of ``k / 2`` hashes needed when every two of them make a table."""
    if k % 2:
        raise ValueError("k must be even")
    miss, m = 1 - collision(width, 1) ** (k / 2), 2
    while miss ** (m - 1) * (1 + m * (1 - miss)) > 1 - success:
        m += 1
    return m


def expected_collisions(distances, k: int, n: int, paired: bool, radius: float, width: float = WIDTH) -> tuple[float, float]:
    """Expected bucket hits, and distinct points hit, of a query at the given distances; ``n``: tables, or half-keys."""
    hits = distinct = 0.0
    for d in distances:
        p = collision(width, d / radius)
        count = n * (n - 1) // 2 if paired else n
        hits += count * p**k
        if paired:
            mu = 1 - p ** (k / 2)
            distinct += 1 - mu ** (n - 1) * (mu + n * (1 - mu))
        else:
            distinct += 1 - (1 - p**k) ** n
    return hits, distinct


@dataclass(frozen=True)
class Plan:
    dim: int
    radius: float
    success: float
    k: int
    m: int
    width: float = WIDTH
    seed: int = 7
    norm: int = 2

    @property
    def count(self) -> int:
        return self.m * (self.m - 1) // 2


def plan(dim: int, points: int, distances, radius: float, success: float = 0.9, memory: float = 1e9, costs=(1.0, 1.0, 1.0), width: float = WIDTH, seed: int = 7) -> Plan:
    """The even ``k`` of least estimated time whose tables fit: ``tables * points <= memory / 12``.

    ``distances``: from sample queries to sample points; ``costs``: of a hash of one dimension, a bucket hit, and a
    distance of one dimension (``measured_costs``, or relative ones for a plan that doesn't depend on the machine).
    """
    best = None
    for k in range(2, 41, 2):
        m = halves(k, success, width)
        if k > 2 and m * (m - 1) // 2 * points > memory / 12:
            break
        hits, distinct = expected_collisions(distances, k, m, True, radius, width)
        scale = points / max(len(distances), 1)
        time = costs[0] * m * k / 2 * dim + costs[1] * hits * scale + costs[2] * distinct * scale * dim
        if best is None or time < best[0]:
            best = time, k, m
    return Plan(dim, radius, success, best[1], best[2], width, seed)


def sample_distances(df: DataFrame, key: str, vector: str, queries: int = 100, points: int = 1000, seed: int = 7) -> list[float]:
    """Distances between bounded samples of queries and of points, drawn by a mix of the (whole number) key."""
    mixed = lambda n: F.pmod(F.col(key).cast("long") * 7919 + n, F.lit(104_729))
    drawn = [df.orderBy(mixed(n), key).limit(rows).select(vec.col(vector).alias("v")).collect() for n, rows in ((seed, queries), (seed + 1, points))]
    sides = [[np.array(r.v, float) for r in d if r.v is not None and None not in r.v] for d in drawn]
    out: list[float] = []
    for q in sides[0]:
        same = np.array([p for p in sides[1] if len(p) == len(q)])
        if len(same):
            out += [d for d in np.round(np.sqrt(((same - q) ** 2).sum(1)), 6).tolist() if d]
    return out


def measured_costs(dim: int, repeats: int = 200_000, seed: int = 0) -> tuple[float, float, float]:
    """Seconds of a hash of one dimension, of a bucket hit, and of a distance of one dimension, timed here in numpy."""
    rng = np.random.default_rng(seed)
    x, a = rng.normal(size=(max(1, repeats // dim), dim)), rng.normal(size=dim)
    buckets = rng.integers(0, 1000, repeats)

    def timed(work) -> float:
        best = math.inf
        for _ in range(3):
            began = time.perf_counter()
            work()
            best = min(best, time.perf_counter() - began)
        return best

    hash_ = timed(lambda: np.floor((x @ a + 0.5) / WIDTH)) / x.size
    hit = timed(lambda: np.unique(buckets)) / repeats
    distance = timed(lambda: np.sqrt(((x - a) ** 2).sum(1))) / x.size
    return hash_, hit, distance


def functions(p: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Directions ``(m, k / 2, dim)``, Gaussian for norm 2 and Cauchy for norm 1, and offsets ``(m, k / 2)``; seeded."""
    rng = np.random.default_rng(p.seed)
    draw = rng.normal if p.norm == 2 else lambda size: rng.standard_cauchy(size)
    return draw(size=(p.m, p.k // 2, p.dim)), rng.uniform(0, p.width, (p.m, p.k // 2))


def half_keys(df: DataFrame, p: Plan, key: str, vector: str) -> DataFrame:
    """``(key, u)``: for each half-key the array of its hashes ``floor((a . v / radius + b) / width)``."""
    a, b = functions(p)
    v = vec.col(vector)
    us = [F.array(*[F.floor((vec.dot(v, a[i, j].tolist()) / F.lit(p.radius) + F.lit(float(b[i, j]))) / F.lit(p.width)) for j in range(p.k // 2)]) for i in range(p.m)]
    return df.where(v.isNotNull() & (F.size(v) == p.dim)).select(key, F.array(*us).alias("u"))


def bucket_table(df: DataFrame, p: Plan, key: str, vector: str) -> DataFrame:
    """``(table_id, bucket, key)``: one row for each point and pair ``i < j`` of half-keys.

    ``bucket`` is the pair of hash arrays itself, so unlike a hashed key it never mixes buckets. New points are
    appended by the same call on them alone.
    """
    pairs = F.array(*[F.struct(F.lit(t).alias("table_id"), F.concat(F.col("u")[i], F.col("u")[j]).alias("bucket")) for t, (i, j) in enumerate((i, j) for i in range(p.m) for j in range(i + 1, p.m))])
    return half_keys(df, p, key, vector).select(key, F.explode(pairs).alias("t")).select("t.table_id", "t.bucket", key)


def near(df: DataFrame, queries: DataFrame, p: Plan, key: str, vector: str) -> DataFrame:
    """``(query, key, distance)``: points that share a bucket with a query and lie within the radius.

    Candidates are made distinct before any distance is computed; the distance is exact. A subset of the exact
    result, each of its rows being found with chance ``p.success`` at least. A row is not its own neighbour.
    Buckets that a sample shows to be crowded are spread over tasks.
    """
    q = bucket_table(queries, p, key, vector).withColumnRenamed(key, "query")
    index, at = bucket_table(df, p, key, vector), ["table_id", "bucket"]
    hot = skew.hot_keys(index, at, [key], df.count())
    pairs = skew.join(index, q, at, [key], hot).where(F.col("query") != F.col(key)).select("query", key).distinct()
    left = queries.select(F.col(key).alias("query"), vec.col(vector).alias("q"))
    d = pairs.join(left, "query").join(df.select(key, vec.col(vector).alias("p")), key)
    return d.select("query", F.col(key).alias("key"), F.round(vec.distance("q", "p", "l2" if p.norm == 2 else "l1"), 6).alias("distance")).where(F.col("distance") <= p.radius)


def radius_classes(nearest: DataFrame, bounds: list[float], distance: str = "distance") -> DataFrame:
    """``(class, n, least, greatest)``: queries by the first bound their nearest distance is within (one class beyond)."""
    c = F.lit(len(bounds))
    for i, b in reversed(list(enumerate(bounds))):
        c = F.when(F.col(distance) <= b, i).otherwise(c)
    return nearest.groupBy(c.alias("class")).agg(F.count("*").alias("n"), F.min(distance).alias("least"), F.max(distance).alias("greatest"))


def degraded(df: DataFrame, key: str, vector: str, share: float, seed: int = 3) -> DataFrame:
    """Copies of vectors with about ``share`` of their values set to 0, by a mix of (whole number) key and position."""
    gone = lambda i: (F.col(key).cast("long") * 7919 + i * 104_729 + seed * 15_485_863) % 1009 * 48_271 % 1009 < int(share * 1009)
    return df.withColumn(vector, F.transform(vec.col(vector), lambda x, i: F.when(gone(i), 0.0).otherwise(x)))


def statistics(index: DataFrame) -> DataFrame:
    """``(table_id, rows, buckets, largest)`` of a bucket table."""
    sizes = index.groupBy("table_id", "bucket").agg(F.count("*").alias("n"))
    return sizes.groupBy("table_id").agg(F.sum("n").alias("rows"), F.count("*").alias("buckets"), F.max("n").alias("largest"))
