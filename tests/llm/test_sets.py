"""Near duplicates and set joins against brute force."""

from collections import Counter

import numpy as np
import pytest

from motionq.llm import bbit, prefixjoin


def records(seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    base = [np.round(rng.uniform(-90, 90, 30), 2) for _ in range(12)]
    for i in range(200):
        x = base[0 if i % 3 == 0 else i % 12].copy()
        for j in rng.choice(30, rng.integers(0, 5), replace=False):
            x[j] = round(float(rng.uniform(-90, 90)), 2)
        x = rng.permutation(x).tolist()
        if i % 7 == 0:
            x.insert(3, None)
        if i % 11 == 0:
            x = x[:-2] + [0.0, -0.0, 0.0]
        rows.append((i, x))
    rows += [(900, rows[5][1]), (901, rows[5][1]), (4, rows[4][1]), (902, None), (903, []), (904, [1.0] * 9), (905, [None, None]), (906, [None, 2.0]), (907, [1.0, 2.0]), (908, [2.0, 1.0]), (None, rows[1][1])]
    return rows


def groups(rows, threshold=0.8):
    sets = {}
    for i, v in rows:
        v = [x + 0.0 for x in v or [] if x is not None]
        if i is not None and len(set(v)) > 1:
            sets[i] = Counter(v)
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b:
                n = sum((sets[a] & sets[b]).values())
                if n >= threshold * (sum(sets[a].values()) + sum(sets[b].values()) - n) - 1e-9:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    size = Counter(find(i) for i in sets)
    return {(i, find(i)) for i in sets if size[find(i)] > 1}


@pytest.mark.parametrize(("big", "block"), [(128, 2048), (4, 8)])
def test_near_duplicates(spark, big, block):
    rows = records()
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "id long, coords array<double>, k int, bucket string")
    got = [tuple(r) for r in bbit.near_duplicates(df, big=big, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == groups(rows)


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "id long, coords array<double>")
    assert bbit.near_duplicates(df).count() == 0 and bbit.near_duplicates(df.limit(0)).count() == 0


def test_estimate_is_corrected_for_chance():
    rng = np.random.default_rng(0)
    for j in (0.2, 0.5, 0.8):
        n = 60
        shared = round(2 * n * j / (1 + j))
        x = rng.integers(0, 2**32, (2 * n - shared, 400), dtype=np.uint32)
        s = bbit.signature(bbit.minima(x[:n]))
        t = bbit.signature(bbit.minima(x[n - shared :]))
        m = bbit.matching(s[0], s[1], t[0], t[1])
        assert bbit.estimate(m).mean() == pytest.approx(shared / (2 * n - shared), abs=0.03)


def sketches(seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(250):
        n = int(rng.integers(1, 12))
        h = (rng.zipf(1.5, n) % 60).tolist()
        if i % 4 == 1:
            h = list(rows[-1][1] or [])
            if h:
                h[0] = int(rng.integers(0, 60))
        if i % 9 == 0:
            h += [-1, None]
        rows.append((i, h))
    rows += [(500, None), (501, []), (502, [-1, -1]), (503, [None]), (504, [7, 7, 7]), (505, [7]), (3, rows[3][1]), (None, [7]), (506, list(range(100))), (507, list(range(5, 100)))]
    return rows


@pytest.mark.parametrize("threshold", [0.7, 0.9])
@pytest.mark.parametrize("options", [{}, {"big": 3, "block": 4}, {"lengths": {1: 3}}, {"lengths": {1: 1, 6: 2, 9: 3}}])
def test_similar_pairs(spark, threshold, options):
    rows = sketches()
    sets = {i: {x for x in h or [] if x is not None and x != -1} for i, h in rows if i is not None}
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}
    df = spark.createDataFrame([(*r, 1) for r in rows], "sketch_id long, h array<int>, c int")
    half = df.where("sketch_id % 2 = 0 or sketch_id is null"), df.where("sketch_id % 2 = 1")
    union = prefixjoin.as_sets(half[0], "sketch_id").unionByName(prefixjoin.as_sets(half[1], "sketch_id"))
    got = [tuple(r) for r in prefixjoin.similar_pairs(union, threshold, **options).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_crowded_buckets_are_spread(spark):
    from pyspark.sql import functions as F

    from motionq.llm import buckets

    keys = spark.range(3000).select(F.col("id").alias("k"))
    to_rows = lambda df: df.select(F.when(F.col("k") < 1000, 7).otherwise(F.col("k") * 10).cast("long").alias("bucket"), "k")
    rows = to_rows(keys).unionByName(to_rows(keys.where("k between 2000 and 2001")).withColumn("bucket", F.lit(5).cast("long")))
    crowded = buckets.crowds(keys, to_rows, 3000)
    assert crowded == [7]
    found = buckets.collide(rows.unionByName(rows.limit(50)), 3000, crowded=crowded)
    assert found.where("bucket = 7").select("a").distinct().count() == found.where("bucket is not null").count() == 1000
    assert [tuple(r) for r in found.where("bucket is null").select("a", "b").collect()] == [(2000, 2001)]
    spread = found.where("bucket = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 4 and max(r["count"] for r in spread) < 400


def test_large_sets_make_bounded_combinations():
    from math import comb

    for size in (30, 500, 20_000):
        length = prefixjoin._length(size, {10: 3}, 0.7)
        assert length == 1 or comb(prefixjoin.prefix(size, length, 0.7, False), length) <= prefixjoin.MOST


def test_no_sets(spark):
    df = spark.createDataFrame([(1, None), (2, [-1])], "sketch_id long, h array<int>")
    assert prefixjoin.similar_pairs(prefixjoin.as_sets(df, "sketch_id")).count() == 0


def test_longer_prefixes_where_tokens_are_frequent():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    sample = pa.table({"s": [rng.choice(400, 20, replace=False).tolist() for _ in range(300)]})
    for count, length in ((3, 1), (60_000, 2)):
        order = prefixjoin.Order(pa.table({"v": np.arange(400), "n": np.full(400, count)}))
        assert prefixjoin.choose(sample, order, 1_000_000, 0.7)[20] >= length
