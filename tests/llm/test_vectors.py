"""Nearest vectors and clusters against brute force, with nulls, fillers, ties, repeats and hot cells."""

import numpy as np
import pytest

from motionq.llm import cells, clusters, knn, quota
from motionq.llm.queries import QUERIES
from motionq.llm.shared import components, merge_labels

SCHEMA = "id long, dimension int, coords array<double>, clip string, cell int, role string, bound double"


def points(spark):
    rng = np.random.default_rng(5)
    rows = []
    centres = rng.uniform(-80, 80, (6, 8))
    for i in range(240):
        c = centres[0] if i % 3 == 0 else centres[i % 6]
        rows.append((i, 8, np.round(c + rng.normal(0, 1.6, 8), 2).tolist()))
    rows += [(300 + i, 8, np.round(rng.uniform(-90, 90, 8), 2).tolist()) for i in range(40)]
    rows += [(400 + i, 5, np.round(rng.normal(0, 2, 5), 2).tolist()) for i in range(30)]
    rows += [(500, 8, rows[0][2]), (501, 8, rows[0][2]), (7, 8, rows[7][2]), (7, 8, rows[7][2])]
    rows += [(600, 8, None), (601, 8, []), (602, 8, [1.0] * 8), (603, 9, [1.0, 2.0]), (604, 8, [1.0] * 7 + [None]), (605, None, [1.0, 2.0]), (None, 8, rows[0][2]), (606, 2, [float("nan"), 1.0])]
    rows += [(700, 2, [10737417.25, 1.123456789]), (701, 2, [10737417.25, 3.5])]
    return spark.createDataFrame([(*r, "x", 1, "y", 0.5) for r in rows], SCHEMA), rows


def brute(rows, radius):
    seen = {}
    for i, d, c in rows:
        if i is None or c is None or d != len(c) or not c or any(v is None or v != v for v in c) or len(set(c)) == 1:
            continue
        seen[i] = np.array(c)
    ids = sorted(seen)
    near = {}
    for a in ids:
        for b in ids:
            if a != b and len(seen[a]) == len(seen[b]):
                d = round(float(np.sqrt(((seen[a] - seen[b]) ** 2).sum())), 6)
                if d <= radius:
                    near.setdefault(a, []).append((d, b))
    return ids, near


SIZES = [{}, {"cell_rows": 40}, {"cell_rows": 40, "hot_rows": 20}, {"cell_rows": 20, "hot_rows": 60, "most": 2}, {"cell_rows": 8, "hot_rows": 12, "most": 3}]


@pytest.mark.parametrize("sizes", SIZES)
def test_nearest(spark, sizes):
    df, rows = points(spark)
    _, near = brute(rows, 6.0)
    want = set()
    for a, l in near.items():
        l.sort()
        last = l[min(4, len(l) - 1)][0]
        want |= {(min(a, b), max(a, b)) for d, b in l if d <= last}
    got = [tuple(r) for r in knn.pairs(knn.nearest(df, **sizes)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("sizes", [*SIZES, {"cell_rows": 40, "hot_rows": 20, "ask_rows": 15}, {"cell_rows": 8, "hot_rows": 12, "most": 3, "ask_rows": 15}])
def test_nearest_however_far(spark, sizes):
    df, rows = points(spark)
    ids, near = brute(rows, float("inf"))
    want = set()
    for a, l in near.items():
        l.sort()
        last = l[min(4, len(l) - 1)][0]
        want |= {(a, b, d) for d, b in l if d <= last}
    assert {a for a, _, _ in want} == set(ids) and max(d for _, _, d in want) > 6.0
    got = [tuple(r) for r in knn.nearest_all(df, **sizes).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert "p5_nearest" in QUERIES


@pytest.mark.parametrize("sizes", SIZES)
def test_clusters(spark, sizes):
    df, rows = points(spark)
    ids, near = brute(rows, 6.0)
    at = {i: n for n, i in enumerate(ids)}
    a, b = np.array([(at[x], at[y]) for x, l in near.items() for _, y in l]).T
    label = merge_labels(np.arange(len(ids)), a, b)
    size = np.bincount(label, minlength=len(ids))
    want = {(i, ids[label[n]], len(near.get(i, []))) for n, i in enumerate(ids) if size[label[n]] >= 5}
    found = clusters.clusters(df, with_degree=True, **sizes)
    assert {tuple(r) for r in found.collect()} == want
    for r in clusters.described(found).collect():
        mine = sorted(((-d, i) for i, c, d in want if c == r.cluster_id))
        assert r["size"] == len(mine) and r.medoids == [i for _, i in mine[:3]] and r.links == -sum(d for d, _ in mine) // 2


def test_loose_members_get_other_medoids(spark):
    chain = [(i, 2, [i * 5.0, 1.0]) for i in range(12)]
    df = spark.createDataFrame(chain, "id long, dimension int, coords array<double>")
    found = clusters.clusters(df, with_degree=True)
    assert {r.cluster_id for r in found.collect()} == {0}
    degree = {r.id: r.degree for r in found.collect()}
    want, open_ = {}, sorted(degree, key=lambda i: (-degree[i], i))
    while open_:
        near = [i for i in open_ if abs(i - open_[0]) * 5 <= 12]
        want |= {i: open_[0] for i in near}
        open_ = [i for i in open_ if i not in near]
    for candidates in (512, 1, 3):
        assert {r.id: r.medoid for r in clusters.split_loose(df, found, candidates=candidates).collect()} == want
    assert clusters.split_loose(df, found.limit(0)).count() == 0


def test_empty(spark):
    df, _ = points(spark)
    empty = df.where("id < -5")
    assert knn.nearest(empty).count() == 0 and clusters.clusters(empty).count() == 0 and quota.varied(empty, 3).count() == 0


def test_clusters_of_many_lone_records():
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(0, 1.2, (300, 8)), rng.normal(3, 4, (500, 8)), rng.uniform(-12, 12, (700, 8))]).round(2)
    a, b = np.nonzero(np.round(np.sqrt(cells.squared(x, x)), 6) <= 6.0)
    want = merge_labels(np.arange(len(x)), a, b)
    assert (clusters.local_components(x, 6.0, bands=10) == want).all()
    for radius in (2.0, 3.5):
        a, b = np.nonzero(np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), 6) <= radius)
        assert (clusters.local_components(x, radius, bands=10) == merge_labels(np.arange(len(x)), a, b)).all()


def test_closest_of_extreme_values():
    rng = np.random.default_rng(3)
    y = rng.normal(0, 5, (60, 6)).round(2)
    y[7], y[8], y[9] = 1.07e7, 1e25, y[3]
    x, ids, names = np.concatenate([y[:12], [[2e25] * 6]]), np.arange(13), np.arange(60)
    names[50] = 4
    for limit in (np.inf, 8.0):
        i, j, d = knn.closest(x, ids, y, names, np.full(len(x), limit**2), 3)
        got = {(int(a), int(names[b]), round(float(c), 5)) for a, b, c in zip(i, j, d, strict=True)}
        for a in range(13):
            far = sorted((round(float(np.sqrt(((x[a] - y[b]) ** 2).sum())), 6), b) for b in range(60) if names[b] != ids[a])
            want = {(a, int(names[b]), round(e, 5)) for e, b in far if e <= max(far[2][0], 0) and e <= limit}
            mine = {g for g in got if g[0] == a and g[2] <= limit}
            assert mine == want or a in (8, 12)


def test_packing_is_exact():
    x = np.array([[1.25, -3.5], [1e7 + 0.25, 2.0], [0.1234567, 1.0], [1e300, -1e300]])
    enc, packed = cells.pack(x)
    import pyarrow as pa

    assert enc.tolist() == [2, 4, 8, 8] and (cells.unpack(enc, pa.array(packed, pa.binary()), 2) == x).all()


def test_components_over_rounds(spark):
    rng = np.random.default_rng(2)
    edges = rng.integers(0, 400, (300, 2)).tolist() + [[i, i + 1] for i in range(500, 560)] + [[3, 3]]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in edges], "a long, b long")
    e = np.array([x for x in edges if x[0] != x[1]])
    label = merge_labels(np.arange(600), e[:, 0], e[:, 1])
    want = {(i, label[i]) for i in set(e.ravel().tolist())}
    for small in (10_000, 20):
        assert {tuple(r) for r in components(df, small).collect()} == want
    assert components(df.where("a < 0")).count() == 0


def test_flow_is_optimal_on_small_cases():
    from itertools import product

    first, second = np.array([0, 0, 1, 1]), np.array([0, 1, 0, 1])
    room = np.array([3, 1, 2, 2])
    a, b = np.bincount(first, room).astype(int), np.bincount(second, room).astype(int)
    for total in (1, 3, 4, 7, 8, 20):
        want_a, want_b, even = quota.targets(a, min(total, 8)), quota.targets(b, min(total, 8)), quota.targets(room, min(total, 8))

        def price(n, spans):
            out = 0
            for take, cost in spans:
                out, n = out + min(n, take) * cost, n - min(n, take)
            return out

        def cost(take, a=a, b=b, wa=want_a, wb=want_b, even=even, total=total):
            take = np.array(take)
            out = 0
            for index, size, want, cover in ((first, a, wa, quota.COVER), (second, b, wb, 0)):
                used = np.bincount(index, take, minlength=2).astype(int)
                for i in range(2):
                    spans = quota.steps(int(want[i]), int(min(size[i], total)), cover, cover >> int(size[i]).bit_length())
                    out += price(used[i], [(t, p * 16) for t, p in spans])
            return out + sum(price(t, quota.steps(int(e), int(r))) for t, e, r in zip(take, even, room, strict=True))

        got = quota.solve(first, second, room, total)
        best = min(cost(t) for t in product(*(range(r + 1) for r in room)) if sum(t) == min(total, 8))
        assert got.sum() == min(total, 8) and (got <= room).all() and cost(got) == best


def test_varied_subset(spark):
    df, rows = points(spark)
    ids, _ = brute(rows, 6.0)
    some = quota.varied(df, 30)
    got = [r.id for r in some.collect()]
    assert len(got) == len(set(got)) == 30 and set(got) <= set(ids)
    assert sorted(got) == sorted(r.id for r in quota.varied(df, 30).collect())
    crowded = {i for i in ids if i < 240 and i % 3 == 0}
    assert len(crowded & set(got)) < 12
    assert {r.id for r in quota.varied(df, 10_000).collect()} == set(ids)


@pytest.mark.parametrize("nodes", [512, 4])
def test_varied_subset_covers_what_a_sample_misses(spark, nodes):
    rng = np.random.default_rng(8)
    crowd = [(i, 6, np.round(rng.normal(0, 1, 6), 2).tolist()) for i in range(1500)]
    sparse = [np.round(rng.uniform(-900, 900, 6), 2) for _ in range(60)]
    twos = [(2000 + 2 * n + m, 6, (c + m).tolist()) for n, c in enumerate(sparse) for m in (0, 1)]
    df = spark.createDataFrame(crowd + twos, "id long, dimension int, coords array<double>")
    got = [r.id for r in quota.varied(df, 100, nodes=nodes, sample_rows=150).collect()]
    assert len(got) == len(set(got)) == 100
    assert {(i - 2000) // 2 for i in got if i >= 2000} == set(range(60))
