import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionq.operators import curves, hierarchy, histograms, lsh, minhash, motion, refine, search, series


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_search_ties_and_bad_vectors(spark):
    db = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [2.0, 1.0]), (4, None), (5, [1.0]), (6, [1.0, 1.0])], "id long, v array<double>")
    got = [tuple(r) for r in search.correlate(db, [1.0, 3.0], "id", "v").collect()]
    assert got == [(2, 1.0), (1, 1.0), (3, -1.0)]
    near = [tuple(r) for r in search.nearest(db, [1.0, 2.0], "id", "v", 2).collect()]
    assert near == [(1, 0.0), (6, 1.0)]


def test_radius_search_blocks(spark):
    rng = np.random.default_rng(0)
    x = rng.random((60, 3))
    x[7] = x[3]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "id long, v array<double>")
    q = df.where("id < 10")
    got = search.radius_search(df, q, 0.4, 3, "id", "v", block_rows=7).collect()
    d = np.round(np.sqrt(((x[:10, None] - x[None]) ** 2).sum(2)), 6)
    for i in range(10):
        near = sorted((d[i, j], j) for j in range(60) if j != i and d[i, j] <= 0.4)
        mine = sorted((r.distance, r.key, r.within) for r in got if r.query == i)
        assert [(a, b) for a, b, _ in mine] == near[:3] and all(w == len(near) for *_, w in mine)
    counts = search.radius_search(df, q, 0.4, 0, "id", "v", block_rows=100).collect()
    assert all(r.within == sum(d[r.query, j] <= 0.4 for j in range(60) if j != r.query) for r in counts)


@pytest.mark.parametrize("radius", [0.35, float("inf")])
def test_radius_search_visits_cells_and_minds_lengths(spark, radius):
    rng = np.random.default_rng(4)
    base = rng.uniform(-3, 3, (6, 3))
    x = {i: np.round(base[0 if i % 3 == 0 else i % 6] + rng.normal(0, 0.1, 3), 2) for i in range(200)}
    x |= {i: np.round(rng.random(2), 2) for i in range(200, 230)}
    x[7], x[201] = x[3], x[200]
    rows_ = [(i, v.tolist(), "x", 1) for i, v in x.items()] + [(300, None, "y", 2), (301, [], "y", 2), (302, [1.0], "z", 3), (None, [1.0], "z", 3), (5, x[5].tolist(), "again", 1)]
    df = spark.createDataFrame(rows_, "id long, v array<double>, role string, cell int")
    q = df.where("id % 5 = 0 and role <> 'again'")
    got = search.radius_search(df, q, radius, 4, "id", "v", block_rows=16, cell_rows=20).collect()
    counted = {r.query: r.within for r in search.radius_search(df, q, radius, 0, "id", "v", block_rows=16, cell_rows=20).collect()}
    for i in (i for i in x if i % 5 == 0):
        d = sorted((round(float(np.sqrt(((x[i] - v) ** 2).sum())), 6), j) for j, v in x.items() if j != i and len(v) == len(x[i]))
        near = [(e, j) for e, j in d if e <= radius]
        extra = [(e, j) for e, j in near if j == 5]
        near = sorted(near + extra)
        mine = sorted((r["rank"], r.distance, r.key) for r in got if r.query == i)
        assert [(e, j) for _, e, j in mine] == near[:4]
        assert counted[i] == len(near) and all(r.within == len(near) for r in got if r.query == i)


def test_recall_by_label_is_recall_by_pairs(spark):
    rng = np.random.default_rng(1)
    db = spark.createDataFrame([(i, int(rng.integers(0, 3)) if i != 4 else None) for i in range(30)] + [(99, 77)], "id long, label int")
    q = db.where("id % 4 = 0 or id = 99")
    ranked = spark.createDataFrame([(int(i), int(j), n + 1) for i in range(0, 30, 4) for n, j in enumerate(rng.permutation([x for x in range(30) if x != i])[:12])], "query long, key long, rank int")
    relevant = q.select(F.col("id").alias("query"), "label").join(db.select(F.col("id").alias("key"), "label"), "label").where("query <> key").select("query", "key")
    assert rows(search.recall_by_label(ranked, q, db, "id", "label", 10)) == rows(search.recall_and_rank(ranked, relevant, 10))


def test_hot_keys_are_spread(spark):
    from motionq.operators import skew

    r = spark.range(4000).select(F.when(F.col("id") < 3000, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("x"))
    a = spark.createDataFrame([(1, "a"), (3500, "b"), (9, "c")], "k long, name string")
    hot = skew.hot_keys(r, ["k"], ["x"], 4000)
    assert len(hot) == 1
    out = skew.join(r, a, ["k"], ["x"], hot, 4)
    assert sorted(out.columns) == ["k", "name", "x"] and rows(out.groupBy("name").count()) == [("a", 3000), ("b", 1)]
    assert skew.hot_keys(r.limit(0), ["k"], ["x"], 0) == []


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert search.correlate(empty, [1.0], "id", "v").count() == 0
    assert search.radius_search(empty, empty, 1.0, 3, "id", "v").count() == 0


def test_fused_and_patches(spark):
    db = spark.createDataFrame([(1, 0, [1.0, 2.0]), (1, 1, [1.0, 2.0]), (2, 0, [2.0, 1.0]), (3, 5, None)], "img_id long, patch int, hist array<double>")
    assert rows(search.fused(db, {0: [0.0, 1.0], 1: [0.0, 1.0]}, {0: 1.0, 1: 0.5}, "img_id", "patch", "hist")) == [(1, 1.5), (2, -1.0), (3, 0.0)]
    sketch = spark.createDataFrame([(0, [0.0, 1.0]), (5, [0.0, 1.0])], "patch int, hist array<double>")
    assert rows(search.patch_search(db, sketch)) == [(1, 1.0), (2, -1.0), (3, 0.0)]


def test_hierarchy(spark):
    u = spark.createDataFrame([("a", None, 0, 9), ("a/b", "a", 0, 4), ("a/c", "a", 5, 9), ("a/b/d", "a/b", 0, 2), (None, "a", 1, 1)], "n string, p string, s long, e long")
    assert len(rows(hierarchy.closure(u, "n", "p"))) == 4 + 3 + 1
    assert rows(hierarchy.leaves(u, "n", "p")) == [("a/b/d",), ("a/c",)]
    assert rows(hierarchy.selected(u, ["a/b", "a/b/d", "a/c"], "n", "p")) == [("a/b",), ("a/c",)]
    assert ("a/b", 0, 2, 1) in rows(hierarchy.roll_up(u, "n", "p", "s", "e"))
    f = spark.createDataFrame([(i, i * 2) for i in range(8)] + [(9, None)], "id long, frame long")
    some = spark.createDataFrame([(2, 4), (3, 6), (20, 10)], "s long, e long")
    for small in (100, 0):
        assert rows(hierarchy.within(f, some, "frame", "s", "e", small).select("id")) == [(1,), (2,), (3,)]


def test_indented_tree(spark):
    text = ["root", "  x", "    y", "", "  z", "    w", " v"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, n int, line string")
    got = {r["name"]: r.parent for r in hierarchy.indented(df).collect()}
    assert got == {"root": None, "x": "root", "y": "x", "z": "root", "w": "z", "v": "root"}


def test_line_histogram(spark):
    seg = spark.createDataFrame([(1, 0, 0, 0, 10), (1, 5, 5, 5, 5), (1, 0, 3, 7, 3)], "img long, x1 long, y1 long, x2 long, y2 long")
    got = rows(histograms.line_bins(seg, 10.0, 6.0, ["img"]))
    assert sum(r[3] for r in got) == 17 and len(got) == 2  # the segment without length is left out


def test_arp_mass_and_corner(spark):
    px = spark.createDataFrame([(1, r, c) for r in (0, 100, 479) for c in (0, 240, 479)], "img long, r long, c long")
    got = histograms.arp_bins(px, ["img"]).collect()
    assert sum(r.n for r in got) == 9 and max(r.rb for r in got) == 29
    hist = histograms.dense(histograms.arp_bins(px, ["img"]), ["img"], [("ab", 18), ("rb", 30)], "n").first().hist
    assert len(hist) == 540 and sum(hist) == 9


def test_orientation_split_keeps_mass(spark):
    px = spark.createDataFrame([(1, t / 10, 2.0) for t in range(63)], "img long, theta double, m double")
    got = histograms.orientation_split(px, ["img"]).agg(F.sum("m")).first()[0]
    assert got == pytest.approx(126)


def test_patch_sentinel(spark):
    px = spark.createDataFrame([(1, i, i, 0.1) for i in range(5)] + [(2, i, 70, 0.1) for i in range(6)], "img long, r long, c long, theta double")
    assert {r.img for r in histograms.patch_bins(px, ["img"]).collect()} == {2}


def test_diffusion_and_length(spark):
    g = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 1, 0.0), (1, 0, 2, 0.5)], "img long, x long, y long, v double")
    got = {r.y: r.v for r in histograms.diffuse(g, ["img"], reach=1, sigma=5.0).collect()}
    assert got[0] == pytest.approx(431.1, abs=50) or got[0] <= 1000
    assert max(got.values()) == 1000 and min(got.values()) == 0
    px = spark.createDataFrame([(1, 5, c, math.pi / 2, 1.0) for c in range(10)], "img long, r int, c int, theta double, m double")
    got = {r.c: r.length for r in histograms.edge_lengths(px, ["img"], 1.0, 20, 20, 3).collect()}
    assert got[5] >= got[0] > 1


def test_minhash_estimates_jaccard(spark):
    fs = minhash.hash_functions(3)
    df = spark.createDataFrame([(1, [0.0] * 10), (2, [9.0, 8.0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0]), (3, None)], "id long, h array<double>")
    got = {r.id: r.s for r in df.select("id", minhash.sketch(F.col("h"), fs).alias("s")).collect()}
    assert got[1] == [-1] * 30 and got[3] == [-1] * 30
    assert got[2] == [min((a * i + b) % minhash.PRIME for i in (0, 1)) for a, b in fs]


def test_votes(spark):
    db = spark.createDataFrame([(1, 0, list(range(30))), (2, 9, list(range(30))), (3, 63, list(range(30))), (4, 0, [-1] * 30), (5, 0, None), (6, 0, [1, 2])], "img_id long, patch int, h array<int>")
    q = spark.createDataFrame([(7, 0, list(range(30)))], "q long, patch int, h array<int>")
    p = minhash.inverted_file(db, ["img_id", "patch"])
    assert rows(minhash.votes(p, q, ["q"])) == [(7, 1, 10), (7, 2, 10)]
    assert rows(minhash.votes(p, q, ["q"], neighbours=False)) == [(7, 1, 10)]


def test_lsh_is_a_subset_of_exact_with_good_recall(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<double>")
    p = lsh.Plan(dim=8, radius=2.0, success=0.9, k=4, m=5)
    got = {(r.query, r.key) for r in lsh.near(df, df.where("id < 100"), p, "id", "v").collect()}
    d = np.sqrt(((x[:100, None] - x[None]) ** 2).sum(2))
    true = {(i, j) for i in range(100) for j in range(300) if i != j and d[i, j] <= 2.0}
    assert got <= true and len(got) >= 0.9 * len(true)


def test_series_match_plain_windows(spark):
    df = spark.createDataFrame([(k, i * 3 % 17, i, float(i % 5)) for k in ("a", None) for i in range(40)] + [("b", None, 1, 1.0)], "k string, t long, id long, x double")
    got = series.with_previous(df, ["k"], "t", "id", ["id"], 4)
    want = {}
    for k in ("a", None):
        ordered = sorted((i * 3 % 17, i) for i in range(40))
        for before, (_, i) in zip([None, *[i for _, i in ordered]], ordered, strict=False):
            want[k, i] = before
    assert {(r.k, r.id): r.prev and r.prev.id for r in got.collect()} == want
    run = series.running_total(df, ["k"], "t", "id", F.col("x"), 4).collect()
    for k in ("a", None):
        s = 0.0
        for _, i in sorted((i * 3 % 17, i) for i in range(40)):
            s += i % 5
            r = next(r for r in run if r.k == k and r.id == i)
            assert r.total == s and r.total_all == 80.0


def test_curve_features():
    t = np.linspace(0, 2 * math.pi, 60)
    f, length = curves.feature(5 * np.cos(t), 5 * np.sin(t))
    assert length == pytest.approx(10 * math.pi, rel=1e-3) and len(f) == 39 * 3
    assert np.array(f).reshape(-1, 3)[10:30, 2] == pytest.approx(0.2, abs=0.01)
    assert curves.feature([1, 1], [2, 2]) == ([], 0.0)
    _, turn = curves.feature(5 * np.cos(t), 5 * np.sin(t), version=2)
    assert turn == pytest.approx(2 * math.pi, rel=0.05)
    f3, _ = curves.feature(5 * np.cos(t), 5 * np.sin(t), version=3)
    assert len(f3) == pytest.approx(2 * math.pi / 0.5, abs=2)


def test_up_sampling(spark):
    k = spark.createDataFrame([("c", 0.0, 0.0, 0.0, 0.0), ("c", 1.0, 0.0, 0.0, 1.0), ("c", 2.0, 0.0, 0.0, 2.0), ("c", 2.0, 9.0, 9.0, 9.0), ("c", None, 1.0, 1.0, 1.0)], "clip string, t double, rx double, ry double, rz double")
    got = motion.up_sample(k, ["clip"], 4.0).orderBy("t").collect()
    assert len(got) == 9 and got[2].rz == pytest.approx(0.5) and got[4].wz == pytest.approx(1.0)
    v = motion.unwrap(np.array([[0, 0, 3.1], [0, 0, -3.1]]))
    assert v[1, 2] == pytest.approx(-3.1 + 2 * math.pi)


def test_pose_distance(spark):
    df = spark.createDataFrame([(1, [0.0] * 6), (2, [3.0, 4.0, 0.0, 0.0, 0.0, 2.0]), (3, [1.0])], "id long, c array<double>")
    assert [r[0] for r in df.select(motion.pose_distance("c", [0.0] * 6)).collect()] == [0.0, 7.0, None]


def test_swarm_improves_and_repeats(spark):
    cost = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)
    runs = [refine.refine(refine.start(spark, 8, 2, seed=4), cost, 6, seed=4) for _ in range(2)]
    first = refine.refine(refine.start(spark, 8, 2, seed=4), cost, 0, seed=4)
    assert runs[0][:2] == runs[1][:2] and runs[0][1] <= first[1]


def test_lucas_kanade():
    r, c = np.indices((48, 48))
    blob = lambda a, b: np.exp(-((r - a) ** 2 + (c - b) ** 2) / 60)
    assert refine.lucas_kanade(blob(26, 22), blob(24, 25)) == pytest.approx((2, -3), abs=0.2)


def test_recall(spark):
    ranked = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (1, 7, 3)], "query long, key long, rank long")
    rel = spark.createDataFrame([(1, 5), (1, 7), (2, 5)], "query long, key long")
    assert rows(search.recall_and_rank(ranked, rel, 2)) == [(1, 0.5, 1.0), (2, 0.0, None)]


def test_whole_curves_differ_after_the_first_rows(spark):
    from motionq.plans.motion import whole_curves

    up = [float(i) for i in range(40)]
    turned = up[:8] + [7.0 - i for i in range(32)]
    rows = [(c, i, i, x) for c, xs in (("a", up), ("b", turned), ("c", up[:3]), ("d", [1.0, 1.0])) for i, x in enumerate(xs)]
    score = {r.clip: r.score for r in whole_curves(spark.createDataFrame(rows, "clip string, frame long, id long, x double")).collect()}
    assert score["a"] == 1.0 and score["b"] < 0 and 0.9 < score["c"] < 1.0 and "d" not in score


@pytest.mark.parametrize("small", [200_000, 0])
def test_deep_hierarchies(spark, small):
    chain = spark.range(1000).select(F.col("id").alias("n"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    got = hierarchy.closure(chain, "n", "p", small)
    assert got.count() == 500_500 and got.agg(F.max("depth")).first()[0] == 999
    two = spark.createDataFrame([(1, None), (2, 1), (3, 1), (4, 2), (4, 3)], "n long, p long")
    assert rows(hierarchy.closure(two, "n", "p", small).where("node = 4")) == [(1, 4, 2), (1, 4, 2), (2, 4, 1), (3, 4, 1), (4, 4, 0)]
    ring = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "n long, p long")
    with pytest.raises(Exception, match="cycle"):
        hierarchy.closure(ring, "n", "p", small).collect()


def test_selection_by_path(spark):
    u = spark.createDataFrame([("a", None), ("a/b", "a"), ("a/b/d", "a/b"), ("ab", None)], "n string, p string")
    for sep in (None, "/"):
        assert rows(hierarchy.selected(u, ["a/b/d", "a", "ab", "none"], "n", "p", sep)) == [("a",), ("ab",)]


def test_wide_indentation(spark):
    text = ["root", " " * 31 + "x", " " * 32 + "y", " " * 40 + "z", " " * 31 + "w"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(text)], "file string, n int, line string")
    assert {r["name"]: r.parent for r in hierarchy.indented(df).collect()} == {"root": None, "x": "root", "y": "x", "z": "y", "w": "root"}


def test_ranges_without_nested_loops(spark):
    rng = np.random.default_rng(6)
    units = [(i, int(a), int(a + n)) for i, (a, n) in enumerate(zip(rng.integers(-500, 500, 60), rng.integers(-2, 90, 60), strict=True))]
    u = spark.createDataFrame(units, "u long, s long, e long")
    f = spark.createDataFrame([(i, int(x)) for i, x in enumerate(rng.integers(-600, 700, 300))] + [(999, None)], "id long, frame long")
    want = {(i, x, k) for i, x in f.collect() if x is not None for k, s, e in units if s <= x <= e}
    assert {(r.id, r.frame, r.u) for r in hierarchy.containing(f, u, "frame", "s", "e").collect()} == want
    for small in (100, 0):
        got = hierarchy.within(f, u, "frame", "s", "e", small)
        assert sorted(r.id for r in got.collect()) == sorted({i for i, _, _ in want})
        assert "NestedLoop" not in got._jdf.queryExecution().toString()
    assert hierarchy.within(f, u.limit(0), "frame", "s", "e").count() == 0


def test_numbered_rows_and_offsets(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7 % 1000).alias("x"), F.col("id").alias("n"))
    assert all(r.x == r.at for r in series.numbered(df, "x", "at").collect())
    got = {r.x: r.offset for r in series.running_offsets(df, "x", "n", 16).collect()}
    n, total = {r.x: r.n for r in df.collect()}, 0
    for x in range(1000):
        assert got[x] == total
        total += n[x]
    assert series.numbered(df.limit(0), "x", "at").count() == 0 and series.running_offsets(df.limit(0), "x", "n").count() == 0


def test_up_sampling_of_all_bones_of_a_take(spark):
    rng = np.random.default_rng(2)
    keys = [("c", s, b, t / 30, *rng.normal(0, 0.3, 3).round(3).tolist()) for s, b in ((0, "x"), (0, "y"), (1, "x")) for t in range(s * 8, s * 8 + 8)] + [("c", 0, "x", None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(keys, "clip string, seg int, bone string, t double, rx double, ry double, rz double")
    whole = motion.up_sample(df, ["clip", "seg"], 60.0, bone="bone")
    each = motion.up_sample(df, ["clip", "bone", "seg"], 60.0)
    assert rows(whole.select(*each.columns)) == rows(each) and whole.count() == 45
    tied = motion.overlapping(df.where("t is not null"), ["clip", "bone"], "seg", "t")
    assert tied.count() == 25 and tied.where("seg = 0 and bone = 'x'").agg(F.max("t")).first()[0] == pytest.approx(8 / 30)


def test_folders(spark):
    f = spark.createDataFrame([("a/b/c",), ("a/d",), (None,)], "path string")
    assert rows(hierarchy.folders(f)) == [("a", None, 0, False), ("a/b", "a", 1, False), ("a/b/c", "a/b", 2, True), ("a/d", "a", 1, True)]
