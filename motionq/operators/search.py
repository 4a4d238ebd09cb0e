"""Exact similarity search: one query vector, fused parts, patches, or many queries in blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionq.functions import batch, vec

#: Rows of a block of queries or of data; rows that a cell should hold, most cells of a vector length, and sample of their centres.
BLOCK_ROWS, CELL_ROWS, CELLS, SAMPLE_ROWS = 20_000, 4_096, 256, 20_000
#: Most patches of a sketch (a canvas has 64), which go to all tasks.
PATCHES = 64


def best(df: DataFrame, score: str, key: str, k: int | None, largest: bool = True) -> DataFrame:
    """Best first: largest score first with ties to the larger key, or smallest first with ties to the smaller."""
    order = [F.desc(score), F.desc(key)] if largest else [F.asc(score), F.asc(key)]
    df = df.orderBy(*order)
    return df if k is None else df.limit(k)


def correlate(db: DataFrame, query: Sequence[float], key: str, vector: str, k: int | None = 50, weight: float = 1.0) -> DataFrame:
    """``(key, score)``: weighted Pearson correlation with ``query``, best first.

    Rows without correlation (null, other length, constant vector) are left out.
    """
    score = F.round(batch.against(vector, query) * F.lit(float(weight)), 6)
    return best(db.select(key, score.alias("score")).where("score is not null"), "score", key, k)


def fused(db: DataFrame, query: dict[int, Sequence[float]], weights: dict[int, float], key: str, part: str, vector: str, k: int | None = 50) -> DataFrame:
    """``(key, score)``: weighted correlations of body parts, accumulated by key; missing parts add nothing."""
    score = batch.by_part(part, vector, query, weights)
    out = db.select(key, score.alias("s")).groupBy(key).agg(F.round(F.sum(F.coalesce("s", F.lit(0.0))), 6).alias("score"))
    return best(out, "score", key, k)


def patch_search(db: DataFrame, sketch: DataFrame, key: str = "img_id", k: int | None = 50) -> DataFrame:
    """``(key, score)``: sum over sketch patches of the correlation with the patch at the same place.

    ``db(key, patch, hist)``, ``sketch(patch, hist)`` with at most PATCHES rows; empty patches add 0.
    """
    drawn = sketch.select("patch", "hist").limit(PATCHES + 1).collect()
    if len(drawn) > PATCHES:
        raise ValueError("a sketch has at most 64 patches")
    known = {r.patch: list(r.hist) for r in drawn if r.patch is not None and r.hist is not None and None not in r.hist}
    both = db.where(F.col("patch").isin([r.patch for r in drawn if r.patch is not None]))
    out = both.select(key, F.coalesce(batch.by_part("patch", "hist", known), F.lit(0.0)).alias("s")).groupBy(key).agg(F.round(F.sum("s"), 6).alias("score"))
    return best(out, "score", key, k)


def nearest(db: DataFrame, query: Sequence[float], key: str, vector: str, k: int = 50, norm: str | float = "l2sq") -> DataFrame:
    """``(key, distance)`` of the ``k`` nearest by the chosen norm, ties to the smaller key."""
    d = F.round(batch.against(vector, query, norm), 6)
    return best(db.select(key, d.alias("distance")).where("distance is not null"), "distance", key, k, largest=False)


def radius_search(db: DataFrame, queries: DataFrame, radius: float, k: int, key: str, vector: str, block_rows: int = BLOCK_ROWS, eps: float = 0.0, cell_rows: int = CELL_ROWS) -> DataFrame:
    """For each query the number of rows within ``radius`` and the ``k`` nearest of them.

    ``(query, rank, key, distance, within)``; with ``k`` = 0 one row per query with the count only (rank, key, distance
    null), else a row for each neighbour. ``eps`` > 0 may leave out points beyond ``radius / (1 + eps)``. A row is not its
    own neighbour; rows of other lengths are no neighbours; null and empty vectors are skipped.

    Rows lie in cells around at most CELLS sampled vectors of their length. Sizes and extents of the cells bound how far the
    k-th neighbour can be, so a query visits only cells that may hold one of its answers. Cells are worked in
    blocks of about ``block_rows`` rows and queries, by matrix products; neither side is broadcast.
    """
    reach = radius / (1 + eps)
    some = lambda df: df.select(F.col(key).cast("long").alias("key"), vec.col(vector).alias("v")).where("v is not null and size(v) > 0 and key is not null")
    db, queries = some(db), some(queries)
    centres = _centres(db, cell_rows)
    homes = db.mapInArrow(lambda it: _home(it, centres), "n int, cell int, key long, v array<double>, far double")
    extents: dict[int, list] = {}
    for r in homes.groupBy("n", "cell").agg(F.count("*").alias("rows"), F.max("far").alias("far")).orderBy("n", "cell").collect():  # a row a cell
        extents.setdefault(r.n, []).append((r.cell, r["rows"], r.far))
    sizes = {n: np.array(x) for n, x in extents.items()}
    asked = queries.mapInArrow(lambda it: _asking(it, centres, sizes, reach, k), "n int, cell int, key long, v array<double>")
    spark = db.sparkSession
    asks = {(r.n, r.cell): r.asks for r in asked.groupBy("n", "cell").agg(F.count("*").alias("asks")).collect()}
    plan = [(n, int(c), -(-asks[n, int(c)] // block_rows), -(-int(rows) // block_rows)) for n, x in sizes.items() for c, rows, _ in x if (n, int(c)) in asks]
    blocks = F.broadcast(spark.createDataFrame(plan, "n int, cell int, qs int, ds int"))
    own = lambda m: F.pmod(F.xxhash64("key"), F.col(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    left = asked.join(blocks, ["n", "cell"]).withColumns({"q": own("qs"), "d": every("ds"), "role": F.lit(0)})
    right = homes.drop("far").join(blocks, ["n", "cell"]).withColumns({"q": every("qs"), "d": own("ds"), "role": F.lit(1)})
    by = ["n", "cell", "q", "d"]
    rows = left.select(*by, "role", "key", "v").unionByName(right.select(*by, "role", "key", "v"))
    found = rows.groupBy(*by).applyInArrow(lambda t: _compare(t, reach, k), "query long, key long, distance double, n long")
    if np.isinf(reach):  # all rows of its length, but those of its own key
        all_ = spark.createDataFrame([(n, int(x[:, 1].sum())) for n, x in sizes.items()], "n int, total long")
        same = db.groupBy("key", F.size("v").alias("n")).agg(F.count("*").alias("same"))
        mine = queries.select("key", F.size("v").alias("n"))
        counts = mine.join(F.broadcast(all_), "n", "left").join(same, ["key", "n"], "left")
        counts = counts.groupBy(F.col("key").alias("query")).agg(F.sum(F.coalesce("total", F.lit(0)) - F.coalesce("same", F.lit(0))).alias("within"))
    else:
        counts = queries.select(F.col("key").alias("query"), F.lit(0).cast("long").alias("n")).unionByName(found.where("key is null").select("query", "n"))
        counts = counts.groupBy("query").agg(F.sum("n").alias("within"))
    if k == 0:
        return counts.select("query", F.lit(None).cast("long").alias("rank"), F.lit(None).cast("long").alias("key"), F.lit(None).cast("double").alias("distance"), "within")
    order = Window.partitionBy("query").orderBy("distance", "key")
    top = found.where("key is not null").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)
    return top.join(counts, "query").select("query", "rank", "key", "distance", "within")


def _matrices(batch):
    """``(length, rows, matrix)`` of the vectors of a batch."""
    v = batch.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    offsets, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield int(n), rows, flat[offsets[rows][:, None] + np.arange(n)]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by the product form."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0)


def _centres(db: DataFrame, cell_rows: int) -> dict[int, np.ndarray]:
    """Sampled vectors of each length, one for about ``cell_rows`` rows; at most CELLS of a length."""
    total = db.count()
    share = min(1.0, SAMPLE_ROWS / max(total, 1))
    got = db.where(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(1 << 30)) <= int(share * (1 << 30))).toArrow()
    out = {}
    for n, rows, x in _matrices(got):
        x = np.unique(x[np.isfinite(x).all(1)], axis=0)
        k = min(CELLS, len(x), max(1, round(len(rows) / share / cell_rows)))
        if k:
            out[n] = x[np.random.default_rng(n).choice(len(x), k, replace=False)]
    return out


def _home(batches, centres):
    for batch in batches:
        key = batch.column("key").to_numpy()
        for n, rows, x in _matrices(batch):
            x = np.nan_to_num(x, nan=np.inf)
            if n not in centres:
                cell, far = np.zeros(len(x), int), np.full(len(x), np.inf)
            else:
                with np.errstate(invalid="ignore"):
                    d2 = _apart(x, centres[n])
                cell = np.nan_to_num(d2, nan=np.inf).argmin(1)
                far = np.sqrt(((x - centres[n][cell]) ** 2).sum(1))
            yield _cells(n, cell, key[rows], x, far)


def _cells(n, cell, key, x, far=None):
    columns = [np.full(len(key), n, np.int32), cell.astype(np.int32), key, pa.ListArray.from_arrays(pa.array(np.arange(len(key) + 1, dtype=np.int32) * n), pa.array(x.ravel()))]
    names = ["n", "cell", "key", "v"]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns[:3]), columns[3], *([pa.array(far)] if far is not None else [])], names=names + ["far"] * (far is not None))


def _asking(batches, centres, sizes, reach, k):
    for batch in batches:
        key = batch.column("key").to_numpy()
        for n, rows, x in _matrices(batch):
            if n not in sizes:
                continue
            cell, count, far = sizes[n].T
            middle = centres[n][cell.astype(int)] if n in centres else np.zeros((len(cell), n))
            gap = np.sqrt(((x[:, None] - middle[None]) ** 2).sum(2)) if len(x) * middle.size < 4_000_000 else np.sqrt(_apart(x, middle))
            bound = np.full(len(x), reach)
            if k:  # the nearest cells that surely hold k others
                whole = gap + far[None]
                order = np.argsort(whole, axis=1)
                enough = np.cumsum(count[order], axis=1) > k + 1
                first = np.where(enough.any(1), enough.argmax(1), 0)
                most = np.take_along_axis(whole, order, 1)[np.arange(len(x)), first]
                if not np.isfinite(reach):
                    bound = np.where(enough.any(1), most, np.inf)
            slack = 2e-6 + 1e-6 * np.abs(gap)
            at, c = np.nonzero(~(gap - far[None] - slack > bound[:, None]))
            yield _cells(n, cell[c], key[rows][at], x[at])


def _compare(t: pa.Table, reach: float, k: int) -> pa.Table:
    role, keys = t.column("role").to_numpy(), t.column("key").to_numpy()
    _, _, x = next(iter(_matrices(t)))
    q, d, qk, dk = x[role == 0], x[role == 1], keys[role == 0], keys[role == 1]
    out: list[tuple] = []
    if len(q) and len(d):
        middle = np.median(d, axis=0) if np.isfinite(d).all() else 0
        for some in np.array_split(np.arange(len(q)), len(q) * len(d) // 4_000_000 + 1):
            with np.errstate(invalid="ignore"):
                near = _apart(q[some] - middle, d - middle)
                near[~np.isfinite(near)] = np.inf
            near[qk[some][:, None] == dk[None]] = np.inf
            slack = 1e-9 + 1e-11 * ((q[some] - middle) ** 2).sum(1)[:, None]
            limit = np.full((len(some), 1), (reach + 1e-6) ** 2)
            if np.isfinite(reach):
                i, j = np.nonzero(near <= limit + slack)
                n = np.bincount(i[_exact(q[some[i]], d[j]) <= reach], minlength=len(some))
                out.append((qk[some], np.full(len(some), -1), np.zeros(len(some)), n))
            if k:
                if len(d) > k:
                    kth = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
                    limit = np.minimum(limit, (np.sqrt(kth + slack) + 2e-6) ** 2)
                i, j = np.nonzero((near <= limit + slack) & np.isfinite(near))
                e = _exact(q[some[i]], d[j])
                order = np.lexsort((dk[j], e, i))
                i, j, e = i[order], j[order], e[order]
                keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (e <= reach)
                out.append((qk[some[i[keep]]], dk[j[keep]], e[keep], np.zeros(keep.sum(), int)))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0, int)]
    counts = np.zeros(len(cols[0]), bool) if not out else np.concatenate([np.full(len(o[0]), np.isfinite(reach) and i % (2 if k else 1) == 0) for i, o in enumerate(out)])
    plain = lambda c, ty: pa.array(c, ty, mask=counts)
    return pa.table({"query": pa.array(cols[0], pa.int64()), "key": plain(cols[1], pa.int64()), "distance": plain(cols[2], pa.float64()), "n": pa.array(cols[3], pa.int64())})


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.round(np.sqrt(((x - y) ** 2).sum(1)), 6)


def colours(ranked: DataFrame, size: int, rank: Column | str = "rank", n: Column | str = "n") -> DataFrame:
    """Rank-dependent colour index ``(n - rank) * (size - 1) div n``, rank counted from 0."""
    r, c = (F.col(x) if isinstance(x, str) else x for x in (rank, n))
    return ranked.withColumn("colour", F.floor((c - r) * F.lit(size - 1) / c).cast("long"))


def recall_and_rank(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """``(query, recall, mean_rank)`` of ranked answers ``(query, key, rank)`` against ``relevant(query, key)``.

    recall: share of the relevant keys among the first ``k``; mean_rank: mean rank of those found (null: none).
    """
    hits = relevant.join(ranked.where(F.col("rank") <= k), ["query", "key"], "left")
    return hits.groupBy("query").agg(
        F.round(F.count("rank") / F.count("*"), 6).alias("recall"), F.round(F.avg("rank"), 6).alias("mean_rank")
    )


def recall_by_label(ranked: DataFrame, queries: DataFrame, db: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """``recall_and_rank`` where the rows of a query's own label, but for itself, are relevant.

    Relevant rows are counted by label, never listed; only the first ``k`` answers look up their labels. Null labels are
    relevant to nobody, queries without relevant rows are left out.
    """
    sizes = db.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n"))
    own = db.groupBy(F.col(key).alias("query"), F.col(label).alias("l")).agg(F.count("*").alias("self"))
    asked = queries.select(F.col(key).alias("query"), F.col(label).alias("l")).join(sizes, "l").join(own, ["query", "l"], "left")
    asked = asked.select("query", "l", (F.col("n") - F.coalesce("self", F.lit(0))).alias("n")).where("n > 0")
    hits = ranked.where(F.col("rank") <= k).select("query", "key", "rank").join(db.select(F.col(key).alias("key"), F.col(label).alias("l")), "key")
    hits = hits.groupBy("query", "l").agg(F.count("*").alias("hits"), F.avg("rank").alias("mean"))
    out = asked.join(hits, ["query", "l"], "left")
    return out.select("query", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"), F.round("mean", 6).alias("mean_rank"))


def align(query: DataFrame, db: DataFrame, key: str, reach: int, by: str = "ssd") -> DataFrame:
    """``(key, dx, dy, score)``: the offset within ``reach`` that fits grid ``query(x, y, v)`` best to each of ``db(key, x, y, v)``.

    ``by``: ``ssd`` (least sum of squared differences over all query cells, absent cells 0) or ``corr``
    (largest sum of products). The grid join is an equi-join.
    """
    every = F.explode(F.sequence(F.lit(-reach).cast("long"), F.lit(reach).cast("long")))
    moved = query.withColumn("dx", every).withColumn("dy", every).select((F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), "dx", "dy", F.col("v").alias("q"))
    hit = db.join(moved, ["x", "y"]).groupBy(key, "dx", "dy")
    if by == "corr":
        score = hit.agg(F.round(F.sum(F.col("v") * F.col("q")), 6).alias("score"))
        order = [F.desc("score")]
    else:
        whole = query.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0.0
        gain = F.sum((F.col("v") - F.col("q")) * (F.col("v") - F.col("q")) - F.col("q") * F.col("q"))
        score = hit.agg(F.round(gain + F.lit(float(whole)), 6).alias("score"))
        order = [F.asc("score")]
    first = Window.partitionBy(key).orderBy(*order, "dx", "dy")
    return score.withColumn("r", F.row_number().over(first)).where("r = 1").drop("r")
