"""Most similar vectors for every vector, by adaptive dimension scan inside probed lists.

Vectors are brought together by overlapping cells (``cells``). Inside a cell they are rotated by a
random orthogonal matrix and split into inverted lists. A query first scans its own list; its k-th
distance then bounds everything that follows: further lists are probed only if their border is
nearer than the bound, and inside a probed list the columns are scanned in blocks. After each
block a hypothesis test (Gao and Long 2023: partial distance of t of D rotated columns against the
bound times ``t / D * (1 + eps0 / sqrt(t))**2``) abandons candidates; the others get further
columns, and those left their exact distance. The own list is compared in full: it is what gives the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionq.llm import cells as C
from motionq.llm.shared import partitions, table

#: Rows of an inverted list; columns of the first block are a quarter of all, this at least.
LIST_ROWS, FIRST_COLUMNS = 192, 6
#: Significance of the test: a true neighbour is abandoned with a chance of about 1e-5.
EPS0 = 2.1
#: One in so many asking records tells how many will ask in a cell.
ASK_SAMPLE = 16
#: Above this share of survivors a list is scanned on by whole column blocks, below it pair by pair.
DENSE = 0.15


def rotation(width: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(width).normal(size=(width, width)))
    return q * np.sign(np.diag(r))


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x - y
    return np.round(np.sqrt(np.einsum("ij,ij->i", d, d)), 6)


def _bound(limit2, t, width, eps0):
    return limit2 * min(1.0, t / width * (1 + eps0 / np.sqrt(t)) ** 2)


def blocks(width: int) -> list[tuple[int, int]]:
    """The column blocks that are scanned one after the other."""
    t = min(width, max(FIRST_COLUMNS, width // 4))
    return [(at, min(at + t, width)) for at in range(0, width, t)]


def scan(xr, norms, q, m, limit2, slack, eps0):
    """Pairs (position in ``q``, position in ``m``) not abandoned against ``limit2`` of each query.

    After every block of columns the test drops pairs: whole blocks are multiplied while many are left, then pair by pair.
    """
    width, total, rest = xr.shape[1], 0, blocks(xr.shape[1])
    while rest:
        (s, e), rest = rest[0], rest[1:]
        n = norms[s]
        total = total + (n[q][:, None] + n[m][None] - 2 * (xr[q, s:e] @ xr[m, s:e].T))
        alive = total <= (_bound(limit2, e, width, eps0) + slack)[:, None]
        if alive.mean() <= DENSE:
            break
    i, j = np.nonzero(alive)
    total = total[i, j]
    for s, e in rest:
        if not len(i):
            break
        step = xr[q[i], s:e] - xr[m[j], s:e]
        total = total + np.einsum("ij,ij->i", step, step)
        keep = total <= _bound(limit2, e, width, eps0)[i] + slack[i]
        i, j, total = i[keep], j[keep], total[keep]
    return i, j


def neighbours(x: np.ndarray, ids: np.ndarray, asks: np.ndarray, answers: np.ndarray, k: int, radius: float, eps0: float = EPS0, list_rows: int = LIST_ROWS):
    """``(query row, data row, distance)`` of the k nearest, and ties with the k-th, within ``radius``."""
    empty = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    n, width = x.shape
    if n < 2 or not asks.any():
        return empty
    x = x - np.median(x, axis=0)
    xr = x @ rotation(width)
    norms = {a: (xr[:, a:b] ** 2).sum(1) for a, b in blocks(width)}
    slack = 1e-9 + 1e-11 * (x * x).sum(1)
    lists = max(1, n // list_rows)
    centres = C.kmeans(x, lists, rounds=2, seed=width) if lists > 1 else x[:1]
    d2 = C.squared(x, centres)
    home = d2.argmin(1)
    order = np.argsort(home, kind="stable")
    members = np.split(order, np.searchsorted(home[order], np.arange(1, lists)))
    limit2 = np.full(n, (radius + 1e-6) ** 2)
    found: list[tuple] = []

    def take(q, m, i, j):
        i, j = q[i], m[j]
        other = ids[i] != ids[j]
        i, j = i[other], j[other]
        d = exact(x[i], x[j])
        near = d <= radius
        found.append((i[near], j[near], d[near]))

    for own in members:  # the own list gives every query its bound
        m = own[answers[own]]
        for some in np.array_split(own[asks[own]], max(1, len(own) * len(m) // 2_000_000)):
            if not len(some) or not len(m):
                continue
            near = C.squared(x[some], x[m])
            near[ids[some][:, None] == ids[m][None]] = np.inf
            if len(m) > k:
                kth = np.partition(near, k - 1, axis=1)[:, k - 1]
                limit2[some] = np.minimum(limit2[some], kth + slack[some])
            take(some, m, *np.nonzero(near <= (limit2[some] + slack[some])[:, None]))
    if lists > 1:
        asking = np.flatnonzero(asks)
        reach = C.border(d2[asking], home[asking], centres) <= (np.sqrt(limit2[asking]) * (1 + 1e-9) + slack[asking])[:, None]
        reach[np.arange(len(asking)), home[asking]] = False
        for c in range(lists):
            q, m = asking[reach[:, c]], members[c][answers[members[c]]]
            for some in np.array_split(q, max(1, len(q) * len(m) // 2_000_000)):
                if len(some) and len(m):
                    take(some, m, *scan(xr, norms, some, m, limit2[some], slack[some], eps0))
    i, j, d = (np.concatenate(part) for part in zip(*found, strict=True)) if found else empty
    if not len(i):
        return empty
    order = np.lexsort((d, i))
    i, j, d = i[order], j[order], d[order]
    first, end = np.searchsorted(i, i), np.searchsorted(i, i, side="right")
    keep = d <= d[np.minimum(first + k, end) - 1]
    return i[keep], j[keep], d[keep]


def closest(x, ids, y, names, limit2, k: int):
    """``(query row, data row, distance)``: for each row of ``x`` its k nearest of ``y``, with ties, within ``limit2``.

    Single precision gives lower bounds of all distances and, where more than k are within the limit, upper bounds of which
    the k-th is the limit; what is left is measured exactly.
    """
    found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    if len(x) and len(y):
        middle = np.median(y, axis=0)
        x, y = x - middle, y - middle
        kind = np.float32 if max(np.abs(x).max(), np.abs(y).max()) < 1e15 else float
        z, w = x.astype(kind), y.astype(kind)
        sz, sw = np.einsum("ij,ij->i", z, z), np.einsum("ij,ij->i", w, w)
        ez, ew = 8e-6 * sz + 1e-3, 8e-6 * sw + 1e-3
        limit = ((np.sqrt(limit2) + 2e-6) ** 2 * (1 + 1e-6)).astype(kind)
        own = np.isin(ids, names)
        for some in np.array_split(np.arange(len(x)), len(x) * len(y) // 2_000_000 + 1):
            if not len(some):
                continue
            low = z[some] @ w.T
            low *= -2
            low += sw - ew
            low += (sz - ez)[some][:, None]
            for r in np.flatnonzero(own[some]):
                low[r, names == ids[some[r]]] = np.inf
            alive = low <= limit[some][:, None]
            alive &= low < np.inf
            many = np.flatnonzero(np.count_nonzero(alive, axis=1) > k)
            if len(many):
                high = low[many] + 2 * ew
                kth = np.maximum(np.partition(high, k - 1, axis=1)[:, k - 1] + 2 * ez[some[many]], 0)
                alive[many] &= low[many] <= ((np.sqrt(kth) + 2e-6) ** 2 * (1 + 1e-6))[:, None]
            i, j = np.nonzero(alive)
            found.append(_best(x, ids, y, names, some[i], j, k))
    return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _best(x, ids, y, names, i, j, k: int):
    """The k nearest of the pairs of each query, and ties with the k-th."""
    other = ids[i] != names[j]
    i, j = i[other], j[other]
    d = exact(x[i], y[j])
    order = np.lexsort((d, i))
    i, j, d = i[order], j[order], d[order]
    first, end = np.searchsorted(i, i), np.searchsorted(i, i, side="right")
    keep = d <= d[np.minimum(first + k, end) - 1]
    return i[keep], j[keep], d[keep]


def nearest(points: DataFrame, k: int = 5, radius: float = 6.0, eps0: float = EPS0, **sizes: int) -> DataFrame:
    """``(id, other, distance)``: the k nearest other records within ``radius``, and ties with the k-th.

    ``points`` needs ``id``, ``dimension``, ``coords``; further columns are not read. Distance is
    Euclidean between usable records (see ``cells.usable``) of equally many coordinates, rounded to
    6 decimals, and compared so rounded. Unusable records and null ids have no rows; a record
    without neighbours has none; repeated deliveries of an id count once; equal records at distance
    0 are neighbours. Loss: each test abandons a true neighbour with a chance of about 1e-5.
    """
    cells = C.fit(points, radius, **sizes)

    def work(t: pa.Table) -> pa.Table:
        hot_cell = t.column("part")[0].as_py() >= 0
        ids, role, x = C.group(t)
        i, j, d = neighbours(x, ids, (role & C.QUERY) > 0, (role & C.DATA) > 0, k, radius, eps0)
        return pa.table({"id": ids[i], "other": ids[j], "distance": d, "hot": np.full(len(i), hot_cell)})

    rows = C.assign(points, cells).groupBy("dim", "cell", "part").applyInArrow(work, "id long, other long, distance double, hot boolean")
    if cells.inner is None:  # no cell is hot
        return rows.drop("hot")
    by_id = Window.partitionBy("id").orderBy("distance")
    merged = rows.where("hot").withColumn("place", F.rank().over(by_id)).where(F.col("place") <= k)
    return rows.where("not hot").drop("hot").unionByName(merged.drop("hot", "place"))


def nearest_all(points: DataFrame, k: int = 5, radius: float = 6.0, ask_rows: int = C.HOT_ROWS, **sizes: int) -> DataFrame:
    """``(id, other, distance)``: the k nearest other records however far, and ties with the k-th.

    As ``nearest``, but ``radius`` only says how far rows are copied at first. Records that find k so near are
    done; the k-th distance of the others inside their own cell bounds their search, and they are sent to all
    cells whose border is nearer (without k in their cell: to all). Only a record whose dimension holds k others
    or fewer has fewer than k rows. Cells expected (by one in ASK_SAMPLE of the asking records) to be asked by more than
    ``ask_rows`` records are worked in parts.
    """
    cells = C.fit(points, radius, **sizes)

    def work(t: pa.Table) -> pa.Table:
        ids, role, x = C.group(t)
        asks, answers = (role & C.QUERY) > 0, (role & C.DATA) > 0
        i, j, d = neighbours(x, ids, asks, answers, k, radius)
        few = np.flatnonzero(asks & (np.bincount(i, minlength=len(ids)) < k))
        m = np.flatnonzero(answers)
        p, q, e = closest(x[few], ids[few], x[m], ids[m], np.full(len(few), np.inf), k)
        keep = ~np.isin(i, few)
        none = few[np.bincount(p, minlength=len(few)) == 0]  # nobody in the cell: a row that says so
        other = pa.concat_arrays([pa.array(ids[np.concatenate([j[keep], m[q]])], pa.int64()), pa.nulls(len(none), pa.int64())])
        return pa.table({"id": ids[np.concatenate([i[keep], few[p], none])], "other": other, "distance": np.concatenate([d[keep], e, np.full(len(none), np.inf)])})

    schema = "id long, other long, distance double"
    by_id = Window.partitionBy("id").orderBy("distance")
    best = lambda df: df.where("other is not null").withColumn("place", F.rank().over(by_id)).where(F.col("place") <= k).drop("place")
    first = C.assign(points, cells).groupBy("dim", "cell", "part").applyInArrow(work, schema)
    if cells.inner is None and all(len(c) == 1 for c in cells.centres.values()):
        return best(first)
    first = table(first)
    kth = F.get(F.array_sort(F.collect_list("distance")), F.lit(k - 1))
    nearby = best(first)
    bounds = first.select("id").distinct().join(nearby.groupBy("id").agg(kth.alias("bound")), "id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    records = points.where("id is not null").select("id", "dimension", "coords")
    waiting = table(records.join(bounds.where(F.col("bound") > radius), "id").withColumn("bound", F.col("bound") + 2e-6))  # bounds are rounded
    some = waiting.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(ASK_SAMPLE)) == 0)
    by = ["dim", "cell", "part"]
    crowds = C.route(some, cells, "ask").groupBy(*by).agg(F.ceil(F.count("*") * ASK_SAMPLE / ask_rows).cast("int").alias("crowd"))
    crowds = table(crowds.where("crowd > 1"))
    n = F.coalesce("crowd", F.lit(1))
    asked = C.route(waiting, cells, "ask").join(crowds, by, "left").withColumn("turn", F.pmod(F.xxhash64("id"), n).cast("int")).drop("crowd")
    answering = C.route(records, cells, "answer").join(crowds, by, "left").withColumn("turn", F.explode(F.sequence(F.lit(0), n - 1))).drop("crowd")

    def rest(t: pa.Table) -> pa.Table:
        width, role, ids = t.column("dim")[0].as_py(), t.column("role").to_numpy(), t.column("id").to_numpy()
        x, bound = C.unpack(t.column("enc").to_numpy(), t.column("v"), width), t.column("bound").to_numpy()
        q, m = (np.flatnonzero(role == r) for r in (C.QUERY, C.DATA))
        q, m = (rows[np.unique(ids[rows], return_index=True)[1]] for rows in (q, m))
        i, j, d = closest(x[q], ids[q], x[m], ids[m], bound[q] ** 2, k)
        return pa.table({"id": ids[q[i]], "other": ids[m[j]], "distance": d})

    meeting = asked.unionByName(answering).repartition(partitions(points.sparkSession, cells.expected // C.CELL_ROWS), *by, "turn")
    further = meeting.groupBy(*by, "turn").applyInArrow(rest, schema)
    return best(first.unionByName(further).distinct())


def pairs(near: DataFrame) -> DataFrame:
    """Pairs ``id_a < id_b`` of which at least one is among the nearest of the other."""
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()
