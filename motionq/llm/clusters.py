"""Similarity clusters: MinHash banding, exact verification, components, medoids.

A vector is the set of its (column, grid cell) tokens; each band has its own randomly shifted grid
and hashes, so that misses of a pair are independent between bands. Records with the same band
key are candidates; candidates are verified, links give connected components. TESTDATA.md states
links by distance, so verification is by exact distance (records within 6.0 share most tokens).
Bucket members already in one component are not compared again, and inside a bucket a search from
the smallest groups compares each record only with those not reached yet: no list of all pairs
arises, however large a bucket is.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motionq.llm import cells as C
from motionq.llm.shared import components, dropped, merge_labels, partitions, table

#: Bands and minima in each. Grid cells are GRID * radius / sqrt(columns) wide: a pair just within the
#: radius then differs in about one of GRID tokens, and is missed by all bands with a chance of 6e-6.
BANDS, ROWS, GRID = 8, 6, 40
#: Buckets up to this size are compared by sorted neighbourhood, larger ones by search.
SMALL_BUCKET = 40
#: Rows searched from at once from which on the rest of the bucket is gathered.
GATHER = 12
#: Searches in a row that found nothing after which lone records are compared in batches, and size of a batch.
QUIET, BATCH = 8, 128


def band_keys(x: np.ndarray, radius: float, band: int, rows: int = ROWS, grid: float = GRID) -> np.ndarray:
    """Key of each row in ``band``: the combined minima of ``rows`` hashes over its tokens."""
    width = x.shape[1]
    rng = np.random.default_rng([band, width])
    step = grid * radius / np.sqrt(width)
    cell = np.floor(x / step + rng.random(width))
    with np.errstate(over="ignore", invalid="ignore"):
        token = cell.astype(np.int64).astype(np.uint32) * np.uint32(0x9E3779B1) ^ rng.integers(0, 2**32, width, dtype=np.uint32)
        token ^= token >> np.uint32(15)
        key = np.zeros(len(x), np.uint64)
        for _ in range(rows):
            h = token * np.uint32(rng.integers(0, 2**31) * 2 + 1)
            h ^= h >> np.uint32(13)
            h *= np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(16)
            key = key * np.uint64(0x9E3779B97F4A7C15) + h.min(1)
    return key


def _parts(rows: np.ndarray, work: int, most: int = 2_000_000) -> list[np.ndarray]:
    """``rows`` in parts, for matrices of ``work`` entries in all."""
    return [rows] if work <= most else np.array_split(rows, -(-work // most))


def _within(x, a, b, radius):
    d = x[a] - x[b]
    return np.round(np.sqrt(np.einsum("ij,ij->i", d, d)), 6) <= radius


def _search(x, member, label, radius, before=()):
    """Label pairs to join among the members of one large bucket.

    ``before``: keys of the members in earlier bands. Members that shared a bucket there are not compared again: they are
    joined already, or not linked.

    Groups of one label are searched from, smallest first and all but the largest, each against the members
    not searched from yet. Distances come in single precision about a member; where that could mislead, exactly.
    """
    pairs: list[tuple[int, int]] = []
    names, inverse, count = np.unique(label, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return pairs
    order = np.argsort(inverse, kind="stable")
    rows_by_name = np.split(order, np.cumsum(count)[:-1])
    largest = int(count.argmax())
    unseen = np.ones(len(member), bool)
    done = np.zeros(len(names), bool)
    y = (x[member] - x[member[0]]).astype(np.float32)
    sq = np.einsum("ij,ij->i", y, y)
    slack = 8e-6 * sq + 1e-3
    every = np.arange(len(member))
    coarse = 3 * len(names) < len(member)  # groups are compared as balls first
    if coarse:
        middle = np.zeros((len(names), y.shape[1]), np.float32)
        np.add.at(middle, inverse, y)
        middle /= count[:, None]
        apart = np.sqrt(((y - middle[inverse]) ** 2).sum(1))
        reach = np.zeros(len(names), np.float32)
        np.maximum.at(reach, inverse, apart)
        reach += radius + 0.05 + 1e-3 * reach + 2e-3 * np.sqrt((middle * middle).sum(1))  # single precision
    seeds = [s for s in np.argsort(count, kind="stable").tolist() if s != largest]
    quiet, next_ = 0, 0
    while next_ < len(seeds):
        seed, next_ = seeds[next_], next_ + 1
        if done[seed]:
            continue
        if quiet >= QUIET and count[seed] == 1:
            batch = [seed]
            while next_ < len(seeds) and len(batch) < BATCH and count[seeds[next_]] == 1:
                if not done[seeds[next_]]:
                    batch.append(seeds[next_])
                next_ += 1
            done[batch] = True
            rows = np.array([rows_by_name[b][0] for b in batch])
            i, j = _lone(x, y, sq, slack, member, rows, unseen, before, radius)
            unseen[rows] = False
            pairs.extend((int(names[a]), int(names[b])) for a, b in set(zip(inverse[i].tolist(), inverse[j].tolist(), strict=True)) if a != b)
            quiet = 0 if len(i) > 8 * len(batch) else quiet
            continue
        known = len(pairs)
        front = [seed]
        done[seed] = True
        while front:
            rows = rows_by_name[front[0]] if len(front) == 1 else np.concatenate([rows_by_name[f] for f in front])
            unseen[rows] = False
            front = []
            open_ = unseen
            for key in before:
                if len(rows) == 1 or (key[rows] == key[rows[0]]).all():
                    open_ = open_ & (key != key[rows[0]])
            if coarse and open_.any():
                near = (np.sqrt(C.squared(y[rows], middle)) <= reach).any(0)
                open_ = open_ & near[inverse]
            if not open_.any():
                break
            if len(rows) < GATHER and 4 * np.count_nonzero(open_) > len(every):  # copying the rest costs more than looking past it
                left, z, sz, most, hit = every, y.T, sq, slack, ~open_
            else:
                left = np.flatnonzero(open_)
                z, sz, most, hit = y[left].T, sq[left], slack[left], np.zeros(len(left), bool)
            for part in _parts(rows, len(rows) * len(left)):
                d2 = y[part] @ z
                d2 *= -2
                d2 += sz
                d2 += sq[part][:, None]
                d2 -= radius * radius
                over = slack[part][:, None]
                hit |= (d2 < -(over + most)).any(0)
                close = (d2[:, ~hit] <= over + most[~hit])
                if close.any():
                    i, j = np.nonzero(close)
                    j = np.flatnonzero(~hit)[j]
                    hit[j[_within(x, member[part[i]], member[left[j]], radius)]] = True
            for name in np.unique(inverse[left[hit & open_[left]]]):
                pairs.append((int(names[seed]), int(names[name])))
                if name != largest:
                    done[name] = True
                    front.append(int(name))
        quiet = quiet + 1 if len(pairs) == known else 0
    return pairs


def _lone(x, y, sq, slack, member, rows, unseen, before, radius):
    """Links ``(one of rows, another unseen one)``, but for those that shared a bucket in an earlier band."""
    out = [(np.zeros(0, int), np.zeros(0, int))]
    group = before[0][rows] if len(before) else np.zeros(len(rows), np.uint64)
    for name in np.unique(group):
        some = rows[group == name]
        open_ = unseen & (before[0] != name) if len(before) else unseen
        for key in before[1:]:
            if len(some) == 1 or (key[some] == key[some[0]]).all():
                open_ = open_ & (key != key[some[0]])
        left = np.flatnonzero(open_)
        for part in _parts(left, len(some) * len(left)):
            d2 = y[some] @ y[part].T
            d2 *= -2
            d2 += sq[part]
            d2 += (sq[some] - slack[some] - radius * radius)[:, None]
            i, j = np.nonzero(d2 <= slack[part])
            i, j = some[i], part[j]
            near = _within(x, member[i], member[j], radius)
            out.append((i[near], j[near]))
    return tuple(np.concatenate(a) for a in zip(*out, strict=True))


def local_components(x: np.ndarray, radius: float, bands: int = BANDS, rows: int = ROWS, grid: float = GRID) -> np.ndarray:
    """Smallest row number of the component of each row, over links found in any band."""
    n = len(x)
    label = np.arange(n)
    x = x - np.median(x, axis=0)
    before: list[np.ndarray] = []
    for band in range(bands):
        own = band_keys(x, radius, band, rows, grid)
        order = np.argsort(own, kind="stable")
        key = own[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(start, n))
        spread = np.repeat(size, size)
        left, right = [], []
        small = np.flatnonzero((spread > 1) & (spread <= SMALL_BUCKET))
        for step in range(1, SMALL_BUCKET):
            at = small[small + step < n]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            a, b = order[at], order[at + step]
            differ = label[a] != label[b]
            a, b = a[differ], b[differ]
            for part in _parts(np.arange(len(a)), len(a), 100_000):
                ok = part[_within(x, a[part], b[part], radius)]
                left.append(a[ok])
                right.append(b[ok])
        if left:
            label = merge_labels(label, np.concatenate(left), np.concatenate(right))
        for at in np.flatnonzero(size > SMALL_BUCKET):
            member = order[start[at] : start[at] + size[at]]
            joined = _search(x, member, label[member], radius, [k[member] for k in before])
            if joined:
                a, b = np.array(joined).T
                label = merge_labels(label, a, b)
        before.append(own)
    return label


def degrees(x: np.ndarray, label: np.ndarray, asks: np.ndarray, answers: np.ndarray, radius: float) -> np.ndarray:
    """Number of other rows linked to each asking row; all of them lie in its own component."""
    out = np.zeros(len(x), np.int64)
    x = x - np.median(x, axis=0)
    order = np.argsort(label, kind="stable")
    cut = np.flatnonzero(np.diff(label[order])) + 1
    limit = (radius + 1e-6) ** 2
    for member in np.split(order, cut):
        if len(member) < 2:
            continue
        q, m = member[asks[member]], member[answers[member]]
        for some in _parts(q, len(q) * len(m)):
            if len(some):
                d2 = C.squared(x[some], x[m])
                near = d2 <= limit
                edge = np.nonzero(near & (d2 > (radius - 1e-3) ** 2))
                near[edge] = _within(x, some[edge[0]], m[edge[1]], radius)
                out[some] = near.sum(1) - answers[some]
    return out


def linked(points: DataFrame, radius: float = 6.0, with_degree: bool = False, **sizes: int) -> tuple[DataFrame, DataFrame]:
    """Components inside cells, and what ties them together.

    The first: ``(id, root, degree)``, one row per record; the second edges ``(a, b)`` between
    records, for those records that were looked at in more than one place.
    """
    cells = C.fit(points, radius, **sizes)

    def work(t: pa.Table) -> pa.Table:
        hot_cell = t.column("part")[0].as_py() >= 0
        ids, role, x = C.group(t)
        label = local_components(x, radius)
        asks, answers = (role & C.QUERY) > 0, (role & C.DATA) > 0
        degree = degrees(x, label, asks, answers, radius) if with_degree else np.zeros(len(ids), np.int64)
        size = np.bincount(label, minlength=len(ids))[label]
        keep = asks | (size > 1)  # a copy without links tells nothing
        many = ~asks | hot_cell
        return pa.table({"id": ids[keep], "root": ids[label][keep], "home": asks[keep], "many": many[keep], "degree": degree[keep]})

    found = table(C.assign(points, cells).groupBy("dim", "cell", "part").applyInArrow(work, "id long, root long, home boolean, many boolean, degree long"))
    copies = found.where("many").select("id", "root")
    once = found.where("not many").join(copies.select("id").distinct(), "id", "left_semi").select("id", "root")
    ends = copies.unionByName(once).select(F.col("id").alias("a"), F.col("root").alias("b"))
    home = found.where("home").groupBy("id").agg(F.min("root").alias("root"), F.sum("degree").alias("degree"))
    return home, ends


def clusters(points: DataFrame, radius: float = 6.0, least: int = 5, with_degree: bool = False, **sizes: int) -> DataFrame:
    """``(id, cluster_id, degree)`` of every record in a cluster of at least ``least`` records.

    A cluster is everything reached over links (distance at most ``radius``, rounded to 6 decimals,
    between usable records of equally many coordinates); ``cluster_id`` is its smallest id. Unusable
    records, null ids and smaller clusters have no rows; repeated deliveries count once; equal
    records are linked. ``degree`` is the number of links of a record (0 unless asked for).
    """
    home, ends = linked(points, radius, with_degree, **sizes)
    roots = components(ends)
    whole = home.join(roots.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left")
    whole = whole.select("id", F.coalesce("top", "root").alias("top"), "degree")
    sizes_ = whole.groupBy("top").agg(F.count("*").alias("size"), F.min("id").alias("cluster_id")).where(F.col("size") >= least)
    return whole.join(sizes_, "top").select("id", "cluster_id", "degree")


def described(members: DataFrame, typical: int = 3) -> DataFrame:
    """``(cluster_id, size, links, medoids)``: the ``typical`` records of highest degree, ties by smaller id.

    The medoids come by a partial aggregation of bounded state (``max_by`` on degree, then id), not
    by sorting a cluster.
    """
    rank = F.struct(F.col("degree"), (-F.col("id")).alias("m"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(32)))
    part = Window.partitionBy("cluster_id", "salt").orderBy(F.desc("degree"), "id")
    top = salted.withColumn("r", F.row_number().over(part)).where(F.col("r") <= typical)
    medoids = top.groupBy("cluster_id").agg(F.slice(F.sort_array(F.collect_list(rank), asc=False), 1, typical).alias("best"))
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"), (F.sum("degree") / 2).cast("long").alias("links"))
    return size.join(medoids, "cluster_id").select("cluster_id", "size", "links", F.transform("best", lambda b: -b["m"]).alias("medoids"))


#: Members of highest degree that may become medoids in one round, and rows that one task compares with them.
CANDIDATES, MEMBER_ROWS = 512, 50_000


def split_loose(points: DataFrame, members: DataFrame, radius: float = 6.0, spread: float = 2.0, candidates: int = CANDIDATES) -> DataFrame:
    """``(id, cluster_id, medoid)``: every member of a cluster with the medoid of its group, at most ``spread * radius`` away.

    The first medoid of a cluster is its record of highest degree (ties: smaller id), the next the one of highest degree among
    those too far from all before, and so on; members go to the first medoid near enough. Needs ``degree``.
    A round takes its medoids from the ``candidates`` members of highest degree that are left, which gives the same as
    one medoid a round; rounds go on until nobody is left. A cluster is compared in blocks of about ``MEMBER_ROWS``.
    """
    x = points.select("id", "coords").where("coords is not null and id is not null").dropDuplicates(["id"])
    left = table(members.select("id", "cluster_id", "degree").join(x, "id"))
    limit, done = spread * radius, []

    def choose(t: pa.Table) -> pa.Table:
        ids, degree = t.column("id").to_numpy(), t.column("degree").to_numpy()
        order = np.lexsort((ids, -degree))
        x = np.array(t.column("coords").to_pylist(), float)[order]
        free, picked = np.ones(len(x), bool), []
        for i in range(len(x)):
            if free[i]:
                picked.append(i)
                free &= np.round(np.sqrt(((x - x[i]) ** 2).sum(1)), 6) > limit
        return t.take(pa.array(order[picked])).append_column("turn", pa.array(np.arange(len(picked), dtype=np.int32)))

    def gather(near: pa.Table, medoids: pa.Table) -> pa.Table:
        medoids = medoids.sort_by("turn")
        x, m = (np.array(t.column("coords").to_pylist(), float) for t in (near, medoids))
        medoid = np.full(near.num_rows, -1)
        for k in range(len(m) if near.num_rows else 0):
            open_ = np.flatnonzero(medoid < 0)
            medoid[open_[np.round(np.sqrt(((x[open_] - m[k]) ** 2).sum(1)), 6) <= limit]] = k
        named = pa.array(np.where(medoid < 0, 0, medoids.column("id").to_numpy()[np.maximum(medoid, 0)]) if near.num_rows else np.zeros(0, int), pa.int64(), mask=medoid < 0)
        return near.drop_columns(["salt"]).append_column("medoid", named)

    rows = "id long, cluster_id long, degree long, coords array<double>"
    order = [F.desc("degree"), F.col("id")]
    while left.head(1):
        sizes = left.groupBy("cluster_id").agg(F.ceil(F.count("*") / MEMBER_ROWS).cast("int").alias("blocks"))
        salted = left.join(sizes, "cluster_id").withColumn("salt", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).drop("blocks")
        part, whole = Window.partitionBy("cluster_id", "salt").orderBy(*order), Window.partitionBy("cluster_id").orderBy(*order)
        top = salted.withColumn("r", F.row_number().over(part)).where(F.col("r") <= candidates)
        top = top.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= candidates).select("id", "cluster_id", "degree", "coords")
        medoids = top.groupBy("cluster_id").applyInArrow(choose, f"{rows}, turn int")
        each = medoids.join(sizes, "cluster_id").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        by = ["cluster_id", "salt"]
        salted = salted.repartition(partitions(points.sparkSession), *by)
        before, named = left, table(salted.groupBy(*by).cogroup(each.groupBy(*by)).applyInArrow(gather, f"{rows}, medoid long"))
        dropped(before)
        done.append(named.where("medoid is not null").select("id", "cluster_id", "medoid"))
        left = named.where("medoid is null").drop("medoid")
    out = left.select("id", "cluster_id", F.lit(None).cast("long").alias("medoid")) if not done else done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
