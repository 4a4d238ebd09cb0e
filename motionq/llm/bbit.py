"""Near-duplicate records by b-bit MinHash.

A record is the multiset of its values; the j-th occurrence of a value is one token. ``BANDS * ROWS``
minima give the band keys; their two lowest bits, packed into two 64-bit words, are the b-bit
signature. Records (that is, classes of equal multisets) that share a band key are candidates; the
similarity estimated from bit counts, corrected for chance collisions of b bits, drops most; the
rest is verified exactly, and components of the links are the groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motionq.llm import buckets
from motionq.llm import cells as C
from motionq.llm.shared import components, dropped, list_parts, partitions, table

#: A pair of similarity 0.8 shares no band with a chance of 7e-5, one of 0.85 of 2e-6.
BANDS, ROWS = 18, 4
#: Minima of which two bits each are kept; WORDS * 32 of the BANDS * ROWS.
BITS, WORDS = 2, 2
SLOTS = WORDS * 64 // BITS
#: Least bits of a band key, and of a content key in candidate rows: few bytes to shuffle. What meets by
#: chance there is told apart by verification. More rows take more bits (see ``key_bits``).
KEY_BITS = 40
#: Lowest bits of a bucket, which number its band.
BAND_BITS = 6
#: Candidates estimated this far below the threshold are dropped (five standard deviations).
MARGIN = 0.3


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multisets(coords: pa.Array):
    """Yield ``(rows, sorted values)`` of the records with two different non-null values, by size.

    -0.0 counts as 0.0, and all NaN as one value.
    """
    starts, lengths, flat, missing = list_parts(coords)
    flat = np.asarray(flat, float) + 0.0
    if missing.any():
        null = coords.values.is_null().to_numpy(zero_copy_only=False)
        kept = np.concatenate([[0], np.cumsum(~null)])
        starts, flat, lengths = kept[starts], flat[~null], lengths - np.where(lengths > 0, missing, 0)
    for size in np.unique(lengths[lengths > 1]):
        rows = np.flatnonzero(lengths == size)
        x = np.sort(flat[starts[rows][:, None] + np.arange(size)], axis=1)
        bits = x.view(np.uint64)
        bits[np.isnan(x)] = 0x7FF8000000000000
        some = (bits != bits[:, :1]).any(1)
        if some.any():
            yield rows[some], x[some]


def content_key(x: np.ndarray) -> np.ndarray:
    """A 64-bit key of each row of sorted values."""
    bits = x.view(np.uint64)
    key = np.full(len(x), x.shape[1], np.uint64)
    for j in range(x.shape[1]):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + bits[:, j])
    return key.view(np.int64)


def tokens(x: np.ndarray) -> np.ndarray:
    """A 32-bit hash for each value with its occurrence number, columns first (for minima by row)."""
    bits = x.view(np.uint64).T
    out = np.empty(bits.shape, np.uint64)
    run = np.zeros(x.shape[0], np.uint64)
    out[0] = bits[0]
    for j in range(1, len(bits)):
        run = np.where(bits[j] == bits[j - 1], run + np.uint64(1), np.uint64(0))
        out[j] = bits[j] + run * np.uint64(0xD1B54A32D192ED03)
    return _mix(out).astype(np.uint32)


def minima(token: np.ndarray, count: int = BANDS * ROWS, seed: int = 5) -> np.ndarray:
    """``count`` minima of every column of ``token``."""
    rng = np.random.default_rng(seed)
    odd = (rng.integers(0, 2**31, count) * 2 + 1).astype(np.uint32)
    mask = rng.integers(0, 2**32, count, dtype=np.uint32)
    out = np.empty((count, token.shape[1]), np.uint32)
    h, g = np.empty_like(token), np.empty_like(token)
    for k in range(count):
        np.bitwise_xor(token, mask[k], out=h)
        np.multiply(h, odd[k], out=h)
        np.right_shift(h, np.uint32(15), out=g)
        np.bitwise_xor(h, g, out=h)
        np.multiply(h, np.uint32(0x2C1B3C6D), out=h)
        h.min(axis=0, out=out[k])
    return out ^ (out >> np.uint32(16))  # the low bits of a product are poor


def key_bits(rows: int) -> int:
    """Bits of a key with which a row of ``rows`` shares its bucket by chance once in 256 times at most; the band takes the rest."""
    return min(64 - BAND_BITS, max(KEY_BITS, int(rows).bit_length() + 8))


def band_keys(low: np.ndarray, bands: int = BANDS, rows: int = ROWS, width: int = KEY_BITS) -> np.ndarray:
    """Keys of ``width`` bits, one row for each band."""
    out = np.empty((bands, low.shape[1]), np.uint64)
    for b in range(bands):
        key = np.full(low.shape[1], b + 1, np.uint64)
        for r in range(rows):
            key = _mix(key + low[b * rows + r].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[b] = key >> np.uint64(64 - width)
    return out


def signature(low: np.ndarray) -> np.ndarray:
    """The packed low bits: WORDS 64-bit words for each record."""
    out = np.zeros((WORDS, low.shape[1]), np.uint64)
    per = 64 // BITS
    for s in range(SLOTS):
        out[s // per] |= (low[s].astype(np.uint64) & np.uint64(2**BITS - 1)) << np.uint64(s % per * BITS)
    return out.view(np.int64)


def estimate(matches, slots: int = SLOTS, bits: int = BITS):
    """Similarity from the number of equal slots, corrected for chance collisions of ``bits`` bits."""
    chance = 2.0**-bits
    return (matches / slots - chance) / (1 - chance)


def _contents(batches):
    for batch in batches:
        ids = batch.column("id").to_numpy()
        for rows, x in multisets(batch.column("coords")):
            enc, packed = C.pack(x)
            n = np.full(len(rows), x.shape[1], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[rows]), pa.array(content_key(x)), pa.array(n), pa.array(enc), pa.array(packed, pa.binary())],
                names=["id", "k", "n", "enc", "v"],
            )


def _by_size(batch):
    n = batch.column("n").to_numpy()
    enc = batch.column("enc").to_numpy()
    for size in np.unique(n):
        rows = np.flatnonzero(n == size)
        yield rows, C.unpack(enc[rows], batch.column("v").take(pa.array(rows)), int(size))


def _bands(batches, width):
    alias = np.int64((1 << width) - 1)
    for batch in batches:
        k = batch.column("k").to_numpy()
        _, first = np.unique(k, return_index=True)  # copies meet here already
        batch, k = batch.take(pa.array(first)), k[first]
        for rows, x in _by_size(batch):
            keys = band_keys(minima(tokens(x)), width=width)
            high = keys << np.uint64(64 - width) | np.arange(BANDS, dtype=np.uint64)[:, None]
            high = high.view(np.int64)  # zero bytes together: compresses better
            yield pa.RecordBatch.from_arrays([pa.array(high.ravel()), pa.array(np.tile(k[rows] & alias, BANDS))], names=["bucket", "k"])


def _signed(batches):
    for batch in batches:
        for rows, x in _by_size(batch):
            words = signature(minima(tokens(x)))
            part = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, words)], names=[*part.schema.names, "s0", "s1"])


SIGNED = "k long, n int, enc tinyint, v binary, s0 long, s1 long"


def matching(s0, s1, t0, t1) -> np.ndarray:
    """Number of equal slots of signatures."""
    odd = np.uint64(0x5555555555555555)
    apart = np.zeros(np.broadcast_shapes(s0.shape, t0.shape), np.uint8)
    for s, t in ((s0, t0), (s1, t1)):
        x = s.view(np.uint64) ^ t.view(np.uint64)
        apart += np.bitwise_count((x | (x >> np.uint64(1))) & odd)
    return SLOTS - apart.astype(int)


def shared_values(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Size of the multiset intersection of sorted ``x[i]`` and ``y[i]``, exactly."""
    if not len(x):
        return np.zeros(0, int)
    flat = np.concatenate([*x, *y])
    bits = flat.view(np.uint64)
    _, code = np.unique(bits, return_inverse=True)
    owner = np.repeat(np.tile(np.arange(len(x)), 2), [*map(len, x), *map(len, y)])
    side = np.arange(len(flat)) >= sum(map(len, x))
    order = np.lexsort((side, code, owner))
    owner, code, side = owner[order], code[order], side[order]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])])
    run = np.cumsum(new) - 1
    right = np.bincount(run, side)
    left = np.bincount(run) - right
    return np.bincount(owner[new], np.minimum(left, right), minlength=len(x)).astype(int)


def _unpacked(enc, v, n) -> list[np.ndarray]:
    out: list = [None] * len(n)
    for size in np.unique(n):
        at = np.flatnonzero(n == size)
        for i, row in zip(at, C.unpack(enc[at], v.take(pa.array(at)), int(size)), strict=True):
            out[i] = row
    return out


def _verified(batches, threshold):
    for batch in batches:
        if not batch.num_rows:
            continue
        col = lambda name, at=batch: at.column(name).to_numpy()
        na, nb = col("n_a"), col("n_b")
        both = shared_values(_unpacked(col("enc_a"), batch.column("v_a"), na), _unpacked(col("enc_b"), batch.column("v_b"), nb))
        ok = both >= threshold * (na + nb - both) - 1e-9
        yield pa.RecordBatch.from_arrays([pa.array(col("a")[ok]), pa.array(col("b")[ok])], names=["a", "b"])


def _alias(width: int) -> Column:
    return F.col("k").bitwiseAND(F.lit((1 << width) - 1))


def signed(pairs: DataFrame, contents: DataFrame, width: int = KEY_BITS) -> DataFrame:
    """Contents, with signature and alias ``p``, of all that occurs in candidate ``pairs`` of aliases."""
    nodes = pairs.select(F.col("a").alias("p")).union(pairs.select(F.col("b").alias("p"))).distinct()
    known = contents.select("k", "n", "enc", "v", _alias(width).alias("p"))
    known = known.join(nodes, "p", "left_semi").dropDuplicates(["p", "k"])  # p is part of k: no further shuffle
    known = known.select("k", "n", "enc", "v").mapInArrow(_signed, SIGNED)
    return table(known.withColumn("p", _alias(width)))


def verify(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The links ``(a, b)`` of content keys among candidate ``pairs`` of aliases: bit counts first, then exactly."""
    few, full = ["s0", "s1", "n"], ["n", "enc", "v"]
    side = lambda s, by, names: known.select(F.col(by).alias(s), *[F.col(x).alias(f"{x}_{s}") for x in names])
    odd = F.lit(0x5555555555555555)
    differ = sum(
        (F.bit_count((x.bitwiseOR(F.shiftrightunsigned(x, 1))).bitwiseAND(odd)) for s in ("s0", "s1") for x in [F.col(f"{s}_a").bitwiseXOR(F.col(f"{s}_b"))]),
        F.lit(0),
    )
    likely = pairs.join(side("a", "p", ["k", *few]), "a").join(side("b", "p", ["k", *few]), "b")
    likely = likely.where(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)
    likely = likely.where((estimate(SLOTS - differ) >= threshold - MARGIN) & F.expr("k_a <> k_b")).select(F.col("k_a").alias("a"), F.col("k_b").alias("b"))
    whole = likely.join(side("a", "k", full), "a").join(side("b", "k", full), "b")
    return whole.mapInArrow(lambda it: _verified(it, threshold), "a long, b long")


#: Longest lists that are compared as padded rows of hashes before they are compared exactly.
PADDED = 256
#: Pairs of a block that are verified at once.
STEP = 4_000


def padded_tokens(enc, v, n) -> np.ndarray | None:
    """A row of 64-bit hashes of (value, occurrence) for each list, filled up with hashes that occur in no other row."""
    width = int(n.max(initial=0))
    if width > PADDED:
        return None
    out = _mix(np.arange(len(n) * width, dtype=np.uint64).reshape(len(n), width) + np.uint64(0x632BE59BD9B4E019))
    for size in np.unique(n):
        at = np.flatnonzero(n == size)
        bits = C.unpack(enc[at], v.take(pa.array(at)), int(size)).view(np.uint64)
        run = np.zeros(bits.shape, np.uint64)
        for j in range(1, int(size)):
            run[:, j] = np.where(bits[:, j] == bits[:, j - 1], run[:, j - 1] + np.uint64(1), np.uint64(0))
        out[at[:, None], np.arange(size)] = _mix(bits + run * np.uint64(0xD1B54A32D192ED03))
    return out


def at_most_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Number of hashes that rows of ``padded_tokens`` share: no fewer than the values they share."""
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    return np.count_nonzero(both[:, 1:] == both[:, :-1], axis=1)


def _roots(parent: np.ndarray) -> np.ndarray:
    roots = parent
    while not np.array_equal(further := parent[roots], roots):
        roots = further
    return roots


def _link(t: pa.Table, left: np.ndarray, right: np.ndarray, threshold: float, earlier: np.ndarray | None = None) -> pa.Table:
    """Links that join different components, of rows ``left`` with rows ``right``; at most one fewer than there are components.

    ``earlier``: the large buckets of each row in earlier bands; pairs that share one are compared there.

    Pairs are verified likeliest first, and no more once their ends are joined by others: in a dense group nearly
    every record needs one verification only.
    """
    col = lambda name: t.column(name).to_numpy()
    k, n, s0, s1, enc, v = col("k"), col("n"), col("s0"), col("s1"), col("enc"), t.column("v").combine_chunks()
    hashes = padded_tokens(enc, v, n)
    names, name = np.unique(col("root"), return_inverse=True)
    parent = np.arange(len(names))
    links: list = []
    for some in np.array_split(left, max(1, len(left) * len(right) // 1_000_000)):
        m = matching(s0[some][:, None], s1[some][:, None], s0[right][None], s1[right][None])
        root = _roots(parent)[name]
        open_ = (estimate(m) >= threshold - MARGIN) & (root[some][:, None] != root[right][None])
        for own in earlier if earlier is not None else ():
            open_ &= own[some][:, None] != own[right][None]
        a, b = np.nonzero(open_)
        order = np.argsort(-m[a, b], kind="stable")
        a, b = some[a[order]], right[b[order]]
        while len(a):
            p, q = a[:STEP], b[:STEP]
            if hashes is not None:
                both = at_most_shared(hashes[p], hashes[q])
                maybe = both >= threshold * (n[p] + n[q] - both) - 1e-9
                p, q = p[maybe], q[maybe]
            both = shared_values(_unpacked(enc[p], v.take(pa.array(p)), n[p]), _unpacked(enc[q], v.take(pa.array(q)), n[q]))
            ok = both >= threshold * (n[p] + n[q] - both) - 1e-9
            for x, y in zip(p[ok].tolist(), q[ok].tolist(), strict=True):
                i, j = name[x], name[y]
                while parent[i] != i:
                    i = parent[i]
                while parent[j] != j:
                    j = parent[j]
                if i != j:
                    parent[max(i, j)] = min(i, j)
                    links.append((k[x], k[y]))
            root = _roots(parent)[name]
            open_ = root[a[STEP:]] != root[b[STEP:]]
            a, b = a[STEP:][open_], b[STEP:][open_]
    return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})


def _in_block(t: pa.Table, threshold: float) -> pa.Table:
    every = np.arange(t.num_rows)
    return _link(t.combine_chunks(), every, every, threshold)


def _to_block(t: pa.Table, threshold: float) -> pa.Table:
    """Links of the rows that came from elsewhere with those of the block."""
    t = t.combine_chunks()
    guest = t.column("guest").to_numpy(zero_copy_only=False)
    starts, sizes, flat, _ = list_parts(t.column("hots"))
    band = t.column("bucket")[0].as_py() & ((1 << BAND_BITS) - 1)
    row = np.repeat(np.arange(len(sizes)), sizes)
    hots = flat[np.repeat(starts, sizes) + np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
    earlier = np.tile(-np.arange(1, len(sizes) + 1, dtype=np.int64), (band, 1))  # none: shared with nobody
    bands = hots & ((1 << BAND_BITS) - 1)
    before = bands < band
    earlier[bands[before], row[before]] = hots[before]
    return _link(t, np.flatnonzero(guest), np.flatnonzero(~guest), threshold, earlier)


def near_duplicates(points: DataFrame, threshold: float = 0.8, big: int = buckets.BIG, block: int = buckets.BLOCK) -> DataFrame:
    """``(id, group_id)`` of the records in groups of two or more ids; ``group_id`` is the smallest id.

    Similarity is shared over all values of ``coords`` with multiplicity, regardless of position.
    Null coords, null ids, and records without two different values have no rows; null values are
    skipped. Repeated deliveries count once (an id with several contents is in the group of
    each, listed under the smallest). Only ``id`` and ``coords`` are read.

    Equal contents are one node from the start. A bucket of more than ``big`` nodes is linked to its
    smallest node first; what stays in different components is then compared in blocks, in place.
    """
    contents = table(points.where("id is not null").select("id", "coords").mapInArrow(_contents, "id long, k long, n int, enc tinyint, v binary"))
    total = contents.count()
    width = key_bits(total * BANDS)
    keyed = contents.select("k", "n", "enc", "v")
    banded = lambda df: df.mapInArrow(lambda it: _bands(it, width), "bucket long, k long")
    found = table(buckets.collide(banded(keyed), total * BANDS, big=big, crowded=buckets.crowds(keyed, banded, total, big)))
    pairs = found.where("bucket is null").select("a", "b")
    large = found.where("bucket is not null").select("bucket", F.col("a").alias("p"))
    some = bool(large.head(1))
    if some:
        star = large.join(large.groupBy("bucket").agg(F.min("p").alias("q")), "bucket").where("p <> q")
        pairs = pairs.unionByName(star.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")))
    pairs = table(pairs.distinct())
    known = signed(pairs, contents, width)
    links = table(verify(pairs, known, threshold))
    if some:
        links = links.unionByName(_inside(large, links, known, threshold, block))
    dropped(found, pairs, known)
    roots = components(links).select(F.col("id").alias("k"), "root")
    classes = contents.groupBy("k").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    tied = classes.join(roots, "k", "left").where("root is not null or lo < hi")  # the others are alone
    tied = table(tied.select("k", F.coalesce("root", "k").alias("root"), "lo", "hi"))
    groups = tied.groupBy("root").agg(F.min("lo").alias("group_id"), F.max("hi").alias("last")).where("group_id < last")
    named = tied.select("k", "root").join(groups, "root").select("k", "group_id")
    return contents.select("id", "k").join(named, "k").groupBy("id").agg(F.min("group_id").alias("group_id"))


def _inside(large: DataFrame, links: DataFrame, known: DataFrame, threshold: float, block: int) -> DataFrame:
    """Further links inside the large buckets that hold several components.

    First every bucket is cut into blocks of about ``block`` nodes, each searched for itself, which joins
    nearly all of a dense group. Then, in buckets of several blocks, the nodes outside the largest component (the guests) visit all
    blocks, in groups of a block's size, so that every pair of different components has met. Pairs that share large
    buckets in several bands are compared in the first of them.
    """
    count = large.groupBy("bucket").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    named_ = large.join(known.select("p", "k"), "p").join(count, "bucket")
    rows = table(named_.select("bucket", "k", "blocks", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("o")))
    contents = known.drop("p")  # joined only to what is compared

    def mixed(links: DataFrame) -> DataFrame:
        roots = components(links).select(F.col("id").alias("k"), "root")
        named = table(rows.join(roots, "k", "left").withColumn("root", F.coalesce("root", "k")))
        sizes = named.groupBy("bucket", "root").agg(F.count("*").alias("size"))
        first = sizes.groupBy("bucket").agg(
            F.max_by("root", F.struct("size", "root")).alias("largest"), F.count("*").alias("roots"), F.ceil((F.sum("size") - F.max("size")) / block).cast("int").alias("groups")
        )
        return named.join(first.where("roots > 1").drop("roots"), "bucket")

    schema = "a long, b long"
    first = mixed(links)
    many = partitions(large.sparkSession, -(-rows.count() // block))  # given, or small blocks would be worked by few tasks
    found = table(first.drop("largest", "groups", "blocks").join(contents, "k").repartition(many, "bucket", "o").groupBy("bucket", "o").applyInArrow(lambda t: _in_block(t, threshold), schema))
    if not rows.where("blocks > 1").head(1):  # every bucket was one block: all its pairs have met
        dropped(rows)
        return found
    mixed_ = named = table(mixed(links.unionByName(found)).where("blocks > 1"))
    hots = named.groupBy("k").agg(F.collect_set("bucket").alias("hots"))  # at most one a band
    named = named.join(hots, "k").join(contents, "k")
    guests = named.where("root <> largest").withColumns({"o": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)), "g": F.pmod(F.xxhash64("k", F.lit(1)), F.col("groups")).cast("int")})
    hosts = named.withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    visits = guests.withColumn("guest", F.lit(True)).unionByName(hosts.withColumn("guest", F.lit(False))).drop("largest", "blocks", "groups")
    more = table(visits.repartition(many, "bucket", "o", "g").groupBy("bucket", "o", "g").applyInArrow(lambda t: _to_block(t, threshold), schema))
    dropped(rows, mixed_)
    return found.unionByName(more)
