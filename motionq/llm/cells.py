"""Overlapping Voronoi cells: an exchange that brings every pair of vectors within a radius together.

Centres come from a bounded sample; every row is assigned to the cell of its nearest centre and
copied into each further cell whose border is within the radius. A pair within the radius then
meets in the home cell of either end, whatever the centres are (the segment between the two
crosses the bisecting plane). Cells that hold too many rows are divided in the same way by centres of
their own, so neither the rows of a cell nor the centres a row is compared with grow with the data. Rows travel in the narrowest exact form (hundredths as 16 or 32
bit integers, else doubles).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionq.llm.shared import list_parts, partitions, rows_of, table

#: Rows of the sample that the centres are fitted on, over all dimensions together; most centres of a dimension.
SAMPLE_ROWS, MOST_CENTRES = 20_000, 512
#: Rows that a cell should hold; one of more than HOT_ROWS is divided again, and what stays so large is worked in pairs of blocks.
CELL_ROWS, HOT_ROWS = 6_000, 48_000
#: Sample rows for each centre inside a divided cell, rows of it that one task routes, and most centres there.
SAMPLE_A_CENTRE, SLICE_ROWS, MOST_INSIDE = 8, 200_000, 4_096
#: Copies of a row in all, on average over the sample, beyond which fewer centres are taken.
MOST_COPIES = 4.0
#: Cells are numbered outer * INSIDE + inner.
INSIDE = 1 << 20
SCHEMA = "dim int, cell long, part int, id long, role tinyint, enc tinyint, v binary, bound double"
QUERY, DATA = 1, 2


@dataclass
class Cells:
    """Centres by dimension, slices of each cell to be divided (0: it is not), and the divisions.

    ``inner``: ``(dim, cell, centres, blocks)`` of the divided cells, packed; None if there are none.
    """

    radius: float
    centres: dict[int, np.ndarray] = field(default_factory=dict)
    slices: dict[int, np.ndarray] = field(default_factory=dict)
    inner: DataFrame | None = None
    expected: int = 1


def usable(ids: np.ndarray, dimension: np.ndarray, coords: pa.Array):
    """Yield ``(width, rows, matrix)`` of the usable records of a batch, by number of coordinates.

    Usable: not null, exactly ``dimension`` values, none null (nor NaN or infinite), not all the same.
    """
    starts, lengths, flat, missing = list_parts(coords)
    good = (lengths == dimension) & (lengths > 0) & (missing == 0)
    for width in np.unique(lengths[good]):
        rows = np.flatnonzero(good & (lengths == width))
        x = rows_of(flat, starts[rows], int(width))
        keep = np.isfinite(x).all(1) & (x != x[:, :1]).any(1)
        if keep.any():
            yield int(width), rows[keep], x[keep] + 0.0


def pack(x: np.ndarray) -> tuple[np.ndarray, list]:
    """Bytes of each row in the narrowest exact form; ``enc`` is the bytes of a value."""
    with np.errstate(over="ignore", invalid="ignore"):
        cents = np.rint(x * 100)
        exact = ((cents / 100) == x).all(1)
    top = np.abs(cents).max(1)
    enc = np.where(exact & (top < 2**15), 2, np.where(exact & (top < 2**31), 4, 8)).astype(np.int8)
    out = np.empty(len(x), object)
    for size, kind in ((2, "<i2"), (4, "<i4"), (8, "<f8")):
        at = np.flatnonzero(enc == size)
        if len(at):
            raw = (x[at] if size == 8 else cents[at]).astype(kind).tobytes()
            step = size * x.shape[1]
            out[at] = [raw[i : i + step] for i in range(0, len(raw), step)]
    return enc, out


def unpack(enc: np.ndarray, packed: pa.Array, width: int) -> np.ndarray:
    x = np.empty((len(enc), width))
    if isinstance(packed, pa.ChunkedArray):
        packed = packed.combine_chunks()
    for size, kind in ((2, "<i2"), (4, "<i4"), (8, "<f8")):
        at = np.flatnonzero(enc == size)
        if len(at):
            raw = b"".join(packed.take(pa.array(at)).to_pylist())
            part = np.frombuffer(raw, kind).reshape(len(at), width)
            x[at] = part if size == 8 else part / 100
    return x


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows by the product form (rounding: see ``slack``)."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0)


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    step = max(1, 4_000_000 // len(centres))
    return np.concatenate([squared(x[i : i + step], centres).argmin(1) for i in range(0, len(x), step)]) if len(x) else np.zeros(0, int)


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        home = nearest_centre(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        count = np.bincount(home, minlength=k)
        some = count > 0
        centres[some] = sums[some] / count[some, None]
    return centres


def border(d2: np.ndarray, home: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distance of each row to the plane between its home centre and every centre (0 for home)."""
    apart = np.sqrt(squared(centres, centres))
    np.fill_diagonal(apart, 1)
    gap = d2 - d2[np.arange(len(d2)), home][:, None]
    return gap / (2 * np.maximum(apart[home], 1e-12))


def reached(x: np.ndarray, centres: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(row, cell, is home)`` of the home of each row and all cells whose border is within ``reach`` of it."""
    out = []
    step = max(1, 2_000_000 // len(centres))
    for i in range(0, len(x), step):
        part = x[i : i + step]
        d2 = squared(part, centres)
        home = d2.argmin(1)
        slack = 1e-9 + 1e-12 * (part * part).sum(1)
        near = border(d2, home, centres) <= (reach[i : i + step] * (1 + 1e-9) + slack)[:, None]
        near[np.arange(len(part)), home] = True
        at, cell = np.nonzero(near)
        out.append((at + i, cell, home[at] == cell))
    if not out:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
    return tuple(np.concatenate(a) for a in zip(*out, strict=True))


def spread(x: np.ndarray, k: int, radius: float) -> np.ndarray:
    """``k`` centres, or fewer where so many would copy rows too often: a tight neighbourhood is no better for being cut."""
    while True:
        centres = kmeans(x, k) if k > 1 else x.mean(0, keepdims=True)
        if k < 2 or len(reached(x, centres, np.full(len(x), radius))[0]) <= MOST_COPIES * len(x):
            return centres
        k //= 2


def fit(points: DataFrame, radius: float, sample_rows: int = SAMPLE_ROWS, cell_rows: int = CELL_ROWS, hot_rows: int = HOT_ROWS, most: int = MOST_CENTRES) -> Cells:
    """Centres from a sample of at most about ``sample_rows`` rows, chosen by a hash of the id.

    At most ``most`` for a dimension, so that routing a row stays cheap; cells expected to hold more than ``hot_rows`` are
    divided by centres of their own, which are fitted in tasks and never come to the driver. Two levels serve some
    10 ** 10 rows of a dimension.
    """
    total = points.count()
    share = min(1.0, sample_rows / max(total, 1))
    cells = Cells(radius, expected=total)
    chosen = points.select("id", "dimension", "coords")
    if share < 1:
        chosen = chosen.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    if total <= cell_rows:
        return cells
    got = chosen.toArrow()
    dimension = np.asarray(got.column("dimension").to_numpy(zero_copy_only=False), float)
    deep = False
    for width, _, x in usable(got.column("id").to_numpy(zero_copy_only=False), dimension, got.column("coords")):
        k = min(int(np.ceil(len(x) / share / cell_rows)), len(x) // 4, most)
        cells.centres[width] = centres = spread(x, max(k, 1), radius)
        mass = np.bincount(nearest_centre(x, centres), minlength=len(centres)) / share
        cells.slices[width] = np.where(mass > hot_rows, np.ceil(mass / SLICE_ROWS), 0).astype(np.int64)
        deep |= bool(cells.slices[width].any())
    if deep:
        cells.inner = _divide(points, cells, cell_rows, hot_rows)
    return cells


def _divide(points: DataFrame, cells: Cells, cell_rows: int, hot_rows: int) -> DataFrame:
    share = min(1.0, SAMPLE_A_CENTRE / cell_rows)
    some = points.where("id is not null").select("id", "dimension", "coords")
    some = some.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    homes = some.mapInArrow(lambda it: _route(it, cells, "answer", True), SCHEMA).dropDuplicates(["dim", "cell", "id"])

    def divide(t: pa.Table) -> pa.Table:
        width, cell = t.column("dim")[0].as_py(), t.column("cell")[0].as_py()
        order = np.argsort(t.column("id").to_numpy(), kind="stable")
        x = unpack(t.column("enc").to_numpy(), t.column("v"), width)[order]
        k = max(1, min(int(np.ceil(len(x) / share / cell_rows)), len(x) // 4, MOST_INSIDE))
        centres = spread(x, k, cells.radius)
        mass = np.bincount(nearest_centre(x, centres), minlength=len(centres)) / share
        blocks = np.maximum(1, np.ceil(mass / hot_rows)).astype("<i4")
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.table({n: pa.array([v], kind) for n, v, kind in zip(("dim", "cell", "centres", "blocks"), (width, cell, centres.astype("<f8").tobytes(), blocks.tobytes()), kinds, strict=True)})

    return table(homes.groupBy("dim", "cell").applyInArrow(divide, "dim int, cell long, centres binary, blocks binary"))


def _rows(width, ids, at, cell, part, role, enc, packed, bound) -> pa.RecordBatch:
    columns = [np.full(len(at), width, np.int32), np.asarray(cell, np.int64), np.asarray(part, np.int32), ids[at].astype(np.int64), np.asarray(role, np.int8), enc[at]]
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(packed[at], pa.binary()), pa.array(bound[at])], names=[f.split()[0] for f in SCHEMA.split(", ")])


def _reach(x, centres, kind: str, bound: np.ndarray):
    """Where the rows go for a purpose: ``meet`` (home asks and answers, copies answer), ``ask`` (all within the bound), ``answer`` (home only)."""
    if len(centres) == 1:
        at, cell, home = np.arange(len(x)), np.zeros(len(x), int), np.ones(len(x), bool)
    elif kind == "answer":
        at, cell, home = np.arange(len(x)), nearest_centre(x, centres), np.ones(len(x), bool)
    else:
        at, cell, home = reached(x, centres, bound)
    return at, cell, home


def _route(batches, cells: Cells, kind: str, deep: bool | None):
    """Rows of SCHEMA by outer cell; ``deep``: of the divided cells only (their slice as part), or of the others only."""
    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False)
        dimension = np.asarray(batch.column("dimension").to_numpy(zero_copy_only=False), float)
        given = batch.column("bound").to_numpy() if "bound" in batch.schema.names else np.full(len(ids), cells.radius)
        for width, rows, x in usable(ids, dimension, batch.column("coords")):
            centres, slices = cells.centres.get(width, x[:1]), cells.slices.get(width, np.zeros(1, np.int64))
            at, cell, home = _reach(x, centres, kind, given[rows])
            role = np.full(len(at), QUERY) if kind == "ask" else np.where(home, QUERY | DATA, DATA) if kind == "meet" else np.full(len(at), DATA)
            part = np.full(len(at), -1)
            if deep is not None:
                use = (slices[cell] > 0) == deep
                at, cell, role, part = at[use], cell[use], role[use], part[use]
            if deep:
                part = _mixed(ids[rows][at]) % slices[cell]
            if len(at):
                enc, packed = pack(x)
                yield _rows(width, ids[rows], at, cell * INSIDE, part, role, enc, packed, given[rows])


def _mixed(ids: np.ndarray) -> np.ndarray:
    """A hash of ids that doesn't go with their remainders."""
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) >> np.uint64(8)).astype(np.int64)


def _inside(left: pa.Table, right: pa.Table, cells: Cells, kind: str) -> pa.Table:
    """A slice of a divided cell on to its inner cells; part -1, or the block pair where an inner cell is still hot."""
    schema = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "tinyint": pa.int8(), "binary": pa.binary(), "double": pa.float64()}[k]) for n, k in (f.split() for f in SCHEMA.split(", "))])
    if not left.num_rows:
        return schema.empty_table()
    left = left.combine_chunks()
    width, outer = left.column("dim")[0].as_py(), left.column("cell")[0].as_py()
    ids, was, enc, bound = (left.column(c).to_numpy() for c in ("id", "role", "enc", "bound"))
    x = unpack(enc, left.column("v"), width)
    if right.num_rows:
        centres = np.frombuffer(right.column("centres")[0].as_py(), "<f8").reshape(-1, width)
        blocks = np.frombuffer(right.column("blocks")[0].as_py(), "<i4").astype(np.int64)
    else:  # the sample had nothing of the cell
        centres, blocks = x[:1], np.ones(1, np.int64)
    at, cell, home = _reach(x, centres, kind, bound)
    role = np.where(home, was[at], was[at] & DATA) if kind == "meet" else was[at]
    part = np.full(len(at), -1)
    if (blocks > 1).any():
        at, cell, part, role = _spread(at, cell, role, ids, blocks) if kind == "meet" else _blocked(at, cell, role, ids, blocks, kind)
    packed = np.array(left.column("v").to_pylist(), object)
    return pa.Table.from_batches([_rows(width, ids, at, outer + cell, part, role, enc, packed, bound)], schema)


def _spread(at, cell, role, own, blocks):
    """Rows of hot cells to all pairs (block of the asking row, block of the answering row)."""
    b = blocks[cell]
    block = _mixed(own[at]) % b
    calm = b == 1
    out = [(at[calm], cell[calm], np.full(calm.sum(), -1), role[calm])]
    for n in np.unique(b[~calm]):
        hot = np.flatnonzero(b == n)
        mine, asks = block[hot], (role[hot] & QUERY) > 0
        for j in range(n):
            use, m = hot[asks], mine[asks]
            out.append((at[use], cell[use], m * n + j, np.where(m == j, QUERY | DATA, QUERY)))
            rest = ~(asks & (mine == j))
            use, m = hot[rest], mine[rest]
            out.append((at[use], cell[use], j * n + m, np.full(len(use), DATA)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _blocked(at, cell, role, own, blocks, kind):
    """Answering rows of hot cells to their block, asking rows to all blocks."""
    b = blocks[cell]
    if kind == "answer":
        return at, cell, np.where(b > 1, _mixed(own[at]) % b, -1), role
    again = np.repeat(np.arange(len(at)), b)
    place = np.arange(len(again)) - np.repeat(np.cumsum(b) - b, b)
    return at[again], cell[again], np.where(b[again] > 1, place, -1), role[again]


def route(points: DataFrame, cells: Cells, kind: str) -> DataFrame:
    """Rows of SCHEMA by cell for a purpose (see ``_reach``); ``points`` may have a ``bound`` of each row in place of the radius."""
    rows = points.select("id", "dimension", "coords", *[c for c in points.columns if c == "bound"]).where("id is not null")
    inner, cells = cells.inner, replace(cells, inner=None)  # what tasks get
    if inner is None:
        return rows.mapInArrow(lambda it: _route(it, cells, kind, None), SCHEMA)
    flat = [(d, int(c) * INSIDE, s) for d, n in cells.slices.items() for c in np.flatnonzero(n) for s in range(n[c])]
    where = points.sparkSession.createDataFrame(flat, "dim int, cell long, part int")  # one row a slice
    inner = where.join(inner, ["dim", "cell"])
    by = ["dim", "cell", "part"]
    deep = rows.mapInArrow(lambda it: _route(it, cells, kind, True), SCHEMA).groupBy(*by).cogroup(inner.groupBy(*by))
    deep = deep.applyInArrow(lambda left, right: _inside(left, right, cells, kind), SCHEMA)
    return rows.mapInArrow(lambda it: _route(it, cells, kind, False), SCHEMA).unionByName(deep)


def assign(points: DataFrame, cells: Cells) -> DataFrame:
    """Rows of SCHEMA for records to meet, hash partitioned by cell and block pair, ready for a grouped map."""
    n = partitions(points.sparkSession, sum(len(c) for c in cells.centres.values()) if cells.inner is None else cells.expected // CELL_ROWS)
    return route(points.select("id", "dimension", "coords"), cells, "meet").drop("bound").repartition(n, "dim", "cell", "part")


def group(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, roles and vectors of a cell; repeated deliveries of an id with equal content once."""
    width = rows.column("dim")[0].as_py()
    ids, role = rows.column("id").to_numpy(), rows.column("role").to_numpy()
    x = unpack(rows.column("enc").to_numpy(), rows.column("v"), width)
    order = np.lexsort((-role, ids))
    ids, role, x = ids[order], role[order], x[order]
    again = np.zeros(len(ids), bool)
    again[1:] = (ids[1:] == ids[:-1]) & (x[1:] == x[:-1]).all(1)
    return ids[~again], role[~again], x[~again]
