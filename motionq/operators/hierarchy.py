"""Hierarchies of units: closure, selection, range semi-join, roll-up, trees from indented text."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motionq.tables import dropped, table

#: Edges up to which the parents of a hierarchy are sent to all tasks (counted), and characters their names may have in all.
SMALL_EDGES, SMALL_CHARACTERS = 200_000, 64_000_000
#: Merged intervals up to which they are searched in memory (counted).
SMALL_UNITS = 100_000


def closure(edges: DataFrame, node: str, parent: str, small: int = SMALL_EDGES) -> DataFrame:
    """``(ancestor, node, depth)``, every node being its own ancestor at depth 0, one row for each path upwards.

    A null parent is a root, a null node is left out, repeated edges count once. Depth is not limited; a cycle raises.
    Up to ``small`` edges are sent to the tasks, which climb them in steps; more are joined by pointer doubling, in as
    many rounds as the depth has binary digits.
    """
    rows = edges.select(F.col(node).alias("n"), F.col(parent).alias("p")).where("n is not null").distinct()
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length(F.col("n").cast("string"))).alias("c")).first()
    if size.n <= small and (size.c or 0) <= SMALL_CHARACTERS:
        return _climbed(rows, edges.schema[node].dataType.simpleString())
    return _doubled(rows, size.n)


def _climbed(rows: DataFrame, kind: str) -> DataFrame:
    got = rows.toArrow()
    up = got.filter(pc.is_valid(got["p"]))
    names = pc.unique(pa.chunked_array([*got["n"].chunks, *up["p"].cast(got["n"].type).chunks], got["n"].type))
    child, above = (pc.index_in(up[c].cast(names.type), names).to_numpy().astype(np.int64) for c in ("n", "p"))
    order = np.argsort(child, kind="stable")
    above, first = above[order], np.searchsorted(child[order], np.arange(len(names) + 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = pc.index_in(batch.column(0), names).to_numpy(zero_copy_only=False).astype(np.int64)
            at, depth = node, 0
            while len(node):
                out = [names.take(pa.array(at)), names.take(pa.array(node)), pa.array(np.full(len(node), depth, np.int32))]
                yield pa.RecordBatch.from_arrays(out, names=["ancestor", "node", "depth"])
                count = first[at + 1] - first[at]
                again = np.repeat(np.arange(len(at)), count)
                place = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
                at, node, depth = above[first[at][again] + place], node[again], depth + 1
                if depth > len(names):
                    raise ValueError("the hierarchy has a cycle")

    return rows.select("n").distinct().mapInArrow(work, f"ancestor {kind}, node {kind}, depth int")


def _doubled(rows: DataFrame, total: int) -> DataFrame:
    jump = table(rows.where("p is not null").select(F.col("n").alias("node"), F.col("p").alias("ancestor")))
    out = rows.select(F.col("n").alias("ancestor"), F.col("n").alias("node"), F.lit(0).alias("depth")).distinct()
    span = 1
    while jump.head(1):
        if span > total:
            raise ValueError("the hierarchy has a cycle")
        far = jump.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"))
        longer = out.join(far, "ancestor").select(F.col("top").alias("ancestor"), "node", (F.col("depth") + span).alias("depth"))
        out = table(out.unionByName(longer))
        before, jump = jump, table(jump.join(far, "ancestor").select("node", F.col("top").alias("ancestor")))
        dropped(before)
        span *= 2
    return out


def leaves(edges: DataFrame, node: str, parent: str) -> DataFrame:
    """Nodes that are nobody's parent."""
    parents = edges.select(F.col(parent).alias(node)).where(F.col(node).isNotNull())
    return edges.select(node).where(F.col(node).isNotNull()).join(parents, node, "left_anti").distinct()


def selected(edges: DataFrame, chosen: Sequence[str], node: str, parent: str, sep: str | None = None) -> DataFrame:
    """``(node)``: the topmost of the chosen nodes; what lies below a chosen node is covered by it.

    With ``sep`` the nodes are paths and their ancestors are read off them; else they come from ``parent``.
    """
    if sep is not None:
        some = set(chosen)
        top = [c for c in some if not any(sep.join(c.split(sep)[:i]) in some for i in range(1, c.count(sep) + 1))]
        return edges.where(F.col(node).isin(top)).select(F.col(node).alias("node")).distinct()
    up = closure(edges, node, parent)
    below = up.where((F.col("depth") > 0) & F.col("ancestor").isin(*chosen)).select("node")
    return edges.where(F.col(node).isin(*chosen)).select(F.col(node).alias("node")).join(below, "node", "left_anti").distinct()


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint intervals in order, from closed ones that may overlap or touch."""
    order = np.argsort(starts, kind="stable")
    a, b = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    first = np.ones(len(a), bool)
    first[1:] = a[1:] > b[:-1] + 1
    return a[first], b[np.append(first[1:], True)] if len(b) else b


def within(rows: DataFrame, units: DataFrame, frame: str, start: str, end: str, small: int = SMALL_UNITS) -> DataFrame:
    """Rows whose ``frame`` lies in at least one unit (ends included), each once: a range semi-join.

    Up to ``small`` units (counted) are merged and searched by bisection; more are cut into aligned blocks of sizes 1, 2, 4
    and so on, of which those inside others are dropped, and joined by block. No row is compared with all units.
    """
    u = units.select(F.col(start).cast("long").alias("a"), F.col(end).cast("long").alias("b")).where("a <= b").distinct()
    few = u.limit(small + 1).toArrow()
    if few.num_rows <= small:
        a, b = merged(few["a"].to_numpy(), few["b"].to_numpy())

        @F.pandas_udf("boolean")
        def inside(f: pd.Series) -> pd.Series:
            if not len(a):
                return pd.Series(np.zeros(len(f), bool))
            x = f.fillna(a[0] - 1).astype("int64").to_numpy()
            at = np.searchsorted(a, x, side="right") - 1
            return pd.Series((at >= 0) & (x <= b[np.maximum(at, 0)]))

        return rows.where(inside(F.col(frame).cast("long")))
    blocks = table(u.select(_aligned("a", "b")).distinct())
    levels = _levels(blocks)
    above = blocks.select("level", "at", _of_levels(levels, "at", F.col("level"))).where("up.level > level")
    covered = above.join(blocks.select(F.struct("level", "at").alias("up")), "up", "left_semi").select("level", "at")
    blocks = blocks.join(covered, ["level", "at"], "left_anti").select(F.struct("level", "at").alias("up"))
    return rows.withColumn("up", F.explode(_places(levels, frame))).join(blocks, "up", "left_semi").drop("up")


def containing(rows: DataFrame, units: DataFrame, frame: str, start: str, end: str) -> DataFrame:
    """Each row with every unit whose range (ends included) holds its ``frame``: an equi-join on aligned blocks.

    A unit of length n makes at most 2 log2(n) blocks, a row as many lookups as there are block sizes.
    """
    blocks = table(units.where(F.col(start) <= F.col(end)).select(*units.columns, _aligned(start, end)))
    by = rows.withColumn("up", F.explode(_places(_levels(blocks), frame))).select("*", "up.level", "up.at").drop("up")
    return by.join(blocks, ["level", "at"]).drop("level", "at")


def _aligned(a: str, b: str):
    lo, hi = f"(-shiftright(-{a}, l))", f"(shiftright({b} + 1, l) - 1)"
    ends = f"array_distinct(filter(array(if({lo} & 1 = 1, {lo}, null), if({hi} & 1 = 0, {hi}, null)), x -> x is not null and {lo} <= {hi}))"
    return F.expr(f"inline(flatten(transform(sequence(0, 62), l -> transform({ends}, i -> named_struct('level', l, 'at', i)))))")


def _levels(blocks: DataFrame) -> list[int]:
    return sorted(r.level for r in blocks.select("level").distinct().collect())  # at most 63


def _places(levels: list[int], frame: str):
    return F.array(*[F.struct(F.lit(l).alias("level"), F.shiftright(F.col(frame).cast("long"), l).alias("at")) for l in levels])


def _of_levels(levels: list[int], at: str, level):
    return F.explode(F.array(*[F.struct(F.lit(l).alias("level"), F.expr(f"shiftright({at}, greatest({l} - level, 0))").alias("at")) for l in levels])).alias("up")


def roll_up(units: DataFrame, node: str, parent: str, start: str, end: str) -> DataFrame:
    """``(node, start, end, leaves)``: least start, greatest end and number of the leaves below each node."""
    low = units.join(leaves(units, node, parent), node, "left_semi").select(F.col(node).alias("node"), start, end)
    up = closure(units, node, parent).select("ancestor", "node")
    out = up.join(low, "node").groupBy("ancestor").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("leaves"))
    return out.withColumnRenamed("ancestor", "node")


def indented(lines: DataFrame, text: str = "line", number: str = "n", file: str = "file") -> DataFrame:
    """``(file, n, name, indent, parent)`` of tree text: the parent is the last line before with less indentation.

    Blank lines are skipped; indentation may be of any width. A tree file is read by one task, which keeps the lines open
    above the current one.
    """
    rows = lines.where(F.trim(text) != "").select(file, number, F.trim(text).alias("name"), (F.length(text) - F.length(F.ltrim(text))).alias("indent"))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(number, kind="stable")
        open_: list[tuple[int, str]] = []
        parents: list[str | None] = []
        for indent, name in zip(pdf["indent"], pdf["name"], strict=True):
            while open_ and open_[-1][0] >= indent:
                open_.pop()
            parents.append(open_[-1][1] if open_ else None)
            open_.append((indent, name))
        return pdf.assign(parent=pd.Series(parents, index=pdf.index, dtype=object))

    return rows.groupBy(file).applyInPandas(work, f"{kinds}, parent string")


def parents_of_paths(paths: DataFrame, path: str = "path", sep: str = "/") -> DataFrame:
    """``(path, parent, name, level)`` of path strings, by their separator."""
    parts = F.split(path, sep)
    parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), sep)
    return paths.select(path, F.when(F.size(parts) > 1, parent).alias("parent"), F.element_at(parts, -1).alias("name"), (F.size(parts) - 1).alias("level"))


def folders(files: DataFrame, path: str = "path", sep: str = "/") -> DataFrame:
    """``(path, parent, level, leaf)`` of all folders on the way to files or leaf folders at ``path``, each once; null paths are left out.

    A folder is a leaf if no other folder lies in it.
    """
    parts = F.split(path, sep)
    above = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.array_join(F.slice("parts", 1, i), sep))
    every = files.where(F.col(path).isNotNull()).select(parts.alias("parts")).select(F.explode(above).alias("path")).distinct()
    rows = parents_of_paths(every, "path", sep).select("path", "parent", "level")
    inner = rows.where("parent is not null").select(F.col("parent").alias("path")).distinct().withColumn("_inner", F.lit(True))
    return rows.join(inner, "path", "left").withColumn("leaf", F.col("_inner").isNull()).drop("_inner")
