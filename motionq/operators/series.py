"""Ordered operators over long series, safe for a key that holds a third of all rows.

A series is cut into blocks of its order column. Windows run inside blocks; what a block needs from
those before it (last row, running sum) comes from one summary row per block. So no task sorts more than a
block, and only the summaries of a series are brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motionq.tables import table


def _blocked(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(width)))


def with_previous(df: DataFrame, keys: list[str], order: str, tie: str, columns: list[str], width: int, name: str = "prev") -> DataFrame:
    """Adds struct ``name`` of ``columns`` of the row before in ``(order, tie)``; null for the first of a series.

    Rows without ``order`` are left out. ``width``: span of ``order`` in a block.
    """
    rows = _blocked(df.where(F.col(order).isNotNull()), order, width)
    row = F.struct(*columns)
    inside = Window.partitionBy(*keys, "_block").orderBy(order, tie)
    rows = rows.withColumn(name, F.lag(row).over(inside))
    last = rows.groupBy(*keys, "_block").agg(F.max_by(row, F.struct(order, tie)).alias("_last"))
    carry = last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_block"))).drop("_last")
    joined = _attach(rows, carry, keys)
    kept = [c for c in rows.columns if c not in ("_block", name)]
    return joined.select(*kept, F.coalesce(name, "_carry").alias(name))


def _attach(rows: DataFrame, summary: DataFrame, keys: list[str]) -> DataFrame:
    """The summary of its block for each row; null keys meet."""
    by = [*keys, "_block"]
    named = summary.select(*[F.col(k).alias(f"_by_{k}") for k in by], *[c for c in summary.columns if c not in by])
    cond = None
    for k in by:
        c = F.col(k).eqNullSafe(F.col(f"_by_{k}"))
        cond = c if cond is None else cond & c
    return rows.join(named, cond, "left").drop(*[f"_by_{k}" for k in by])


def running_total(df: DataFrame, keys: list[str], order: str, tie: str, value: Column, width: int, name: str = "total") -> DataFrame:
    """Adds the running sum of ``value`` (null counts as 0) in ``(order, tie)``, and ``name_all``, the sum of the series."""
    rows = _blocked(df.where(F.col(order).isNotNull()), order, width).withColumn("_v", F.coalesce(value, F.lit(0.0)))
    inside = Window.partitionBy(*keys, "_block").orderBy(order, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(name, F.sum("_v").over(inside))
    sums = rows.groupBy(*keys, "_block").agg(F.sum("_v").alias("_s"))
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_block", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_o"), F.sum("_s").over(whole).alias("_all"))
    out = _attach(rows, offsets, keys)
    kept = [c for c in rows.columns if c not in ("_block", "_v", name)]
    return out.select(*kept, (F.col(name) + F.col("_o")).alias(name), F.col("_all").alias(f"{name}_all"))


def chord_parameter(df: DataFrame, keys: list[str], order: str, tie: str, x: str, y: str, width: int) -> DataFrame:
    """Adds ``chord``: cumulative chord length over the length of the whole curve (first 0, last 1; null if that is 0)."""
    step = F.sqrt((F.col(x) - F.col("prev")[x]) * (F.col(x) - F.col("prev")[x]) + (F.col(y) - F.col("prev")[y]) * (F.col(y) - F.col("prev")[y]))
    rows = with_previous(df, keys, order, tie, [x, y], width)
    rows = running_total(rows, keys, order, tie, step, width, "length")
    return rows.withColumn("chord", F.try_divide("length", "length_all")).drop("prev", "length_all")


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with ``name``, the place of a row (from 0) in ``order``; equal values of ``order`` get numbers in some order.

    Range partitions are sorted and numbered on their own, and shifted by the sizes of those before.
    """
    local = F.monotonically_increasing_id()
    rows = table(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", local))  # written: partitions must stay
    rows = rows.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = {r["_part"]: r["n"] for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    at, first = 0, []
    for p in sorted(sizes):
        first.append((p, at))
        at += sizes[p]
    offsets = rows.sparkSession.createDataFrame(first, "_part long, _first long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_at") + F.col("_first")).drop("_part", "_at", "_first")


def running_offsets(df: DataFrame, order: str, count: str, per: int = 4096) -> DataFrame:
    """``(order, offset)``: the sum of ``count`` over the rows before in ``order``; no task sorts them all."""
    rows = numbered(df.select(order, F.coalesce(count, F.lit(0)).cast("long").alias("_n")), order, "_row").withColumn("_block", F.expr(f"_row div {per}"))
    inside = Window.partitionBy("_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("_block").agg(F.sum("_n").alias("_s"))
    upto = Window.partitionBy(F.expr(f"_block div {per}")).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # 16 million rows share a window
    far = blocks.groupBy(F.expr(f"_block div {per}").alias("_far")).agg(F.sum("_s").alias("_t")).orderBy("_far").collect()
    at, table_ = 0, []
    for r in far:
        table_.append((r["_far"], at))
        at += r["_t"]
    starts = df.sparkSession.createDataFrame(table_, "_far long, _start long")
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_s").over(upto), F.lit(0))).withColumn("_far", F.expr(f"_block div {per}")).join(F.broadcast(starts), "_far")
    out = rows.withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(blocks, "_block")
    return out.select(order, (F.col("_own") + F.col("_before") + F.col("_start")).alias("offset"))


def draw(df: DataFrame, order: str, n: int, seed: int) -> DataFrame:
    """``df`` drawn ``n`` times with replacement, with ``draw``, the number of the draw; places in ``order`` are drawn by congruences."""
    rows = numbered(df, order, "_row")
    total = rows.count()
    if not total:
        return df.withColumn("draw", F.lit(0).cast("long")).limit(0)
    x = ((F.col("id") + 1) * 7919 + seed * 104_729) % 2_147_483_647
    place = x * 48_271 % 2_147_483_647 * 16_807 % 2_147_483_647 % total
    return df.sparkSession.range(n).select(F.col("id").alias("draw"), place.alias("_row")).join(rows, "_row").drop("_row")
