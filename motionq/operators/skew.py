"""Joins on keys of which a few may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the sample that shows hot keys, how many of them must share one, most such keys, and parts of each.
SAMPLE_ROWS, LEAST, MOST_KEYS, PARTS = 20_000, 40, 1_000, 32


def hot_keys(rows: DataFrame, key: list[str], id_: list[str], total: int, sample_rows: int = SAMPLE_ROWS, least: int = LEAST) -> list[int]:
    """Hashes of the keys that many of a bounded sample of ``rows``, drawn by a hash of ``id_``, have.

    Where rows go depends on them, never the result of a join.
    """
    share = min(1.0, sample_rows / max(total, 1))
    some = rows.where(F.pmod(F.xxhash64(*id_, F.lit(13)), F.lit(1 << 30)) <= int(share * (1 << 30)))
    n = some.groupBy(F.xxhash64(*key).alias("h")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return sorted(r.h for r in n.orderBy(F.desc("n"), "h").limit(MOST_KEYS).collect())


def join(rows: DataFrame, asking: DataFrame, key: list[str], id_: list[str], hot: list[int], parts: int = PARTS) -> DataFrame:
    """The inner join of ``rows`` with ``asking`` on ``key``; rows of ``hot`` keys are spread over ``parts``, what asks for them is repeated."""
    if not hot:
        return asking.join(rows, key)
    crowded = F.xxhash64(*key).isin(hot)
    spread = rows.withColumn("_part", F.when(crowded, F.pmod(F.xxhash64(*id_), F.lit(parts)).cast("int")).otherwise(0))
    every = F.explode(F.when(crowded, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0))))
    return asking.withColumn("_part", every).join(spread, [*key, "_part"]).drop("_part")
