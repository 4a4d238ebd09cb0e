"""Incremental scoring with Structured Streaming: accumulation with reset, changed patches, windows, index inserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from motionq.operators import lsh
from motionq.operators.series import with_previous
from motionq.tables import fresh


def accumulate(votes: DataFrame, key: str, order: list[str], score: str, reset: str) -> DataFrame:
    """``(key, score, n)`` after each micro-batch: scores added up per key since its last reset.

    ``reset`` is a boolean column: such a row clears the sum and adds nothing. Rows of a micro-batch are taken in
    ``order``; the state of a key is two numbers. Null scores count as 0.
    """
    kind = votes.schema[key].dataType.simpleString()

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n = state.get if state.exists else (0.0, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        last = rows[reset].fillna(False).to_numpy(bool).nonzero()[0]
        if len(last):
            total, n, rows = 0.0, 0, rows.iloc[last[-1] + 1 :]
        total, n = total + float(rows[score].fillna(0).sum()), n + len(rows)
        state.update((total, n))
        yield pd.DataFrame({key: [k[0]], "score": [total], "n": [n]})

    rows = votes.select(key, *order, F.col(score).alias(score), F.col(reset).alias(reset))
    return rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, score double, n long", "score double, n long", "update", GroupStateTimeout.NoTimeout)


def running(votes: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Sums per key over the whole stream, in the JVM; for complete or update mode."""
    return votes.groupBy(*keys).agg(F.sum(score).alias("score"), F.count("*").alias("n"))


def changed(strokes: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first row of each key within the watermark: what has to be scored again."""
    return strokes.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windows(votes: DataFrame, time: str, width: str, keys: list[str], score: str, late: str, slide: str | None = None) -> DataFrame:
    """``(start, keys, score, n)`` per tumbling or sliding window; rows later than ``late`` are dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = votes.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(F.sum(score).alias("score"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "score", "n")


def latest(sink: DataFrame, key: str, value: str = "n") -> DataFrame:
    """The last state per key of an update-mode sink that kept all updates with a ``batch`` number."""
    return sink.groupBy(key).agg(F.max_by(F.struct(*[c for c in sink.columns if c not in (key, "batch")]), "batch").alias("s")).select(key, "s.*")


def insert_into_index(points: DataFrame, plan: lsh.Plan, key: str, vector: str, path: str, checkpoint: str, **trigger):
    """Start a query that appends the bucket rows of every micro-batch to the table at ``path``.

    Each batch goes to a folder of its own number, overwritten if the batch is repeated: exactly once.
    """

    def append(batch: DataFrame, number: int) -> None:
        lsh.bucket_table(batch, plan, key, vector).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return points.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def drained(df: DataFrame, mode: str, key: str | None = None) -> DataFrame:
    """Run a stream over all that is there, into tables of the shared folder, and give its result.

    ``append``: all rows; ``complete``: those of the last batch; ``update``: the last row of each ``key``. Batches are
    written under their numbers, so a repeated one counts once; state and progress lie in the shared folder too.
    """
    path, checkpoint = fresh(df.sparkSession), fresh(df.sparkSession)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/{number}")

    df.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*df.schema.fields, StructField("batch", IntegerType())])
    try:
        rows = df.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(path)
    except AnalysisException:  # no batch at all
        rows = df.sparkSession.createDataFrame([], schema)
    if mode == "append":
        return rows.drop("batch")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        return rows.where(F.col("batch") == F.lit(last)).drop("batch")
    return latest(rows, key)


def requery(strokes: DataFrame, keys: list[str], search: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger):
    """Start a query that answers anew for the sessions that drew something, at every trigger.

    Strokes are kept at ``path/strokes``; ``search`` gets all strokes of the changed sessions and gives rows with ``keys``,
    written to ``path/answers`` under the batch number. ``answers`` reads them.
    """

    def again(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/strokes/batch={number}")
        changed = spark.read.parquet(f"{path}/strokes/batch={number}").select(*keys).distinct()
        drawn = spark.read.parquet(f"{path}/strokes").where(F.col("batch") <= number).drop("batch").join(changed, keys, "left_semi")
        search(drawn).write.mode("overwrite").parquet(f"{path}/answers/batch={number}")

    return strokes.writeStream.foreachBatch(again).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def answers(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The answers of ``requery`` of the last batch in which each session drew."""
    rows = spark.read.parquet(f"{path}/answers")
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"]).drop("batch")


def replay(strokes: DataFrame, keys: list[str], time: str, tie: str, width: int = 3600) -> DataFrame:
    """Strokes with ``elapsed`` seconds since the first of their session and ``wait`` since the one before, to be shown again in time.

    Rows without time are left out. ``width``: seconds in a block of a long session.
    """
    at = strokes.where(F.col(time).isNotNull()).withColumn("_s", F.unix_micros(F.col(time).cast("timestamp")) / 1e6)
    first = at.groupBy(*keys).agg(F.min("_s").alias("_first"))
    rows = with_previous(at, keys, "_s", tie, ["_s"], width)
    wait = F.coalesce(F.col("_s") - F.col("prev._s"), F.lit(0.0))
    return rows.join(first, keys).withColumns({"elapsed": F.round(F.col("_s") - F.col("_first"), 6), "wait": F.round(wait, 6)}).drop("_s", "_first", "prev")
