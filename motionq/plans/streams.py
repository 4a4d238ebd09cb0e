"""Streaming queries over ``events``: the table is read as a stream to its end and the state is returned."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motionq.operators import lsh
from motionq.plans import sketches
from motionq.plans.common import Catalogue, read
from motionq.streaming import scores
from motionq.tables import fresh

query = Catalogue()


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


@query("""with r as (select user_id, max((ts, event_id)) last from events where event_type = 'error' group by 1)
select user_id, round(coalesce(sum(value) filter (where r.user_id is null or (ts, event_id) > last), 0), 4) score, count(*) filter (where r.user_id is null or (ts, event_id) > last) n from events left join r using (user_id) group by 1""")
def stream_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores per user since the last error."""
    e = events(spark, sf_dir).withColumn("reset", F.col("event_type") == "error")
    s = scores.drained(scores.accumulate(e, "user_id", ["ts", "event_id"], "value", "reset"), "update", "user_id")
    return s.select("user_id", F.round("score", 4).alias("score"), "n")


@query("select event_type, round(sum(value), 3) score, count(*) n from events group by 1")
def stream_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores.drained(scores.running(events(spark, sf_dir), ["event_type"], "value"), "complete")
    return s.select("event_type", F.round("score", 3).alias("score"), "n")


@query("select date_trunc('day', ts) start, event_type, round(sum(value), 3) score, count(*) n from events group by 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores.drained(scores.windows(events(spark, sf_dir), "ts", "1 day", ["event_type"], "value", "1 hour"), "complete")
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.round("score", 3).alias("score"), "n")


@query("select distinct user_id, event_type from events")
def stream_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which (user, kind) have to be scored again."""
    e = scores.changed(events(spark, sf_dir), ["user_id", "event_type"], "ts", "3650 days")
    return scores.drained(e.select("user_id", "event_type"), "append")


@query("select user_id, count(*) strokes, round(sum(value), 4) total, max(event_id) last_id from events group by 1")
def stream_requery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer to each user's drawing so far, given anew whenever the user drew."""
    path = fresh(spark)
    answer = lambda drawn: drawn.groupBy("user_id").agg(F.count("*").alias("strokes"), F.round(F.sum("value"), 4).alias("total"), F.max("event_id").alias("last_id"))
    scores.requery(events(spark, sf_dir), ["user_id"], answer, path, fresh(spark)).awaitTermination()
    return scores.answers(spark, path, ["user_id"])


@query("""select event_id, user_id, round((epoch_us(ts) - min(epoch_us(ts)) over (partition by user_id)) / 1e6::double, 6) elapsed,
round(coalesce((epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id)) / 1e6::double, 0), 6) wait from events where ts is not null""")
def stroke_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times at which recorded strokes are shown again."""
    return scores.replay(read(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 86_400).select("event_id", "user_id", "elapsed", "wait")


@query(f"with {sketches._U_SQL}, s as (select table_id, bucket, count(*) n from t group by 1, 2) select sum(n)::bigint \"rows\", count(*) buckets, max(n) largest from s group by table_id")
def stream_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket table that a stream of records is inserted into, and its figures by table."""
    source, index = fresh(spark), fresh(spark)
    sketches.records(spark, sf_dir).write.parquet(source)
    points = spark.readStream.schema("id long, v array<double>").parquet(source)
    scores.insert_into_index(points, sketches.LSH, "id", "v", index, fresh(spark)).awaitTermination()
    return lsh.statistics(spark.read.parquet(index)).drop("table_id")
