"""Reading tables, and SQL fragments shared by the query catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Catalogue:
    """Collects queries with their SQL twins."""

    def __init__(self):
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None):
        def add(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql
            return f

        return add


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` with vectors of doubles."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")


def vector_of(df: DataFrame, vec_id: int) -> list[float]:
    return list(df.where(F.col("vec_id") == vec_id).first()["v"])


#: Elements of the vectors, positions from 1.
E_SQL = "e as (select vec_id, label, unnest(embedding)::double v, generate_subscripts(embedding, 1) i from embeddings)"


def usable_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ``points`` with complete, varying coordinates, once each: ``id, view_id, clip, frame, dimension, coords``."""
    p = read(spark, sf_dir, "points").select("id", "view_id", "clip", "frame", "dimension", "coords")
    good = (F.size("coords") == F.col("dimension")) & (F.col("dimension") > 0) & ~F.exists("coords", lambda x: x.isNull())
    p = p.where(F.col("coords").isNotNull() & good).where(F.array_min("coords") < F.array_max("coords"))
    return p.dropDuplicates(["id"])


#: The same in SQL.
U_SQL = """u as (select id, any_value(view_id) view_id, any_value(clip) clip, any_value(frame) frame, any_value(dimension) dimension, any_value(coords) coords
  from points where coords is not null and len(coords) = dimension and dimension > 0 and not list_contains(list_transform(coords, lambda x: x is null), true)
  and list_min(coords) < list_max(coords) group by id)"""
