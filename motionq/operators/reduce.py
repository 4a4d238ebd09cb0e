"""Principal components."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(df: DataFrame, vector: str, keep: float | int):
    """A PCA model: ``keep`` components, or as many as keep that share of the variance. Null vectors are skipped."""
    rows = df.where(F.col(vector).isNotNull()).select(array_to_vector(vector).alias("features"))
    if isinstance(keep, int):
        return PCA(k=keep, inputCol="features", outputCol="pc").fit(rows)
    dim = rows.first()["features"].size
    full = PCA(k=dim, inputCol="features", outputCol="pc").fit(rows)
    seen, k = 0.0, 0
    while seen < keep and k < dim:
        seen, k = seen + float(full.explainedVariance[k]), k + 1
    return PCA(k=max(k, 1), inputCol="features", outputCol="pc").fit(rows)


def project(df: DataFrame, key: str, vector: str, keep: float | int) -> DataFrame:
    """``(key, pc)``: vectors in the space of the components."""
    model = fit(df, vector, keep)
    rows = df.where(F.col(vector).isNotNull()).select(key, array_to_vector(vector).alias("features"))
    return model.transform(rows).select(key, vector_to_array("pc").alias("pc"))
