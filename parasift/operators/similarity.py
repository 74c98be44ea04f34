"""Group-wise vector statistics: centroid, centroid similarity, redundancy.

All three are aggregations with partial (map-side) combine, so one hot group
is summed in every task that holds a piece of it and merged afterwards; no
group is ever collected into one task.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import cosine, l2_normalize, norm, sq_norm


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def centroids(df: DataFrame, keys, vector: str, out: str = "centroid") -> DataFrame:
    """Component-wise mean vector per group (as ``array<double>``)."""
    k = _keys(keys)
    return df.groupBy(*k).agg(
        vector_to_array(Summarizer.mean(array_to_vector(F.col(vector)))).alias(out)
    )


def centroid_similarity(df: DataFrame, keys, vector: str, out: str = "score_representative",
                        cents: DataFrame | None = None, broadcast_centroids: bool = False) -> DataFrame:
    """Cosine of every row to its group's centroid (0 for a zero vector).

    The centroid table has one row per group; it is joined on the group keys
    (AQE splits a skewed group on the large side and replicates its centroid).
    ``broadcast_centroids`` is for callers that know the number of groups is
    small (e.g. only the hot groups): the rows then never shuffle.
    """
    k = _keys(keys)
    cents = cents if cents is not None else centroids(df, k, vector, "_centroid")
    if "_centroid" not in cents.columns:
        cents = cents.withColumnRenamed("centroid", "_centroid")
    joined = df.join(F.broadcast(cents) if broadcast_centroids else cents, k, "inner")
    return joined.withColumn(out, cosine(F.col(vector), F.col("_centroid"))).drop("_centroid")


def unit_vectors(df: DataFrame, vector: str, out: str = "u") -> DataFrame:
    return df.withColumn(out, l2_normalize(F.col(vector)))


def redundancy(df: DataFrame, keys, vector: str, out: str = "avg_pairwise_cosine") -> DataFrame:
    """Mean cosine over all unordered pairs of rows in a group; 0 below two rows.

    Linear form: with unit vectors ``u`` (zero vectors stay zero),
    ``sum_{i<j} u_i.u_j = (|sum u|^2 - n_nonzero) / 2``, so the mean over the
    ``n(n-1)/2`` pairs is ``(|sum u|^2 - n_nonzero) / (n(n-1))``.  One
    aggregation, no self-join.
    """
    k = _keys(keys)
    u = l2_normalize(F.col(vector))
    agg = df.select(*k, u.alias("_u"), (norm(F.col(vector)) > 0).cast("long").alias("_nz")).groupBy(*k).agg(
        vector_to_array(Summarizer.sum(array_to_vector(F.col("_u")))).alias("_s"),
        F.count(F.lit(1)).alias("_n"),
        F.sum("_nz").alias("_nnz"),
    )
    n = F.col("_n").cast("double")
    val = F.when(F.col("_n") > 1, (sq_norm(F.col("_s")) - F.col("_nnz")) / (n * (n - 1))).otherwise(F.lit(0.0))
    return agg.select(*k, val.alias(out))
