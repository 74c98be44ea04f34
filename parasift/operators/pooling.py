"""Masked mean pooling over token vectors stored one row per token."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mean_pool_tokens(df: DataFrame, keys, vector: str, mask: str, out: str = "pooled") -> DataFrame:
    """Mean of the token vectors with ``mask = 1`` per sequence.

    The denominator is the mask sum, or 1 when every token is masked (the
    result is then the zero vector, and the sequence is still present).  One
    aggregation with map-side combine: the masked vectors are summed and the
    mask counted, then divided, so an all-masked sequence never makes a
    weighted mean fail.
    """
    k = [keys] if isinstance(keys, str) else list(keys)
    m = F.col(mask).cast("double")
    weighted = F.transform(F.col(vector), lambda x: x.cast("double") * m)
    agg = df.groupBy(*k).agg(
        vector_to_array(Summarizer.sum(array_to_vector(weighted))).alias("_s"),
        F.sum(m).alias("_m"),
    )
    denom = F.when(F.col("_m") > 0, F.col("_m")).otherwise(F.lit(1.0))
    return agg.select(*k, F.transform("_s", lambda x: x / denom).alias(out))
