"""Texts for a model in batches of nearly equal length (V1, V2).

A model pads every batch to its longest text, so a batch of mixed lengths is
mostly padding.  Here texts are dealt to partitions by ranges of (length
bucket, text hash) of about the same rows and bytes: a bucket that holds most
texts spans several partitions, and within a partition batches follow the
buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .embed import hash_tokens

BUCKET_STEP, MAX_LEN = 16, 512
#: Bytes of text that a partition is dealt at most (one longer text alone may exceed them).
PART_BYTES = 64 << 20
_HASH_STEPS = 1 << 30


def token_count(text, max_len: int = MAX_LEN) -> Column:
    """Tokens of a text that a model sees (0 for null), at most ``max_len``."""
    return F.least(F.greatest(F.coalesce(F.size(hash_tokens(text)), F.lit(0)), F.lit(0)), F.lit(max_len))


def length_bucket(tokens: Column, step: int = BUCKET_STEP, max_len: int = MAX_LEN) -> Column:
    """The length that a text of ``tokens`` is padded to: the next multiple of
    ``step``, at least one and at most ``max_len``."""
    return F.least(F.greatest(F.ceil(tokens / step), F.lit(1)) * step, F.lit(max_len)).cast("int")


def by_length(df: DataFrame, partitions: int, text: str = "text", step: int = BUCKET_STEP, max_len: int = MAX_LEN) -> DataFrame:
    """Rows of ``df`` in partitions of about equal size that follow the length
    buckets, in bucket order within each; the columns stay as they are.

    The size of a row counts half by rows and half by bytes of text, so of ``n``
    partitions none has more than about ``2 / n`` of either.  There are
    ``partitions`` of them, or as many as keep each below ``PART_BYTES``.  Runs a
    job that measures the buckets, so ``df`` is computed twice.
    """
    at = "_bucket"
    while at in df.columns:
        at += "_"
    d = df.withColumn(at, length_bucket(token_count(text, max_len), step, max_len))
    sizes = d.groupBy(at).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(text).cast("long")), F.lit(0)).alias("b")).orderBy(at).collect()
    if not sizes:
        return df.limit(0)
    rows, total = sum(r["n"] for r in sizes), sum(r["b"] for r in sizes)
    parts = max(int(partitions), -(-2 * total // PART_BYTES))
    # a row's place in 0..1: the buckets below, and its hash's share of its own
    before, spans = 0.0, []
    for r in sizes:
        width = (r["n"] / rows + r["b"] / max(total, 1)) / (2 if total else 1)
        spans += [F.lit(r[at]), F.struct(F.lit(before).alias("before"), F.lit(width).alias("width"))]
        before += width
    span = F.element_at(F.create_map(*spans), F.col(at))
    share = F.pmod(F.xxhash64(text), F.lit(_HASH_STEPS)) / F.lit(float(_HASH_STEPS))
    place = F.floor((span["before"] + share * span["width"]) * parts).cast("int")
    return d.repartitionById(parts, F.least(F.coalesce(place, F.lit(0)), F.lit(parts - 1))).sortWithinPartitions(at).drop(at)


def batch_padding(df: DataFrame, batch_size: int, text: str = "text", max_len: int = MAX_LEN) -> DataFrame:
    """One row: ``batches``, ``tokens`` and ``padded`` places of consecutive
    batches of ``batch_size`` rows in each partition, as a model would pad them."""
    place = F.monotonically_increasing_id()  # partition number above, row number below bit 33
    rows = df.select(token_count(text, max_len).alias("t"), place.alias("p")).select(
        "t", F.shiftright("p", 33).alias("part"), F.floor(F.col("p").bitwiseAND(F.lit((1 << 33) - 1)) / batch_size).alias("batch"))
    per = rows.groupBy("part", "batch").agg(F.max("t").alias("m"), F.count(F.lit(1)).alias("n"), F.sum("t").alias("s"))
    return per.agg(F.count(F.lit(1)).alias("batches"), F.coalesce(F.sum("s"), F.lit(0)).alias("tokens"),
                   F.coalesce(F.sum(F.col("m") * F.col("n") - F.col("s")), F.lit(0)).cast(T.LongType()).alias("padded"))


class LengthBatchedEmbedder:
    """``inner`` (for example a :class:`ModelEmbedder`) over texts in length
    order: the same vectors and fingerprint, less padding."""

    def __init__(self, inner, partitions: int, step: int = BUCKET_STEP, max_len: int = MAX_LEN):
        self.inner, self.partitions, self.step, self.max_len = inner, int(partitions), int(step), int(max_len)
        self.dim, self.fingerprint = inner.dim, inner.fingerprint

    def embed(self, df: DataFrame, text: str = "text", out: str = "embedding") -> DataFrame:
        return self.inner.embed(by_length(df, self.partitions, text, self.step, self.max_len), text, out)
