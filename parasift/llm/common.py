"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parasift.session import ensure_checkpoint_dir

#: Largest side of a join that is broadcast; beyond it the join sorts and merges.
BROADCAST_BYTES = 16 << 20
#: Setting that removes the shuffle files of a query when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS, _BATCH_CONF = 2_500, "spark.sql.execution.arrow.maxRecordsPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of at most ``BATCH_ROWS`` rows for the jobs run inside."""
    before = spark.conf.get(_BATCH_CONF)
    if not 0 < int(before) <= BATCH_ROWS:
        spark.conf.set(_BATCH_CONF, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_CONF, before)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts the
    lineage, survives lost executors, and later reads prune columns.  The
    shuffle files of the write go when it ends: nothing reads them again."""
    return materialise_at(df, scratch_path(df.sparkSession, name))


def materialise_at(df: DataFrame, path: str) -> DataFrame:
    """:func:`materialise` in the folder ``path``, for tables that are removed
    as soon as their last reader is done."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized_side(df: DataFrame, row_bytes: Column) -> DataFrame:
    """``df`` as one side of a join: broadcast if its measured bytes are within
    ``BROADCAST_BYTES``, else sort-merged (which Spark can split at a hot key)."""
    size = df.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df.hint("merge")


def least_count(counts: DataFrame, most: int) -> int | None:
    """The least ``n`` that no more than ``most`` rows of ``counts`` reach."""
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))
    reach = by_count.select("n", F.sum("words").over(W.orderBy(F.desc("n"))).alias("words"))
    return reach.where(F.col("words") <= most).agg(F.min("n")).first()[0]


def row_key(docs: DataFrame) -> list[Column]:
    """Two hashes (96 bits) over all columns of a row, ``_key`` and ``_key2``."""
    columns = [docs[c] for c in docs.columns]
    return [F.xxhash64(*columns).alias("_key"), F.hash(*columns).alias("_key2")]


def without_rows(docs: DataFrame, dropped: DataFrame, repeated: bool) -> DataFrame:
    """``docs`` without the rows whose keys are in ``dropped`` (written, small
    rows); of rows equal in all columns one stays if there are any
    (``repeated``).  Texts move only if the dropped keys exceed a broadcast."""
    own = uuid.uuid4().hex  # no column of docs has such a name
    one, two, gone_one, gone_two = (f"_{own}_{i}" for i in range(4))
    key, key2 = row_key(docs)
    gone = sized_side(dropped.select(F.col("_key").alias(gone_one), F.col("_key2").alias(gone_two)), F.lit(12))
    kept = docs.select(*[docs[c] for c in docs.columns], key.alias(one), key2.alias(two)).join(
        gone, (F.col(one) == F.col(gone_one)) & (F.col(two) == F.col(gone_two)), "left_anti")
    return (kept.dropDuplicates([one, two]) if repeated else kept).drop(one, two)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, LOWER)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def training_fold(doc_id: Column) -> Column:
    """True for rows that a classifier may learn labels from."""
    return ~held_out(doc_id)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3, is 1 (a null id counts as empty text)."""
    return F.crc32(text_or_empty(doc_id).cast("binary")) % 3 == 1
