"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest:
``(digest binary, keep_id, group_size)``.  A batch is pre-aggregated to one row
per digest (so a group of copies, however large, crosses the shuffle as one row
per task), sort-merge anti-joined with the bucketed index, and what is new is
appended.  A text that earlier batches had gets a further row with this batch's
largest id and count; reading takes the largest id and the sum of a digest's
rows, inside its bucket.  So over all batches, too, the largest id stays: a
later batch with a larger id keeps its row, one with a smaller id loses it.
Everything is DataFrame or SQL.

Texts are equal when identical after lower-casing A-Z; null counts as empty.

Edge cases: a null id is smaller than any id; rows that agree in text and id
are ties, of which exactly one is kept; an empty batch appends nothing; extra
columns pass through ``keep_rows`` and are ignored elsewhere.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, materialise, row_key, scratch_path, text_or_empty, without_rows

BUCKETS = 64


def text_digest(text: Column) -> Column:
    """Lowercase hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(ascii_lower(text_or_empty(text)).cast("binary"), 256)


class DigestIndex:
    """Persistent digest index at ``path`` (shared storage).

    The files outlive the session: give the same ``path`` and ``buckets``
    later and the table is registered over them again.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = BUCKETS,
                 id_type: T.DataType | None = None):
        self.spark, self.buckets = spark, buckets
        self.path = path or scratch_path(spark, "digest-index")
        self.table = f"digest_index_{uuid.uuid4().hex}"
        self.id_type = id_type or T.LongType()
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id {self.id_type.simpleString()}, group_size BIGINT) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
            f"LOCATION '{self.path}'"
        )

    def entries(self) -> DataFrame:
        """The rows as stored, one per digest and batch that has it."""
        return self.spark.table(self.table)

    def rows(self) -> DataFrame:
        """One row per distinct text over all batches; no exchange."""
        return self.entries().groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def add(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> bool:
        """Append the digests of ``docs`` that the index does not hold yet, and
        for those that it holds a row of what this batch adds.  Whether the
        index was empty before."""
        first = self.entries().isEmpty()
        batch = (
            docs.select(F.unhex(text_digest(F.col(text_col))).alias("digest"), F.col(id_col).alias("_id"))
            .groupBy("digest")
            .agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        )
        new = batch.hint("merge").join(self.entries().select("digest"), "digest", "left_anti")
        if not first:
            new = new.unionByName(batch.hint("merge").join(self.entries().select("digest"), "digest", "left_semi"))
        (
            new.repartition(self.buckets, "digest").select("digest", "keep_id", "group_size")
            .write.mode("append").bucketBy(self.buckets, "digest").sortBy("digest")
            .format("parquet").option("path", self.path).saveAsTable(self.table)
        )
        self.spark.catalog.refreshTable(self.table)
        return first

    def unbucketed(self, merged: bool) -> DataFrame:
        """One row per distinct text as plain files: a join with them shuffles
        both sides, which lets Spark split a hot digest.  ``merged``: a digest
        may have rows of several batches, which are put together first."""
        if merged:
            return materialise(self.rows(), "dedup-index")
        schema = T.StructType([
            T.StructField("digest", T.BinaryType()),
            T.StructField("keep_id", self.id_type),
            T.StructField("group_size", T.LongType()),
        ])
        return self.spark.read.schema(schema).parquet(self.path)


def _indexed(docs: DataFrame, text_col: str, id_col: str, index: DigestIndex | None) -> DataFrame:
    """The index with ``docs``: digest, the id that stays, number of rows."""
    index = index or DigestIndex(docs.sparkSession, id_type=docs.schema[id_col].dataType)
    return index.unbucketed(merged=not index.add(docs, text_col, id_col))


def classify(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
             index: DigestIndex | None = None) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.

    Rows equal in id and text are counted before the shuffle and dealt out
    again after it.  With an ``index`` of earlier batches, their rows count:
    the largest id of all stays and ``group_size`` is the sum.
    """
    known = _indexed(docs, text_col, id_col, index)
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.unhex(text_digest(F.col(text_col))).alias("digest"))
        .groupBy("_id", "digest").agg(F.count(F.lit(1)).alias("_n"))
    )
    joined = rows.hint("merge").join(known, "digest")
    return joined.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.lower(F.hex("digest")).alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_i"),
    ).select(
        id_col, "keep_id", "group_size",
        (F.col(id_col).eqNullSafe(F.col("keep_id")) & (F.col("_i") == 1)).alias("kept"),
        "text_sha256",
    )


def keep_rows(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              index: DigestIndex | None = None) -> DataFrame:
    """The rows that stay, with all their columns.  Of rows equal in id and
    text, the one of largest row hash stays.  Only ids, digests and row hashes
    are shuffled, not texts."""
    known = _indexed(docs, text_col, id_col, index)
    rows = (
        docs.select(*row_key(docs), docs[id_col].alias("_id"), F.unhex(text_digest(docs[text_col])).alias("_digest"))
        .groupBy("_id", "_digest", "_key", "_key2").agg(F.count(F.lit(1)).alias("_n"))
    )
    keep = known.select(F.col("digest").alias("_d"), F.col("keep_id").alias("_keep"))
    named = rows.hint("merge").join(keep, F.col("_digest") == F.col("_d"))
    best = rows.groupBy("_id", "_digest").agg(F.max(F.struct("_key", "_key2")).alias("_best")).select(
        F.col("_id").alias("_id1"), F.col("_digest").alias("_digest1"), "_best")
    ranked = materialise(
        named.join(best.hint("merge"), F.col("_id").eqNullSafe(F.col("_id1")) & (F.col("_digest") == F.col("_digest1")))
        .select("_key", "_key2", "_n", (F.col("_id").eqNullSafe(F.col("_keep"))
                                        & (F.struct("_key", "_key2") == F.col("_best"))).alias("_stays")),
        "dedup-ranked")
    repeated = not ranked.where("_stays AND _n > 1").isEmpty()
    return without_rows(docs, ranked.where("NOT _stays"), repeated)
