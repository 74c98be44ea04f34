"""Readers and writers for the exchange records.

* JSON documents / analyses: one pretty-printed object per file is read with
  ``multiLine``; an explicit schema means nothing is inferred, and fields a
  record omits (e.g. ``score_rerank``) read as null.  Malformed records are
  kept with the raw text in ``_corrupt_record`` (PERMISSIVE) or fail the job
  (FAILFAST), as the caller chooses.
* Writers produce JSON lines with nulls written out, or Parquet (canonical).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import ANALYSIS, DOCUMENT, SUMMARY


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(list(schema.fields) + [T.StructField("_corrupt_record", T.StringType())])


def read_json_records(spark: SparkSession, path: str, schema: T.StructType, multiline: bool = True,
                      mode: str = "PERMISSIVE") -> DataFrame:
    reader = spark.read.schema(_with_corrupt(schema) if mode == "PERMISSIVE" else schema).option("multiLine", multiline)
    reader = reader.option("mode", mode)
    if mode == "PERMISSIVE":
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt_record")
    return reader.json(path)


def read_documents(spark: SparkSession, path: str, multiline: bool = True, mode: str = "FAILFAST") -> DataFrame:
    return read_json_records(spark, path, DOCUMENT, multiline, mode)


def read_analyses(spark: SparkSession, path: str, multiline: bool = True, mode: str = "FAILFAST") -> DataFrame:
    return read_json_records(spark, path, ANALYSIS, multiline, mode)


def read_summaries(spark: SparkSession, path: str, multiline: bool = True, mode: str = "FAILFAST") -> DataFrame:
    return read_json_records(spark, path, SUMMARY, multiline, mode)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines with null fields written out (``"x": null``)."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
