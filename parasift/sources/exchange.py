"""Exchange of nested records as JSON lines, with a quarantine.

Records are written with their nulls and read back against an explicit
schema, each line once.  A line that is no JSON object of that schema, or that
lacks a required field, does not fail the job and does not become a record of
nulls: it goes to the quarantine with its file, its raw text and the reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNREADABLE, INCOMPLETE = "unreadable", "without "
_CORRUPT = "_corrupt_record"


def write_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object a line, null fields written out."""
    records.write.mode(mode).option("ignoreNullFields", "false").json(path)


def parse_records(lines: DataFrame, schema: T.StructType, required=()) -> DataFrame:
    """``file, record`` (raw text), ``reason`` (null: good) and ``r`` (the
    record) of a table of ``file, value``.  Blank lines are no records."""
    parsed = F.from_json("value", T.StructType([*schema.fields, T.StructField(_CORRUPT, T.StringType())]),
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT})
    rows = lines.filter(F.trim("value") != "").select("file", F.col("value").alias("record"), parsed.alias("p"))
    reason = F.when(F.col("p").isNull() | F.col(f"p.{_CORRUPT}").isNotNull(), F.lit(UNREADABLE))
    for name in required:
        reason = reason.when(F.col(f"p.{name}").isNull(), F.lit(INCOMPLETE + name))
    return rows.select("file", "record", reason.alias("reason"),
                       F.struct(*[F.col(f"p.{f.name}").alias(f.name) for f in schema.fields]).alias("r"))


def read_records(spark: SparkSession, path: str, schema: T.StructType, required=(),
                 quarantine: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(good records, quarantined lines ``file, record, reason``) of a file or
    folder of JSON lines.  With a ``quarantine`` folder the bad lines are
    written there first and read back, so that the record of what was refused
    outlives the job."""
    lines = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), "value")
    rows = parse_records(lines, schema, required)
    bad = rows.filter("reason IS NOT NULL").select("file", "record", "reason")
    if quarantine is not None:
        bad.write.mode("append").parquet(quarantine)
        bad = spark.read.schema(bad.schema).parquet(quarantine)
    return rows.filter("reason IS NULL").select("r.*"), bad
