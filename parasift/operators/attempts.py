"""Chat requests over several attempts.

A request has an id made of its keys and its body, so the same request gets
the same id and shard in every run.  An :class:`AttemptLedger` keeps what was
sent and what came back, one folder per round: ``issue`` gives the requests
that still need an attempt, ``record`` writes a round (again: the round is
replaced), ``table`` merges all rounds into one row per request.

The first usable answer stays; of several answers to one attempt the least
usable one in text order.  A request that was sent and never came back counts
as an attempt whose time ran out.  A refusal that another attempt cannot
change ends a request; so does its last allowed attempt.  Responses to
requests that the round did not send are left out.  Null keys are a value of
their own; repeated requests are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .summary import response_outcome

ANSWERED, REFUSED, EXHAUSTED, OPEN = "answered", "refused", "exhausted", "open"
#: Refusals (status 400 to 499) that a later attempt may still turn into an answer.
PASSING_REFUSALS = (408, 409, 425, 429)
#: Between the parts of a request id, and in place of a null key.
PART, NO_KEY = "\x1f", "\x00"

ATTEMPTS = T.StructType([
    T.StructField("request_id", T.StringType()),
    T.StructField("attempt", T.IntegerType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("body", T.StringType()),
    T.StructField("error", T.StringType()),
])


def request_id(keys, body: str = "body") -> Column:
    parts = [F.coalesce(F.col(k).cast("string"), F.lit(NO_KEY)) for k in keys]
    return F.sha2(F.concat_ws(PART, *parts, F.coalesce(F.col(body), F.lit(NO_KEY))), 256)


def shard_of(rid: str | Column, shards: int) -> Column:
    """Shard of a request: ids are even, so shards are, whatever the keys."""
    rid = F.col(rid) if isinstance(rid, str) else rid
    return F.conv(F.substring(rid, 1, 8), 16, 10).cast("long") % shards


def final_refusal(status: Column) -> Column:
    return F.coalesce(status.between(400, 499) & ~status.isin(*PASSING_REFUSALS), F.lit(False))


def merge_attempts(requests: DataFrame, attempts: DataFrame, max_attempts: int) -> DataFrame:
    """One row per request: ``attempts`` made, ``state``, and the ``answer_attempt``
    and ``content`` or else the ``failure`` of the last attempt.

    One aggregation of the attempts by request id, one join by it."""
    got = attempts.select(
        "request_id", "attempt", final_refusal(F.col("status")).alias("final"),
        response_outcome(F.col("status"), F.col("body"), F.col("error")).alias("r"))
    merged = got.groupBy("request_id").agg(
        F.max("attempt").alias("attempts"),
        F.min(F.when(F.col("r.ok"), F.struct("attempt", "r.content"))).alias("_a"),
        F.max(F.struct("attempt", "r.failure")).alias("_l"),
        F.bool_or("final").alias("_final"),
    )
    state = (F.when(F.col("_a").isNotNull(), ANSWERED).when(F.col("_final"), REFUSED)
             .when(F.col("attempts") >= max_attempts, EXHAUSTED).otherwise(OPEN))
    out = requests.dropDuplicates(["request_id"]).join(merged, "request_id", "left")
    return out.select(
        *requests.columns, F.coalesce("attempts", F.lit(0)).alias("attempts"), state.alias("state"),
        F.col("_a.attempt").alias("answer_attempt"), F.col("_a.content").alias("content"),
        F.when(F.col("_a").isNull(), F.col("_l.failure")).alias("failure"))


class AttemptLedger:
    """Rounds of attempts in ``path`` (storage shared by the cluster)."""

    def __init__(self, spark: SparkSession, path: str, max_attempts: int = 3, shards: int = 8):
        self.spark, self.path = spark, path.rstrip("/")
        self.max_attempts, self.shards = int(max_attempts), int(shards)

    def requests(self, df: DataFrame, keys, body: str = "body") -> DataFrame:
        """``df`` with ``request_id`` and ``shard``."""
        return df.withColumn("request_id", request_id(keys, body)).withColumn("shard", shard_of("request_id", self.shards))

    def _rounds(self) -> list[int]:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        # a round that was not written to its end does not count
        names = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(s.getPath().suffix("/_SUCCESS"))]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("round="))

    def attempts(self, before: int | None = None) -> DataFrame:
        """Recorded attempts, only of rounds below ``before`` if given."""
        found = [f"{self.path}/round={n}" for n in self._rounds() if before is None or n < before]
        if not found:
            return self.spark.createDataFrame([], ATTEMPTS)
        return self.spark.read.schema(ATTEMPTS).parquet(*found)

    def table(self, requests: DataFrame, before: int | None = None) -> DataFrame:
        return merge_attempts(requests, self.attempts(before), self.max_attempts)

    def issue(self, requests: DataFrame, round_no: int) -> DataFrame:
        """Requests to send in round ``round_no``, with their ``attempt``."""
        todo = self.table(requests, before=round_no).filter(F.col("state") == OPEN)
        return todo.select(*requests.columns, (F.col("attempts") + 1).alias("attempt"))

    def record(self, round_no: int, issued: DataFrame, responses: DataFrame) -> None:
        """Write round ``round_no``: every issued request, with what came back
        (``request_id, status, body, error``) or nothing."""
        came = responses.select(
            "request_id", F.col("status").cast("int").alias("status"), F.col("body").alias("body"), F.col("error").alias("error"))
        rows = issued.select("request_id", "attempt").join(came, "request_id", "left")
        rows.select(*[F.col(f.name).cast(f.dataType) for f in ATTEMPTS]).write.mode("overwrite").parquet(
            f"{self.path}/round={int(round_no)}")
