"""Embedding store (C1-C12): one entry per (segment id, model fingerprint).

Layout under ``root`` (storage shared by the cluster)::

    pointer/000002                      names the current generation and its buckets
    gen=000002/model_fingerprint=F/written_date=D/part-..._BUCKET.parquet

* A generation is a Parquet table bucketed and sorted by ``segment_id``.  The
  distinct ids of a run are dealt into the same buckets, so a lookup is one
  join that moves no stored row; it reads ids and sizes, vectors follow for
  the ids that the caller wants.
* Entries are only appended; the latest valid write wins on read.  ``dim`` is
  the size of a valid vector and null for one with a null, NaN or infinite
  component: such an entry is a miss and is superseded by the fresh write.
* ``compact`` rewrites the winning entries into the next generation; a
  generation is published by renaming a pointer file into place, so a reader
  sees the old one or the new one.  Entries that another run appends to the
  old generation meanwhile are misses afterwards.  Old generations are removed
  by ``expire`` after a retention time, when no reader holds them.
* ``ttl_days`` hides entries older than that, as of a given clock; whole
  write dates are pruned before any file is opened.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import parse_store_key, store_key
from ..functions.vectors import is_valid_vector

STORE_SCHEMA = T.StructType([
    T.StructField("segment_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("dim", T.IntegerType()),
    T.StructField("written_at", T.TimestampType()),
    T.StructField("model_fingerprint", T.StringType()),
    T.StructField("written_date", T.DateType()),
])
GEN_PREFIX = "gen="


def entry_bytes(embedding: Column) -> Column:
    """Serialized size of one entry: 8-byte length prefix + 4 bytes per float."""
    return F.size(embedding).cast("long") * 4 + 8


def latest(entries: DataFrame) -> DataFrame:
    """Last write wins: one row per ``segment_id``.  A total order: of writes
    in one instant, the one of larger vector hash."""
    order = [F.xxhash64("embedding")]
    if "written_at" in entries.columns:
        order.insert(0, F.col("written_at"))
    return entries.groupBy("segment_id").agg(F.max_by("embedding", F.struct(*order)).alias("embedding"))


def lookup_flagged(uniq: DataFrame, stored: DataFrame, dim: int | None = None) -> DataFrame:
    """Distinct segments with ``embedding`` (null on a miss) and ``hit``: one
    left join.  ``stored`` has ``segment_id, embedding[, written_at]`` for one
    fingerprint; invalid vectors are misses; the latest write wins."""
    valid = latest(stored.filter(is_valid_vector(F.col("embedding"), dim)))
    # the store grows with the corpus and its size may be underestimated when it
    # is derived (e.g. vectors from a Python step): never broadcast it
    return uniq.join(valid.hint("merge"), "segment_id", "left").withColumn("hit", F.col("embedding").isNotNull())


def lookup(uniq: DataFrame, stored: DataFrame, dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(hits with ``embedding``, misses) of ``lookup_flagged``."""
    both = lookup_flagged(uniq, stored, dim)
    return both.filter("hit").drop("hit"), both.filter("NOT hit").select(*uniq.columns)


def hit_miss_stats(segs: DataFrame, misses: DataFrame) -> DataFrame:
    """``hits, misses, hit_ratio`` of one run.

    Every distinct missing id costs one embedder call (a miss); every other
    segment row is served from the store (a hit) — the count a sequential
    read-through with write-back produces regardless of order.
    """
    counted = segs.select(F.lit(1).alias("_r"), F.lit(0).alias("_m")).unionByName(
        misses.select(F.lit(0).alias("_r"), F.lit(1).alias("_m")))
    tot = counted.agg(F.sum("_r").cast("long").alias("rows"), F.sum("_m").cast("long").alias("misses"))
    hits = (F.coalesce(F.col("rows"), F.lit(0)) - F.coalesce(F.col("misses"), F.lit(0))).cast("long")
    total = F.coalesce(F.col("rows"), F.lit(0)).cast("long")
    return tot.select(
        hits.alias("hits"),
        F.coalesce(F.col("misses"), F.lit(0)).cast("long").alias("misses"),
        F.when(total > 0, hits.cast("double") / total.cast("double")).otherwise(F.lit(0.0)).alias("hit_ratio"),
    )


def store_stats(stored: DataFrame) -> DataFrame:
    """``entry_count, total_size_bytes`` (exact, over all entries)."""
    return stored.agg(
        F.count(F.lit(1)).cast("long").alias("entry_count"),
        F.coalesce(F.sum(entry_bytes(F.col("embedding"))), F.lit(0)).cast("long").alias("total_size_bytes"),
    )


def store_keys(df: DataFrame, fingerprint: str) -> DataFrame:
    """Add the string key and its parse (``key``, ``parsed``)."""
    k = store_key(F.col("segment_id"), F.lit(fingerprint))
    return df.withColumn("key", k).withColumn("parsed", parse_store_key(F.col("key")))


@dataclass
class RunStats:
    embedder_calls: int = 0


@dataclass(frozen=True)
class Generation:
    number: int
    buckets: int


class EmbeddingStore:
    """Store under ``root``.  ``buckets`` counts for generations that this
    object starts (default: the session's shuffle partitions, so that the ids
    of a run need one exchange)."""

    def __init__(self, spark: SparkSession, root: str, enabled: bool = True, ttl_days: int | None = None,
                 buckets: int | None = None):
        self.spark = spark
        self.root = root.rstrip("/")
        self.enabled = enabled
        self.ttl_days = ttl_days
        self.buckets = buckets
        self.last_run = RunStats()

    # -- generations -----------------------------------------------------
    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list:
        """Published pointers, oldest first."""
        fs, folder = self._fs(), self._path("pointer")
        if not fs.exists(folder):
            return []
        return sorted((s for s in fs.listStatus(folder) if s.getPath().getName().isdigit()), key=lambda s: s.getPath().getName())

    def current(self) -> Generation | None:
        pointers = self._pointers()
        if not pointers:
            return None
        stream = self._fs().open(pointers[-1].getPath())
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Generation(**json.loads(text))

    def _publish(self, gen: Generation) -> None:
        """Make ``gen`` the current generation by one rename; fails if another
        writer has published that number first."""
        fs, temp, final = self._fs(), self._path("pointer", f"_{uuid.uuid4().hex}"), self._path("pointer", f"{gen.number:06d}")
        out = fs.create(temp)
        out.write(bytearray(json.dumps({"number": gen.number, "buckets": gen.buckets}).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise RuntimeError(f"generation {gen.number} of {self.root} was published by another writer")

    def _next(self, after: Generation | None) -> Generation:
        buckets = self.buckets or (after.buckets if after else int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        return Generation(after.number + 1 if after else 1, buckets)

    def _folder(self, gen: Generation) -> str:
        return f"{self.root}/{GEN_PREFIX}{gen.number:06d}"

    def current_path(self) -> str:
        return self._folder(self.current() or Generation(0, 1))

    def clear(self) -> None:
        """Start a new empty generation; ``expire`` removes older ones."""
        self._publish(self._next(self.current()))

    def expire(self, retention: dt.timedelta, now: dt.datetime | None = None) -> list[int]:
        """Remove generations replaced more than ``retention`` ago; their numbers."""
        limit = ((now or dt.datetime.now(dt.timezone.utc)) - retention).timestamp() * 1000
        fs, gone, pointers = self._fs(), [], self._pointers()
        for old, newer in zip(pointers, pointers[1:]):
            if newer.getModificationTime() <= limit:  # replaced when the newer one was published
                number = int(old.getPath().getName())
                self.spark.sql(f"DROP TABLE IF EXISTS {self._name(Generation(number, 1))}")
                fs.delete(self._path(f"{GEN_PREFIX}{number:06d}"), True)
                fs.delete(old.getPath(), False)
                gone.append(number)
        return gone

    def compact(self) -> Generation:
        """Rewrite the winning entries (one per segment and fingerprint) into
        the next generation and publish it."""
        old = self.current()
        new = self._next(old)
        if old is not None:
            order = F.struct("written_at", F.xxhash64("embedding"))
            kept = self._entries(old).filter("dim IS NOT NULL").groupBy("model_fingerprint", "segment_id").agg(
                F.max_by(F.struct("embedding", "dim", "written_at", "written_date"), order).alias("e"))
            self._write(kept.select("segment_id", "e.*", "model_fingerprint"), new, laid_out=new.buckets == old.buckets)
        self._publish(new)
        return new

    # -- table of a generation ------------------------------------------
    def _name(self, gen: Generation) -> str:
        return f"parasift_store_{hashlib.md5(self._folder(gen).encode()).hexdigest()}"

    def _table(self, gen: Generation) -> str:
        """Register the generation's files in the session's catalog, with what
        other writers added since."""
        name = self._name(gen)
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in STORE_SCHEMA.fields)
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY (model_fingerprint, written_date) "
            f"CLUSTERED BY (segment_id) SORTED BY (segment_id) INTO {gen.buckets} BUCKETS LOCATION '{self._folder(gen)}'")
        if self._fs().exists(self._path(f"{GEN_PREFIX}{gen.number:06d}")):
            self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
        self.spark.catalog.refreshTable(name)
        return name

    def _entries(self, gen: Generation) -> DataFrame:
        return self.spark.table(self._table(gen))

    def _write(self, entries: DataFrame, gen: Generation, laid_out: bool = False) -> None:
        rows = entries.select(*STORE_SCHEMA.fieldNames())
        if not laid_out:
            rows = rows.repartition(gen.buckets, "segment_id")  # a task writes one bucket
        (rows.write.mode("append").partitionBy("model_fingerprint", "written_date").bucketBy(gen.buckets, "segment_id")
         .sortBy("segment_id").format("parquet").option("path", self._folder(gen)).saveAsTable(self._table(gen)))

    def append(self, entries: DataFrame, laid_out: bool = False) -> None:
        """Append ``segment_id, embedding, written_at, model_fingerprint``."""
        gen = self.current()
        if gen is None:
            gen = self._next(None)
            self._publish(gen)
        valid = F.when(is_valid_vector(F.col("embedding"), None), F.size("embedding"))
        self._write(entries.withColumn("dim", valid).withColumn("written_date", F.to_date("written_at")), gen, laid_out)

    # -- reads ------------------------------------------------------------
    def read_all(self, as_of: Column | str | None = None) -> DataFrame:
        """All entries that count as of a clock (default: now).  With a given
        ``as_of``, later entries do not count either."""
        gen = self.current()
        if gen is None:
            return self.spark.createDataFrame([], STORE_SCHEMA)
        df = self._entries(gen)
        clock = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp") if isinstance(as_of, str) else as_of
        if as_of is not None:
            df = df.filter((F.col("written_at") <= clock) & (F.col("written_date") <= F.date_add(clock.cast("date"), 1)))
        if self.ttl_days is not None:
            oldest = clock - F.make_dt_interval(days=F.lit(int(self.ttl_days)))
            # a day to spare: the date was taken in the time zone of the writing session
            df = df.filter((F.col("written_at") >= oldest) & (F.col("written_date") >= F.date_sub(oldest.cast("date"), 1)))
        return df

    def read(self, fingerprint: str, as_of: Column | str | None = None) -> DataFrame:
        return self.read_all(as_of).filter(F.col("model_fingerprint") == F.lit(fingerprint))

    def stats(self) -> DataFrame:
        return store_stats(self.read_all())

    def _dealt(self, uniq: DataFrame) -> DataFrame:
        """Rows dealt into the store's buckets."""
        return uniq.repartition((self.current() or self._next(None)).buckets, "segment_id")

    def lookup(self, uniq: DataFrame, fingerprint: str, dim: int, as_of: Column | str | None = None) -> DataFrame:
        """``uniq`` with ``hit``: one join, no stored row moves, no vector is read."""
        stored = self.read(fingerprint, as_of).filter(F.col("dim") == dim).groupBy("segment_id").agg(F.lit(True).alias("hit"))
        return self._dealt(uniq).join(stored.hint("merge"), "segment_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def vectors(self, uniq: DataFrame, fingerprint: str, dim: int, as_of: Column | str | None = None) -> DataFrame:
        """``segment_id, embedding`` of the distinct ids of ``uniq`` that the store holds."""
        stored = latest(self.read(fingerprint, as_of).filter(F.col("dim") == dim))
        return self._dealt(uniq.select("segment_id")).join(stored.hint("merge"), "segment_id")

    # -- read-through ----------------------------------------------------
    def ensure(self, uniq: DataFrame, embedder, text: str = "text") -> int:
        """Embed the distinct segments that the store lacks, once each, and
        append them; the number of embedder calls."""
        fp = embedder.fingerprint
        misses = self.lookup(uniq, fp, embedder.dim).filter("NOT hit").drop("hit")
        calls = Observation()
        fresh = embedder.embed(misses, text=text).select(
            "segment_id", "embedding", F.current_timestamp().alias("written_at"), F.lit(fp).alias("model_fingerprint"),
        ).observe(calls, F.count(F.lit(1)).alias("n")).filter(
            is_valid_vector(F.col("embedding"), embedder.dim))  # an invalid vector is never stored
        self.append(fresh, laid_out=True)
        return int(calls.get.get("n", 0))

    def read_through(self, uniq: DataFrame, embedder, text: str = "text") -> DataFrame:
        """Valid vectors of the distinct ``segment_id``s of ``uniq``; misses are
        embedded once, appended to the store, and read back.  An id whose
        vector is invalid has no row."""
        self.last_run = RunStats()
        if not self.enabled:
            return embedder.embed(uniq, text=text).select("segment_id", "embedding")
        self.last_run = RunStats(self.ensure(uniq, embedder, text))
        return self.vectors(uniq, embedder.fingerprint, embedder.dim)
