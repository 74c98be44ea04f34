"""Registered embedding-store queries (C1-C7) on the ``documents`` table.

Scenario: the English documents were analysed in an earlier run, so the
store holds the embeddings of their segments; the current run covers the
whole corpus.  In the first queries the store is the DataFrame of those
entries; ``store_read_through``, ``store_ttl`` and ``store_compacted`` fill a
persistent :class:`EmbeddingStore` in the shared folder and read it back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.ids import model_fingerprint
from ..operators.embed import HashingEmbedder
from ..operators.segments import explode_segments
from ..operators.store import EmbeddingStore, hit_miss_stats, lookup, lookup_flagged, store_keys, store_stats
from ..session import ensure_checkpoint_dir, write_scratch
from ..sources.tables import read_table
from . import oracle_sql as S
from .q_documents import DIM, UNIQ_SQL
from .registry import register

EMB = HashingEmbedder(DIM)
PRIOR_LANG = "en"


def _setup(spark, d):
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang")
    segs = explode_segments(docs, "doc_id", "text", keep=("lang",))
    uniq = segs.select("segment_id", "text").dropDuplicates(["segment_id"])
    prior = segs.filter(F.col("lang") == PRIOR_LANG).select("segment_id", "text").dropDuplicates(["segment_id"])
    stored = EMB.embed(prior).select("segment_id", "embedding", F.lit(EMB.fingerprint).alias("model_fingerprint"))
    return segs, uniq, stored


SETUP_SQL = f"""{S.segments_cte('seg', 'documents', 'doc_id', 'text')},
segl AS (SELECT s.*, d.lang FROM seg s JOIN documents d USING (doc_id)),
uniq AS (SELECT DISTINCT segment_id FROM segl),
stored AS (SELECT DISTINCT segment_id FROM segl WHERE lang = '{PRIOR_LANG}'),
miss AS (SELECT segment_id FROM uniq WHERE segment_id NOT IN (SELECT segment_id FROM stored))"""


@register(
    "store_hits",
    f"""
WITH {SETUP_SQL}
SELECT u.segment_id, u.segment_id IN (SELECT segment_id FROM stored) AS hit FROM uniq u
""",
)
def q_store_hits(spark, d):
    segs, uniq, stored = _setup(spark, d)
    return lookup_flagged(uniq, stored, DIM).select("segment_id", "hit")


@register(
    "store_misses",
    f"""
WITH {SETUP_SQL}
SELECT segment_id FROM miss
""",
)
def q_store_misses(spark, d):
    segs, uniq, stored = _setup(spark, d)
    _, misses = lookup(uniq, stored, DIM)
    return misses.select("segment_id")


@register(
    "store_hit_ratio",
    f"""
WITH {SETUP_SQL},
c AS (SELECT (SELECT count(*) FROM segl) AS n_rows, (SELECT count(*) FROM miss) AS n_miss)
SELECT CAST(n_rows - n_miss AS BIGINT) AS hits, CAST(n_miss AS BIGINT) AS misses,
       round(CASE WHEN n_rows > 0 THEN CAST(n_rows - n_miss AS DOUBLE) / n_rows ELSE 0.0 END, 6) AS hit_ratio
FROM c
""",
)
def q_store_hit_ratio(spark, d):
    segs, uniq, stored = _setup(spark, d)
    _, misses = lookup(uniq, stored, DIM)
    return hit_miss_stats(segs, misses).select("hits", "misses", F.round("hit_ratio", 6).alias("hit_ratio"))


@register(
    "store_stats",
    f"""
WITH {SETUP_SQL},
after AS (SELECT segment_id FROM stored UNION ALL SELECT segment_id FROM miss)
SELECT CAST(count(*) AS BIGINT) AS entry_count, CAST(count(*) * ({DIM} * 4 + 8) AS BIGINT) AS total_size_bytes FROM after
""",
)
def q_store_stats(spark, d):
    segs, uniq, stored = _setup(spark, d)
    _, misses = lookup(uniq, stored, DIM)
    written = EMB.embed(misses).select("segment_id", "embedding", F.lit(EMB.fingerprint).alias("model_fingerprint"))
    return store_stats(stored.unionByName(written))


LOCAL_FP = model_fingerprint(local_dir="/models/bge-small")


@register(
    "store_keys",
    f"""
WITH {SETUP_SQL}
SELECT segment_id, 'emb:' || segment_id || ':' || '{LOCAL_FP}' AS key,
       segment_id AS parsed_segment_id, '{LOCAL_FP}' AS parsed_fingerprint
FROM uniq
""",
)
def q_store_keys(spark, d):
    segs, uniq, stored = _setup(spark, d)
    k = store_keys(uniq.select("segment_id"), LOCAL_FP)
    return k.select("segment_id", "key", F.col("parsed.segment_id").alias("parsed_segment_id"),
                    F.col("parsed.model_fingerprint").alias("parsed_fingerprint"))


# ------------------------------------------------------- persistent store
def _store(spark, **options) -> EmbeddingStore:
    return EmbeddingStore(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/store-{uuid.uuid4().hex}", **options)


@register(
    "store_read_through",
    f"""
WITH {UNIQ_SQL},
en AS (SELECT DISTINCT segment_id FROM seg JOIN documents USING (doc_id) WHERE lang = '{PRIOR_LANG}'),
n AS (SELECT (SELECT count(*) FROM en) AS first, (SELECT count(*) FROM vec) AS every)
SELECT segment_id, CAST(len(list_filter(v, lambda x: x <> 0)) AS BIGINT) AS n_nonzero,
       first AS calls_1, every - first AS calls_2, CAST(0 AS BIGINT) AS calls_3, every AS entries, 2 * every AS all_entries
FROM vec, n
""",
)
def q_store_read_through(spark, d):
    """Three runs over one store (English documents, all, all again) and one
    of another model: vectors of the third run, embedder calls of each."""
    segs, uniq, _ = _setup(spark, d)
    # written: every run reads the distinct texts
    marked, _ = write_scratch(segs.groupBy("segment_id", "text").agg(
        F.max(F.col("lang") == PRIOR_LANG).alias("prior")), "store-texts")
    texts = marked.select("segment_id", "text")
    store, calls = _store(spark), []
    store.read_through(texts, HashingEmbedder(DIM // 2))
    for run in (marked.filter("prior").select("segment_id", "text"), texts, texts):
        vectors = store.read_through(run, EMB)
        calls.append(store.last_run.embedder_calls)
    counts = [F.lit(n).cast("long").alias(f"calls_{i + 1}") for i, n in enumerate(calls)]
    entries = store.read(EMB.fingerprint).count(), store.read_all().count()
    return vectors.select(
        "segment_id", F.size(F.array_remove("embedding", F.lit(0).cast("float"))).cast("long").alias("n_nonzero"), *counts,
        F.lit(entries[0]).cast("long").alias("entries"), F.lit(entries[1]).cast("long").alias("all_entries"))


CLOCK, TTL_DAYS = "2024-01-31 00:00:00", 10


@register(
    "store_ttl",
    f"""
WITH {S.segments_cte('seg', 'documents', 'doc_id', 'text')},
u AS (SELECT DISTINCT segment_id, CAST('0x' || substr(segment_id, 1, 4) AS BIGINT) % 40 AS day FROM seg)
SELECT segment_id, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(day AS INTEGER)) BETWEEN
         TIMESTAMP '{CLOCK}' - INTERVAL {TTL_DAYS} DAY AND TIMESTAMP '{CLOCK}' AS hit
FROM u
""",
)
def q_store_ttl(spark, d):
    """Entries written over forty days, read as of a fixed clock."""
    segs, uniq, _ = _setup(spark, d)
    day = F.conv(F.substring("segment_id", 1, 4), 16, 10).cast("int") % 40
    store = _store(spark, ttl_days=TTL_DAYS)
    store.append(HashingEmbedder(8).embed(uniq).select(
        "segment_id", "embedding", (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=day)).alias("written_at"),
        F.lit("m").alias("model_fingerprint")))
    return store.lookup(uniq.select("segment_id"), "m", 8, as_of=CLOCK).select("segment_id", "hit")


@register(
    "store_compacted",
    f"""
WITH {S.segments_cte('seg', 'documents', 'doc_id', 'text')},
w AS (SELECT segment_id, CAST(max(doc_id) AS BIGINT) AS written, count(*) AS writes FROM seg GROUP BY segment_id)
SELECT segment_id, written, (SELECT CAST(sum(writes) AS BIGINT) FROM w) AS entries_before, (SELECT count(*) FROM w) AS entries_after,
       CAST(2 AS BIGINT) AS generation
FROM w
""",
)
def q_store_compacted(spark, d):
    """Every document writes its segments at its own time; the compacted
    generation holds the last write of each."""
    segs, _, _ = _setup(spark, d)
    store = _store(spark)
    writes = segs.select(
        "segment_id", F.array(F.col("doc_id").cast("float")).alias("embedding"), F.timestamp_seconds("doc_id").alias("written_at"),
        F.lit("m").alias("model_fingerprint"))
    store.append(writes.filter("segment_id < '8'"))
    store.append(writes.filter("segment_id >= '8'"))
    before = store.read_all().count()
    generation = store.compact().number
    entries = store.read_all()
    return entries.select(
        "segment_id", F.unix_timestamp("written_at").alias("written"), F.lit(before).cast("long").alias("entries_before"),
        F.lit(entries.count()).cast("long").alias("entries_after"), F.lit(generation).cast("long").alias("generation"))
