"""Registered queries on the ``documents`` table: segmentation, ids, the
hashing embedder, token windows and the full per-document analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import CHUNK_PARAMS, PRODUCER_TAG
from ..operators.embed import DEFAULT_DIM, DEFAULT_VOCAB, HashingEmbedder, token_window
from ..operators.segments import content_doc_id, explode_segments, segment_texts
from ..options import AnalyzerOptions
from ..sources.tables import read_table
from . import oracle_sql as S
from .pipeline import analyze
from .registry import register

OPTS = AnalyzerOptions()
DIM = DEFAULT_DIM


def documents(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text")


def doc_segments_df(spark, d):
    return explode_segments(documents(spark, d), "doc_id", "text")


SEG_SQL = S.segments_cte("seg", "documents", "doc_id", "text")


@register(
    "doc_segments",
    f"""
WITH {SEG_SQL}
SELECT doc_id, position, path, segment_id, text FROM seg
""",
)
def q_doc_segments(spark, d):
    return doc_segments_df(spark, d).select("doc_id", "position", "path", "segment_id", "text")


@register(
    "doc_ids",
    f"""
WITH {SEG_SQL}
SELECT d.doc_id,
       sha256(coalesce(string_agg(s.text, chr(10) ORDER BY s.position), '') || '{CHUNK_PARAMS}' || '{PRODUCER_TAG}') AS doc_hash,
       count(s.position) AS num_segments
FROM documents d LEFT JOIN seg s USING (doc_id)
GROUP BY d.doc_id
""",
)
def q_doc_ids(spark, d):
    docs = content_doc_id(documents(spark, d), "text")
    return docs.select("doc_id", "doc_hash", F.size(segment_texts("text")).cast("long").alias("num_segments"))


@register(
    "doc_exact_duplicates",
    f"""
WITH {SEG_SQL},
h AS (
  SELECT d.doc_id,
         sha256(coalesce(string_agg(s.text, chr(10) ORDER BY s.position), '') || '{CHUNK_PARAMS}' || '{PRODUCER_TAG}') AS doc_hash
  FROM documents d LEFT JOIN seg s USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_hash, count(*) AS n_docs, min(doc_id) AS first_doc_id
FROM h GROUP BY doc_hash HAVING count(*) > 1
""",
)
def q_doc_exact_duplicates(spark, d):
    h = content_doc_id(documents(spark, d), "text")
    return (
        h.groupBy("doc_hash")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc_id"))
        .filter(F.col("n_docs") > 1)
    )


UNIQ_SQL = f"""{SEG_SQL},
uniq AS (SELECT segment_id, any_value(text) AS text FROM seg GROUP BY segment_id),
{S.hash_embed_cte('vec', 'uniq', DIM)}"""


@register(
    "hash_embedding",
    f"""
WITH {UNIQ_SQL}
SELECT segment_id, i - 1 AS i, round(x, 6) AS x
FROM (SELECT segment_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec)
WHERE x <> 0
""",
)
def q_hash_embedding(spark, d):
    segs = doc_segments_df(spark, d).select("segment_id", "text").dropDuplicates(["segment_id"])
    emb = HashingEmbedder(DIM).embed(segs)
    return (
        emb.select("segment_id", F.posexplode("embedding").alias("i", "x"))
        .filter(F.col("x") != 0)
        .select("segment_id", F.col("i").cast("long").alias("i"), F.round(F.col("x").cast("double"), 6).alias("x"))
    )


@register(
    "token_windows",
    f"""
WITH {SEG_SQL},
t AS (
  SELECT doc_id, position,
    list_transform(
      list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''),
      lambda x: CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % {DEFAULT_VOCAB - 1} + 1) AS ids
  FROM seg
)
SELECT doc_id, position, CAST({OPTS.max_seq_len} AS BIGINT) AS seq_len,
       CAST(least(len(ids), {OPTS.max_seq_len}) AS BIGINT) AS n_real,
       CAST(coalesce(list_sum(list_slice(ids, 1, {OPTS.max_seq_len})), 0) AS BIGINT) AS id_sum
FROM t
""",
)
def q_token_windows(spark, d):
    segs = doc_segments_df(spark, d)
    w = segs.select("doc_id", "position", token_window("text", OPTS.max_seq_len).alias("w"))
    return w.select(
        "doc_id", "position",
        F.size("w.ids").cast("long").alias("seq_len"),
        F.aggregate("w.mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"),
        F.aggregate("w.ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"),
    )


def analysis_sql(k: int) -> str:
    """Hash embeddings -> centroid -> similarity -> MMR picks ``m`` (k per document)."""
    return f"""{UNIQ_SQL},
sv AS (SELECT s.doc_id, s.position, s.segment_id, vec.v FROM seg s JOIN vec USING (segment_id)),
{S.centroid_cte('c', 'sv', 'doc_id', 'v')},
b AS (
  SELECT sv.doc_id, sv.position, sv.segment_id, {S.unit('v')} AS u, {S.cosine('v', 'cv')} AS rep,
         count(*) OVER (PARTITION BY sv.doc_id) AS n
  FROM sv JOIN c USING (doc_id)
),
{S.mmr_cte('m', 'b', 'doc_id', 'position', k, OPTS.mmr_lambda)}"""


ANALYSIS_SQL = analysis_sql(OPTS.top_n)


def _analysis(spark, d):
    docs = documents(spark, d)
    segs = explode_segments(docs, "doc_id", "text")
    # segment counts per document straight from each row (no explode/shuffle)
    sizes = docs.select("doc_id", F.size(segment_texts("text")).alias("n"))
    return analyze(segs, docs.select("doc_id"), "doc_id", HashingEmbedder(DIM), OPTS, sizes=sizes)


@register(
    "doc_analysis",
    f"""
WITH RECURSIVE {ANALYSIS_SQL}
SELECT m.doc_id, CAST(m.rank AS BIGINT) AS rank, m.position, b.segment_id, round(m.rep, 6) AS score_representative,
       CASE WHEN m.rank = 1 THEN 'highly central' ELSE 'diversity pick' END AS reason
FROM m JOIN b ON b.doc_id = m.doc_id AND b.position = m.position
""",
)
def q_doc_analysis(spark, d):
    a = _analysis(spark, d)
    return a.selection.select(
        "doc_id", F.col("rank").cast("long").alias("rank"), "position", "segment_id",
        F.round("score_representative", 6).alias("score_representative"), "reason",
    )


@register(
    "doc_analysis_metrics",
    f"""
WITH RECURSIVE {ANALYSIS_SQL},
pk AS (SELECT doc_id, position, us[rank] AS u FROM m),
p AS ({S.pair_avg('pk', 'doc_id', 'position', 'u')}),
cnt AS (SELECT doc_id, count(*) AS num_segments FROM seg GROUP BY doc_id),
tn AS (SELECT doc_id, count(*) AS top_n FROM m GROUP BY doc_id)
SELECT d.doc_id, coalesce(cnt.num_segments, 0) AS num_segments, coalesce(tn.top_n, 0) AS top_n,
       CAST({OPTS.mmr_lambda!r} AS DOUBLE) AS mmr_lambda, round(coalesce(p.apc, 0.0), 6) AS avg_pairwise_cosine
FROM documents d LEFT JOIN cnt USING (doc_id) LEFT JOIN tn USING (doc_id) LEFT JOIN p USING (doc_id)
""",
)
def q_doc_analysis_metrics(spark, d):
    a = _analysis(spark, d)
    return a.metrics.select(
        "doc_id", "num_segments", "top_n", "mmr_lambda",
        F.round("avg_pairwise_cosine", 6).alias("avg_pairwise_cosine"),
    )
