"""Registered re-ranking queries (R1-R4, V10, V12) on the ``documents`` table:
shortlist = MMR top_m per document, scored by token overlap with the query."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..operators.embed import HashingEmbedder
from ..operators.rerank import overlap_score
from ..operators.segments import explode_segments, segment_texts
from ..sources.tables import read_table
from . import oracle_sql as S
from .pipeline import analyze, rerank_queries
from .q_documents import DIM, OPTS, analysis_sql
from .registry import register

ROPTS = replace(OPTS, rerank=True)
TOK = r"list_distinct(list_filter(regexp_split_to_array(lower({x}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> ''))"


def _tok(x: str) -> str:
    return TOK.format(x=x)


QUERY_SQL = """
q AS (
  SELECT d.doc_id, split_part(coalesce(s.text, ''), '.', 1) AS query
  FROM documents d LEFT JOIN seg s ON s.doc_id = d.doc_id AND s.position = 0
)"""

SHORT_SQL = f"""{analysis_sql(ROPTS.top_m)}, {QUERY_SQL},
sh AS (
  SELECT m.doc_id, CAST(m.rank - 1 AS BIGINT) AS shortlist_pos, b.segment_id, s.text, q.query
  FROM m JOIN b ON b.doc_id = m.doc_id AND b.position = m.position
  JOIN seg s ON s.doc_id = m.doc_id AND s.position = m.position
  JOIN q ON q.doc_id = m.doc_id
),
sc AS (
  SELECT *, CASE WHEN len({_tok('query')}) > 0
                 THEN CAST(len(list_intersect({_tok('query')}, {_tok('text')})) AS DOUBLE) / len({_tok('query')})
                 ELSE 0.0 END AS score_rerank
  FROM sh
)"""


def _docs(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text")


@register(
    "rerank_query",
    f"""
WITH {S.segments_cte('seg', 'documents', 'doc_id', 'text')}, {QUERY_SQL}
SELECT doc_id, query FROM q
""",
)
def q_rerank_query(spark, d):
    docs = _docs(spark, d)
    segs = explode_segments(docs, "doc_id", "text")
    return rerank_queries(segs, docs.select("doc_id"), "doc_id", ROPTS.query_mode)


@register(
    "rerank_overlap",
    f"""
WITH RECURSIVE {SHORT_SQL}
SELECT doc_id, shortlist_pos, segment_id, round(score_rerank, 6) AS score_rerank FROM sc
""",
)
def q_rerank_overlap(spark, d):
    from ..operators.analysis import analyze_groups
    from .pipeline import embed_segments

    docs = _docs(spark, d)
    segs = explode_segments(docs, "doc_id", "text")
    vectors = embed_segments(segs, HashingEmbedder(DIM))
    short = analyze_groups(vectors, ["doc_id"], "position", "embedding", k=ROPTS.top_m, lam=ROPTS.mmr_lambda,
                           payload=("segment_id", "text"))
    q = rerank_queries(segs, docs.select("doc_id"), "doc_id", ROPTS.query_mode)
    pairs = short.join(q, "doc_id")
    return pairs.select(
        "doc_id", (F.col("rank") - 1).cast("long").alias("shortlist_pos"), "segment_id",
        F.round(overlap_score(F.col("query"), F.col("text")), 6).alias("score_rerank"),
    )


@register(
    "rerank_top",
    f"""
WITH RECURSIVE {SHORT_SQL},
rk AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score_rerank DESC, shortlist_pos ASC) AS rank FROM sc
)
SELECT doc_id, CAST(rank AS BIGINT) AS rank, shortlist_pos, segment_id, round(score_rerank, 6) AS score_rerank,
       CASE WHEN shortlist_pos = 0 THEN 'rerank: highly relevant' ELSE 'rerank: relevant' END AS reason
FROM rk WHERE rank <= {ROPTS.top_n}
""",
)
def q_rerank_top(spark, d):
    docs = _docs(spark, d)
    segs = explode_segments(docs, "doc_id", "text")
    sizes = docs.groupBy("doc_id").agg(F.sum(F.size(segment_texts("text"))).alias("n"))
    a = analyze(segs, docs.select("doc_id"), "doc_id", HashingEmbedder(DIM), ROPTS, sizes=sizes)
    return a.selection.select(
        "doc_id", F.col("rank").cast("long").alias("rank"), "shortlist_pos", "segment_id",
        F.round("score_rerank", 6).alias("score_rerank"), "reason",
    )


@register(
    "rerank_metrics",
    f"""
WITH RECURSIVE {SHORT_SQL},
rk AS (
  SELECT sc.*, row_number() OVER (PARTITION BY doc_id ORDER BY score_rerank DESC, shortlist_pos ASC) AS rank FROM sc
),
fin AS (SELECT rk.doc_id, rk.shortlist_pos, m.us[rk.shortlist_pos + 1] AS u FROM rk JOIN m ON m.doc_id = rk.doc_id AND m.rank = rk.shortlist_pos + 1 WHERE rk.rank <= {ROPTS.top_n}),
p AS ({S.pair_avg('fin', 'doc_id', 'shortlist_pos', 'u')}),
cnt AS (SELECT doc_id, count(*) AS num_segments FROM seg GROUP BY doc_id),
tn AS (SELECT doc_id, count(*) AS top_n FROM fin GROUP BY doc_id)
SELECT d.doc_id, coalesce(cnt.num_segments, 0) AS num_segments, coalesce(tn.top_n, 0) AS top_n,
       round(coalesce(p.apc, 0.0), 6) AS avg_pairwise_cosine
FROM documents d LEFT JOIN cnt USING (doc_id) LEFT JOIN tn USING (doc_id) LEFT JOIN p USING (doc_id)
""",
)
def q_rerank_metrics(spark, d):
    docs = _docs(spark, d)
    segs = explode_segments(docs, "doc_id", "text")
    a = analyze(segs, docs.select("doc_id"), "doc_id", HashingEmbedder(DIM), ROPTS)
    return a.metrics.select("doc_id", "num_segments", "top_n", F.round("avg_pairwise_cosine", 6).alias("avg_pairwise_cosine"))
