"""Registered vector queries on the ``embeddings`` table.

Group = ``label`` (a topic), position = ``vec_id``.  These exercise the
vector operators (normalise, centroid, centroid similarity, redundancy) and
MMR selection (V4-V14) on precomputed embeddings.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.vectors import l2_normalize
from ..operators.analysis import analyze_groups, select_per_group
from ..operators.similarity import centroid_similarity, centroids, redundancy
from ..operators.pooling import mean_pool_tokens
from ..options import AnalyzerOptions
from ..sources.tables import read_table
from . import oracle_sql as S
from .registry import register

LAM = AnalyzerOptions().mmr_lambda


def _emb(spark, d):
    return read_table(spark, d, "embeddings")


@register(
    "vec_normalized",
    f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
n AS (SELECT vec_id, {S.unit('v')} AS u FROM e)
SELECT vec_id, i - 1 AS i, round(x, 6) AS x
FROM (SELECT vec_id, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM n)
""",
)
def q_vec_normalized(spark, d):
    e = _emb(spark, d)
    return e.select("vec_id", F.posexplode(l2_normalize("embedding")).alias("i", "x")).select(
        "vec_id", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")
    )


@register(
    "vec_centroid",
    f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
{S.centroid_cte('c', 'e', 'label', 'v')}
SELECT label, i - 1 AS i, round(x, 6) AS x
FROM (SELECT label, unnest(cv) AS x, generate_subscripts(cv, 1) AS i FROM c)
""",
)
def q_vec_centroid(spark, d):
    c = centroids(_emb(spark, d), "label", "embedding")
    return c.select("label", F.posexplode("centroid").alias("i", "x")).select(
        "label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")
    )


@register(
    "vec_centroid_similarity",
    f"""
WITH {S.vec_base()}
SELECT vec_id, label, round(rep, 6) AS score_representative FROM b
""",
)
def q_vec_centroid_similarity(spark, d):
    e = _emb(spark, d).select("vec_id", "label", "embedding")
    s = centroid_similarity(e, "label", "embedding")
    return s.select("vec_id", "label", F.round("score_representative", 6).alias("score_representative"))


@register(
    "vec_redundancy",
    f"""
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT vec_id, label, {S.unit('v')} AS u FROM e),
p AS ({S.pair_avg('u', 'label', 'vec_id')})
SELECT l.label, round(coalesce(p.apc, 0.0), 6) AS avg_pairwise_cosine
FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN p USING (label)
""",
)
def q_vec_redundancy(spark, d):
    r = redundancy(_emb(spark, d), "label", "embedding")
    return r.select("label", F.round("avg_pairwise_cosine", 6).alias("avg_pairwise_cosine"))


def _mmr_oracle(k: int, select: str) -> str:
    return f"""
WITH RECURSIVE {S.vec_base()},
{S.mmr_cte('m', 'b', 'label', 'vec_id', k, LAM)}
{select}
"""


@register(
    "mmr_top5",
    _mmr_oracle(
        5,
        """SELECT label, CAST(rank AS BIGINT) AS rank, vec_id, round(rep, 6) AS score_representative,
  CASE WHEN rank = 1 THEN 'highly central' ELSE 'diversity pick' END AS reason FROM m""",
    ),
)
def q_mmr_top5(spark, d):
    picks = analyze_groups(_emb(spark, d), ["label"], "vec_id", "embedding", k=5, lam=LAM)
    return picks.select(
        "label", F.col("rank").cast("long").alias("rank"), "vec_id",
        F.round("score_representative", 6).alias("score_representative"), "reason",
    )


@register(
    "mmr_shortlist",
    _mmr_oracle(
        AnalyzerOptions().top_m,
        "SELECT label, CAST(rank - 1 AS BIGINT) AS shortlist_pos, vec_id, round(mmr_score, 6) AS mmr_score FROM m",
    ),
)
def q_mmr_shortlist(spark, d):
    picks = analyze_groups(_emb(spark, d), ["label"], "vec_id", "embedding", k=AnalyzerOptions().top_m, lam=LAM)
    return picks.select(
        "label", (F.col("rank") - 1).cast("long").alias("shortlist_pos"), "vec_id",
        F.round("mmr_score", 6).alias("mmr_score"),
    )


@register(
    "analysis_metrics",
    f"""
WITH RECURSIVE {S.vec_base()},
{S.mmr_cte('m', 'b', 'label', 'vec_id', AnalyzerOptions().top_n, LAM)},
pk AS (SELECT label, vec_id, us[rank] AS u FROM m),
p AS ({S.pair_avg('pk', 'label', 'vec_id', 'u')}),
cnt AS (SELECT label, count(*) AS num_segments FROM embeddings GROUP BY label),
tn AS (SELECT label, count(*) AS top_n FROM m GROUP BY label)
SELECT cnt.label, cnt.num_segments, coalesce(tn.top_n, 0) AS top_n, CAST({LAM!r} AS DOUBLE) AS mmr_lambda,
       round(coalesce(p.apc, 0.0), 6) AS avg_pairwise_cosine
FROM cnt LEFT JOIN tn USING (label) LEFT JOIN p USING (label)
""",
)
def q_analysis_metrics(spark, d):
    from ..operators.analysis import group_metrics

    e = _emb(spark, d)
    picks = select_per_group(e, "label", "vec_id", "embedding", k=AnalyzerOptions().top_n, lam=LAM, keep_unit=True)
    m = group_metrics(e.select("label").distinct(), e, picks, "label", LAM)
    return m.select(
        "label", "num_segments", "top_n", "mmr_lambda",
        F.round("avg_pairwise_cosine", 6).alias("avg_pairwise_cosine"),
    )


@register(
    "masked_mean_pool",
    """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN vec_id > 0 THEN 1 ELSE 0 END AS mask FROM embeddings),
x AS (SELECT label, mask, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
s AS (SELECT label, i, sum(x * mask) AS sx, sum(mask) AS sm FROM x GROUP BY label, i)
SELECT label, i - 1 AS i, round(sx / CASE WHEN sm > 0 THEN sm ELSE 1 END, 6) AS x FROM s
""",
)
def q_masked_mean_pool(spark, d):
    # Each label is treated as one token sequence; the token id is vec_id and
    # the mask is ``id > 0`` exactly as for a tokenizer's output.
    e = _emb(spark, d).withColumn("mask", (F.col("vec_id") > 0).cast("int"))
    pooled = mean_pool_tokens(e, "label", "embedding", "mask")
    return pooled.select("label", F.posexplode("pooled").alias("i", "x")).select(
        "label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x")
    )
