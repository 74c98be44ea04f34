"""Re-ranking of the MMR shortlist.

The shortlist (``top_m`` MMR picks per document) is paired with one query
text per document and scored; the final ``top_n`` are the best-scored
shortlist rows, ties broken by shortlist position.  The default scorer is a
native token-overlap score; a user cross-encoder plugs in through
``predict_batch_udf`` over the ``(query, text)`` pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .embed import hash_tokens

# Query modes and the empty-document query.
QUERY_MODE_CENTROID_SUMMARY = "centroid_summary"
EMPTY_DOCUMENT_QUERY = "Document content"


def rerank_query(title: Column, first_segment: Column, mode: str = QUERY_MODE_CENTROID_SUMMARY) -> Column:
    """``centroid_summary``: ``title: first sentence`` of the first segment
    (text before the first ``.``; the title part only when non-empty).
    Other modes: the first segment, or a fixed text for an empty document."""
    if mode == QUERY_MODE_CENTROID_SUMMARY:
        first = F.coalesce(first_segment, F.lit(""))
        sentence = F.substring_index(first, ".", 1)
        t = F.coalesce(title, F.lit(""))
        return F.when(t != F.lit(""), F.concat(t, F.lit(": "), sentence)).otherwise(sentence)
    return F.coalesce(first_segment, F.lit(EMPTY_DOCUMENT_QUERY))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens that occur in the text (0 for an
    empty query)."""
    q = F.array_distinct(hash_tokens(query))
    s = F.array_distinct(hash_tokens(text))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, s)).cast("double") / F.size(q).cast("double")).otherwise(
        F.lit(0.0))


class OverlapScorer:
    fingerprint = "token-overlap@1"

    def score(self, pairs: DataFrame, query: str = "query", text: str = "text", out: str = "score_rerank") -> DataFrame:
        return pairs.withColumn(out, overlap_score(F.col(query), F.col(text)))


class ModelScorer:
    """User cross-encoder: ``make_predict_fn`` returns a function of two numpy
    string arrays (queries, texts) giving one relevance logit per pair."""

    def __init__(self, make_predict_fn: Callable, fingerprint: str, batch_size: int = 32):
        from pyspark.ml.functions import predict_batch_udf

        self.fingerprint = fingerprint
        self._udf = predict_batch_udf(make_predict_fn, return_type=T.FloatType(), batch_size=batch_size)

    def score(self, pairs: DataFrame, query: str = "query", text: str = "text", out: str = "score_rerank") -> DataFrame:
        return pairs.withColumn(out, self._udf(F.col(query), F.col(text)).cast("double"))


def rerank(shortlist: DataFrame, queries: DataFrame, keys=("doc_id",), scorer=None, top_n: int = 10) -> DataFrame:
    """Score ``shortlist`` rows (``keys, shortlist_pos, text, ...``) against
    their document's query and keep the ``top_n`` best per document.

    Adds ``score_rerank``, ``rank`` (1-based, after re-ranking) and ``reason``
    (``rerank: highly relevant`` for the row that headed the shortlist).
    Ordering: score descending with null/NaN last, then shortlist position.
    """
    k = [keys] if isinstance(keys, str) else list(keys)
    scorer = scorer or OverlapScorer()
    pairs = shortlist.join(queries.select(*k, "query"), k, "left")
    scored = scorer.score(pairs)
    s = F.nanvl(F.col("score_rerank"), F.lit(None).cast("double"))
    w = Window.partitionBy(*k).orderBy(s.desc_nulls_last(), F.col("shortlist_pos").asc())
    ranked = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= F.lit(top_n))
    reason = F.when(F.col("shortlist_pos") == 0, F.lit("rerank: highly relevant")).otherwise(F.lit("rerank: relevant"))
    return ranked.withColumn("reason", reason)


def rerank_preview(scored: DataFrame, keys=("doc_id",), n: int = 5) -> DataFrame:
    """Top ``n`` scored shortlist rows per document (diagnostic)."""
    k = [keys] if isinstance(keys, str) else list(keys)
    w = Window.partitionBy(*k).orderBy(F.col("score_rerank").desc_nulls_last(), F.col("shortlist_pos"))
    return scored.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def pair_window(query, text, max_len: int = 512) -> Column:
    """Token window of a (query, candidate) pair: query ids then candidate ids,
    cut from the candidate's tail to ``max_len`` and padded; mask = id > 0."""
    from ..functions.vectors import attention_mask, pad_truncate
    from .embed import token_ids

    q = F.col(query) if isinstance(query, str) else query
    t = F.col(text) if isinstance(text, str) else text
    ids = pad_truncate(F.concat(token_ids(q), token_ids(t)), max_len)
    return F.struct(ids.alias("ids"), attention_mask(ids).alias("mask"))
