"""Registered queries of request attempts, length batches and weak spots of
earlier ones: titles in re-rank queries, malformed store keys, masked tokens
(U3, U4, V1-V3, R1, C2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.ids import parse_store_key
from ..operators.attempts import AttemptLedger
from ..operators.extract import text_content_expr, title_expr
from ..operators.length_batches import BUCKET_STEP, MAX_LEN, by_length, length_bucket, token_count
from ..operators.pooling import mean_pool_tokens
from ..operators.rerank import EMPTY_DOCUMENT_QUERY, rerank_query
from ..operators.segments import explode_segments, title_fallback
from ..operators.summary import request_body
from ..options import SummarizerOptions
from ..session import ensure_checkpoint_dir, write_scratch
from ..sources.tables import read_table
from . import oracle_sql as S
from .q_documents import SEG_SQL
from .q_flows import PAGE_SEG_SQL
from .q_pages import page_nodes
from .q_store import LOCAL_FP
from .registry import register

MAX_ATTEMPTS, SHARDS = 3, 8
SOPTS = SummarizerOptions()


def _attempt_outcomes(issued, replies):
    """What comes back for each issued request, by a rule over its keys: one in
    ten is refused for good; of four others in turn one loses its connection, one
    is told to wait, one never comes back and one is answered."""
    code = (F.col("conv_id") + 3 * F.col("turn") + F.col("attempt")) % 4
    refused = F.col("conv_id") % 10 == 9
    choice = F.struct(F.struct(F.lit("assistant").alias("role"), F.col("reply").alias("content")).alias("message"))
    answer = F.to_json(F.struct(F.when(F.col("reply").isNull(), F.array().cast(
        "array<struct<message:struct<role:string,content:string>>>")).otherwise(F.array(choice)).alias("choices")))
    rows = issued.join(replies, ["conv_id", "turn"], "left").filter(refused | (code != 2))
    return rows.select(
        "request_id",
        F.when(refused, 400).when(code == 1, 429).when(code == 3, 200).alias("status"),
        F.when(refused, "bad request").when(code == 1, "slow down").when(code == 3, answer).alias("body"),
        F.when(~refused & (code == 0), "connection lost").alias("error"))


@register(
    "request_ledger",
    f"""
WITH u AS (SELECT conv_id, turn, text, (conv_id + 3 * turn) % 4 AS h, conv_id % 10 = 9 AS refused,
                  sha256(concat_ws(chr(31), CAST(conv_id AS VARCHAR), CAST(turn AS VARCHAR), CAST(to_json(
                    {{'model': '{SOPTS.model}', 'messages': [{{'role': 'user', 'content': coalesce(text, '')}}],
                      'temperature': CAST({SOPTS.temperature!r} AS DOUBLE), 'max_tokens': CAST(NULL AS BIGINT)}}) AS VARCHAR))) AS request_id
           FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn - 1 AS turn, max(text) AS reply FROM conversations WHERE role = 'assistant' GROUP BY ALL),
x AS (SELECT u.*, reply, NOT refused AND h < 3 AND reply IS NOT NULL AS ok FROM u LEFT JOIN a USING (conv_id, turn))
SELECT conv_id, turn, request_id, CAST('0x' || substr(request_id, 1, 8) AS BIGINT) % {SHARDS} AS shard,
       CAST(CASE WHEN refused THEN 1 WHEN ok THEN 3 - h ELSE {MAX_ATTEMPTS} END AS INTEGER) AS attempts,
       CASE WHEN ok THEN 'answered' WHEN refused THEN 'refused' ELSE 'exhausted' END AS state,
       CAST(CASE WHEN ok THEN 3 - h END AS INTEGER) AS answer_attempt, CASE WHEN ok THEN reply END AS content,
       CASE WHEN ok THEN NULL WHEN refused THEN 'refused, HTTP 400: bad request' WHEN h = 0 THEN 'answer has no choice'
            WHEN h = 1 THEN 'no answer, transport: connection lost' WHEN h = 2 THEN 'refused, HTTP 429: slow down'
            ELSE 'no answer, time ran out' END AS failure
FROM x
""",
)
def q_request_ledger(spark, d):
    """Every user turn as a request, up to three rounds of attempts, each
    written and merged before the next is issued."""
    conv = read_table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    ledger = AttemptLedger(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/attempts-{uuid.uuid4().hex}", MAX_ATTEMPTS, SHARDS)
    users = conv.filter("role = 'user'").select("conv_id", "turn", request_body(F.coalesce("text", F.lit("")), SOPTS).alias("body"))
    requests = ledger.requests(users, ["conv_id", "turn"])
    replies = conv.filter("role = 'assistant'").groupBy("conv_id", (F.col("turn") - 1).alias("turn")).agg(F.max("text").alias("reply"))
    for n in range(1, MAX_ATTEMPTS + 1):
        issued = ledger.issue(requests, n)
        ledger.record(n, issued, _attempt_outcomes(issued, replies))
    return ledger.table(requests).drop("body")


_TOKENS = "len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> ''))"


@register(
    "length_batches",
    f"""
WITH {SEG_SQL},
t AS (SELECT text, least({_TOKENS}, {MAX_LEN}) AS n FROM (SELECT DISTINCT text FROM seg)),
b AS (SELECT n, least(greatest(CAST(ceil(n / {BUCKET_STEP}.0) AS BIGINT), 1) * {BUCKET_STEP}, {MAX_LEN}) AS bucket FROM t)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS texts, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(bucket - n) AS BIGINT) AS padded,
       CAST(sum({MAX_LEN} - n) AS BIGINT) AS padded_window
FROM b GROUP BY bucket
""",
)
def q_length_batches(spark, d):
    """Distinct segments dealt by length: padding of each bucket, and what a
    fixed window would pad."""
    segs = explode_segments(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    # written, as dealing reads them twice
    texts, _ = write_scratch(segs.select("text").distinct(), "length-texts")
    dealt = by_length(texts, spark.sparkContext.defaultParallelism)
    n = dealt.select(token_count("text").alias("n"))
    return n.groupBy(length_bucket(F.col("n")).alias("bucket")).agg(
        F.count(F.lit(1)).alias("texts"), F.sum("n").cast("long").alias("tokens"),
        F.sum(length_bucket(F.col("n")) - F.col("n")).cast("long").alias("padded"),
        F.sum(F.lit(MAX_LEN) - F.col("n")).cast("long").alias("padded_window"))


@register(
    "rerank_query_titles",
    f"""
WITH {PAGE_SEG_SQL},
p AS (SELECT tt.page_id, coalesce(tt.title, string_split(tt.url, '/')[-1]) AS title, s.text
      FROM tt LEFT JOIN seg s ON s.doc_id = tt.page_id AND s.position = 0)
SELECT page_id, CASE WHEN coalesce(title, '') <> '' THEN title || ': ' ELSE '' END || split_part(coalesce(text, ''), '.', 1) AS summary_query,
       coalesce(text, '{EMPTY_DOCUMENT_QUERY}') AS segment_query
FROM p
""",
)
def q_rerank_query_titles(spark, d):
    """Both query modes over pages, whose documents have titles."""
    pages = page_nodes(spark, d).select(
        "page_id", title_fallback(title_expr(), "url").alias("title"), text_content_expr().alias("text"))
    first = explode_segments(pages, "page_id", "text").filter("position = 0").select("page_id", F.col("text").alias("first"))
    q = pages.select("page_id", "title").join(first, "page_id", "left")
    return q.select("page_id", rerank_query(F.col("title"), F.col("first")).alias("summary_query"),
                    rerank_query(F.col("title"), F.col("first"), "first_segment").alias("segment_query"))


@register(
    "store_keys_malformed",
    f"""
WITH {SEG_SQL},
k AS (SELECT doc_id, position, segment_id, CASE position % 6
        WHEN 0 THEN 'emb:' || segment_id || ':{LOCAL_FP}' WHEN 1 THEN 'vec:' || segment_id || ':m' WHEN 2 THEN 'emb:' || segment_id
        WHEN 3 THEN segment_id WHEN 4 THEN 'emb:' || segment_id || ':' ELSE NULL END AS key FROM seg)
SELECT doc_id, position, key, position % 6 IN (0, 4) AS parsed, CASE WHEN position % 6 IN (0, 4) THEN segment_id END AS segment_id,
       CASE position % 6 WHEN 0 THEN '{LOCAL_FP}' WHEN 4 THEN '' END AS model_fingerprint
FROM k
""",
)
def q_store_keys_malformed(spark, d):
    """Keys of six kinds, four of them malformed or missing, parsed."""
    segs = explode_segments(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    kind, sid = F.col("position") % 6, F.col("segment_id")
    key = (F.when(kind == 0, F.concat(F.lit("emb:"), sid, F.lit(f":{LOCAL_FP}"))).when(kind == 1, F.concat(F.lit("vec:"), sid, F.lit(":m")))
           .when(kind == 2, F.concat(F.lit("emb:"), sid)).when(kind == 3, sid).when(kind == 4, F.concat(F.lit("emb:"), sid, F.lit(":"))))
    p = segs.select("doc_id", "position", key.alias("key")).withColumn("p", parse_store_key("key"))
    return p.select("doc_id", "position", "key", F.col("p").isNotNull().alias("parsed"), F.col("p.segment_id").alias("segment_id"),
                    F.col("p.model_fingerprint").alias("model_fingerprint"))


@register(
    "masked_sequences",
    """
WITH e AS (SELECT label, CAST(embedding AS DOUBLE[]) AS v, CASE WHEN vec_id % 3 = 0 OR label % 4 = 1 THEN 0 ELSE 1 END AS mask FROM embeddings),
x AS (SELECT label, mask, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
s AS (SELECT label, i, sum(x * mask) AS sx, sum(mask) AS sm FROM x GROUP BY label, i)
SELECT label, i - 1 AS i, round(sx / CASE WHEN sm > 0 THEN sm ELSE 1 END, 6) AS x FROM s
""",
)
def q_masked_sequences(spark, d):
    """Pooling where the mask hides a third of the tokens and, in a quarter of
    the sequences, all of them."""
    hidden = (F.col("vec_id") % 3 == 0) | (F.col("label") % 4 == 1)
    e = read_table(spark, d, "embeddings").select("label", "embedding", F.when(hidden, 0).otherwise(1).alias("mask"))
    return mean_pool_tokens(e, "label", "embedding", "mask").select("label", F.posexplode("pooled").alias("i", "x")).select(
        "label", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))
