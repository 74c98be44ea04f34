"""Registered queries of the exchange files, the staged job, pair windows,
previews and job-level fallbacks (S2-S4, S6, P6, R2, R5, U12, V1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.embed import DEFAULT_VOCAB, HashingEmbedder, token_window
from ..operators.rerank import pair_window, rerank_preview
from ..operators.segments import explode_segments, segment_struct_array, segment_texts
from ..operators.summary import JOB_FALLBACK_TEXT, MISSING_SEGMENT, pick_lists, resolve_picks, summarize
from ..schema import DOCUMENT
from ..session import ensure_checkpoint_dir
from ..sources.exchange import INCOMPLETE, UNREADABLE, read_records
from ..sources.tables import read_table
from .pipeline import rerank_queries
from .q_documents import DIM, OPTS, SEG_SQL
from .q_flows import FETCHED, PAGE_SEG_SQL
from .q_rerank import QUERY_SQL, ROPTS, SHORT_SQL, q_rerank_overlap
from .q_summary import PICKS_SQL, _fallback_sql
from .registry import register
from .stages import run_pages_job


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register(
    "json_round_trip",
    f"""
WITH {SEG_SQL},
s AS (SELECT doc_id, count(*) AS n, sha256(string_agg(text, chr(10) ORDER BY position)) AS h FROM seg GROUP BY doc_id),
n AS (SELECT count(*) FILTER (WHERE doc_id % 50 = 7) AS bad, count(*) FILTER (WHERE doc_id % 50 = 9) AS part FROM documents)
SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, CASE WHEN d.doc_id % 3 > 0 THEN d.source END AS title, d.lang,
       coalesce(s.n, 0) AS n_segments, coalesce(s.h, sha256('')) AS text_sha256, CAST(NULL AS VARCHAR) AS url,
       bad AS n_unreadable, part AS n_incomplete
FROM documents d LEFT JOIN s USING (doc_id), n WHERE d.doc_id % 50 NOT IN (7, 9)
""",
)
def q_json_round_trip(spark, d):
    """Nested documents with nulls as JSON lines; of each fifty, one line is
    cut in the middle and one lacks its id.  What is read back, and how many
    lines the quarantine holds by reason."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    record = F.struct(
        F.when(F.col("doc_id") % 50 != 9, F.col("doc_id").cast("string")).alias("doc_id"), F.lit(None).cast("string").alias("url"),
        F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("title"), "lang",
        segment_struct_array(segment_texts("text")).alias("segments"))
    line = F.to_json(record, {"ignoreNullFields": "false"})
    cut = F.when(F.col("doc_id") % 50 == 7, F.substring(line, F.lit(1), (F.length(line) / 2).cast("int"))).otherwise(line)
    path = _folder(spark, "exchange")
    docs.select(cut.alias("value")).write.text(path)
    good, bad = read_records(spark, path, DOCUMENT, required=["doc_id"], quarantine=_folder(spark, "quarantine"))
    count = bad.agg(F.count_if(F.col("reason") == UNREADABLE).alias("n_unreadable"),
                    F.count_if(F.col("reason") == INCOMPLETE + "doc_id").alias("n_incomplete"))
    texts = F.array_join(F.transform("segments", lambda s: s["text"]), "\n")
    return good.select(
        "doc_id", "title", "lang", F.size("segments").cast("long").alias("n_segments"), F.sha2(texts, 256).alias("text_sha256"), "url",
    ).join(F.broadcast(count))  # one row


@register(
    "pipeline_stages",
    f"""
WITH RECURSIVE {PICKS_SQL.replace(SEG_SQL, PAGE_SEG_SQL)},
n AS (SELECT (SELECT count(*) FROM pages) AS pages, (SELECT count(*) FROM seg) AS segs, (SELECT count(*) FROM m) AS picks)
SELECT stage, CAST(i - 1 AS INTEGER) AS position, CASE stage WHEN 'segments' THEN segs WHEN 'selection' THEN picks ELSE pages END AS rows,
       true AS timed, false AS reused
FROM n, (SELECT unnest(['documents', 'segments', 'selection', 'metrics', 'analysis', 'summary']) AS stage, unnest(range(1, 7)) AS i)
""",
)
def q_pipeline_stages(spark, d):
    """The staged page job: rows of every stage, and that each has its time."""
    pages = read_table(spark, d, "pages").select("page_id", "url", "html")
    _, job = run_pages_job(pages, _folder(spark, "stages"), OPTS, embedder=HashingEmbedder(DIM), fetched_at=F.lit(FETCHED).cast("timestamp"))
    return job.table().select("stage", "position", "rows", (F.col("seconds") > 0).alias("timed"), "reused")


def _ids_sql(text: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    return f"list_transform({words}, lambda x: CAST(('0x' || substr(md5(x), 1, 8)) AS BIGINT) % {DEFAULT_VOCAB - 1} + 1)"


PAIR_LEN, SHORT_LEN = 64, 12


@register(
    "pair_window",
    f"""
WITH {SEG_SQL}, {QUERY_SQL},
p AS (SELECT seg.doc_id, seg.position, list_concat({_ids_sql('q.query')}, {_ids_sql('seg.text')})[1:{PAIR_LEN}] AS ids FROM seg JOIN q USING (doc_id))
SELECT doc_id, position, CAST({PAIR_LEN} AS BIGINT) AS window_len, CAST(len(ids) AS BIGINT) AS n_real,
       CAST(coalesce(list_sum(list_transform(ids, lambda x, i: x * i)), 0) AS BIGINT) AS weighted,
       repeat('1', len(ids)) || repeat('0', {PAIR_LEN} - len(ids)) AS mask
FROM p
""",
)
def q_pair_window(spark, d):
    """Token windows of every (query, segment) pair of a document: order by
    the position-weighted sum, padding and cut by the mask."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    segs = explode_segments(docs, "doc_id", "text")
    pairs = segs.join(rerank_queries(segs, docs.select("doc_id"), "doc_id", ROPTS.query_mode), "doc_id")
    w = pairs.select("doc_id", "position", pair_window("query", "text", PAIR_LEN).alias("w"))
    total = F.aggregate(F.transform("w.ids", lambda x, i: x * (i + 1)), F.lit(0).cast("long"), lambda a, x: a + x)
    return w.select(
        "doc_id", "position", F.size("w.ids").cast("long").alias("window_len"),
        F.aggregate("w.mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_real"), total.alias("weighted"),
        F.array_join(F.transform("w.mask", lambda x: x.cast("string")), "").alias("mask"))


@register(
    "token_window_ids",
    f"""
WITH {SEG_SQL},
t AS (SELECT doc_id, position, {_ids_sql('text')} AS ids FROM seg)
SELECT doc_id, position, CAST(i AS BIGINT) AS i, CAST(coalesce(ids[i + 1], 0) AS BIGINT) AS id, CAST(CASE WHEN i < len(ids) THEN 1 ELSE 0 END AS BIGINT) AS mask
FROM (SELECT *, unnest(range({SHORT_LEN})) AS i FROM t)
""",
)
def q_token_window_ids(spark, d):
    """Ids and mask of a short window, place by place."""
    segs = explode_segments(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    w = segs.select("doc_id", "position", token_window("text", SHORT_LEN).alias("w"))
    return w.select("doc_id", "position", F.posexplode(F.arrays_zip("w.ids", "w.mask")).alias("i", "z")).select(
        "doc_id", "position", F.col("i").cast("long").alias("i"), F.col("z.ids").alias("id"), F.col("z.mask").cast("long").alias("mask"))


PREVIEW = 5


@register(
    "rerank_preview",
    f"""
WITH RECURSIVE {SHORT_SQL}
SELECT doc_id, shortlist_pos, segment_id, round(score_rerank, 6) AS score_rerank FROM sc
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score_rerank, 6) DESC, shortlist_pos) <= {PREVIEW}
""",
)
def q_rerank_preview(spark, d):
    return rerank_preview(q_rerank_overlap(spark, d), "doc_id", PREVIEW)


_MISSING = MISSING_SEGMENT.replace("{id}", "' || 'gone-' || d.doc_id || '")


@register(
    "summary_unresolved",
    f"""
WITH {SEG_SQL},
p AS (SELECT doc_id, list(text ORDER BY position) AS texts FROM seg WHERE position < 2 GROUP BY doc_id),
f AS (SELECT d.doc_id, coalesce(p.texts, CAST([] AS VARCHAR[])) AS texts, d.doc_id % 7 = 0 AND p.texts IS NOT NULL AS gone
      FROM documents d LEFT JOIN p USING (doc_id))
SELECT doc_id, CASE WHEN gone THEN '{JOB_FALLBACK_TEXT}' ELSE {_fallback_sql('texts')} END AS summary_text,
       CASE WHEN gone THEN (SELECT 'API error: {_MISSING}' FROM (SELECT f.doc_id AS doc_id) d) END AS error,
       CAST(CASE WHEN gone THEN 0 ELSE coalesce(list_sum(list_transform(texts, lambda t: floor(length(t) / 4))), 0) END AS BIGINT) AS input_tokens
FROM f
""",
)
def q_summary_unresolved(spark, d):
    """The first two segments as picks; in each seventh document the first
    names a segment that does not exist."""
    docs = read_table(spark, d, "documents").select("doc_id", "text", "lang")
    segs = explode_segments(docs, "doc_id", "text")
    gone = (F.col("doc_id") % 7 == 0) & (F.col("position") == 0)
    selection = segs.filter("position < 2").select(
        "doc_id", (F.col("position") + 1).cast("int").alias("rank"),
        F.when(gone, F.concat(F.lit("gone-"), F.col("doc_id").cast("string"))).otherwise(F.col("segment_id")).alias("segment_id"))
    out = summarize(docs, pick_lists(resolve_picks(selection, segs)), None, title=None)
    error = F.when(F.col("guardrails.reason").startswith("API error: "), F.col("guardrails.reason"))
    return out.select("doc_id", "summary_text", error.alias("error"), "input_tokens")
