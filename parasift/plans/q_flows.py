"""Registered end-to-end queries: pages -> documents -> analysis -> summary,
stored analyses, coverage, store rules and chat outcomes.

The oracles are written from the rules and start from the input tables, so
that an input without picks, segments or a valid vector is visible.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.ids import CHUNK_PARAMS, PRODUCER_TAG
from ..operators.analysis import mark_invalid
from ..operators.embed import HashingEmbedder
from ..operators.segments import content_doc_id, explode_segments
from ..operators.store import lookup_flagged
from ..operators.summary import INSTRUCTIONS, build_prompt, response_outcome
from ..sources.tables import read_table
from . import oracle_sql as S
from .pipeline import analyze_documents, run_pages, summarize_documents
from .q_documents import ANALYSIS_SQL, DIM, OPTS, SEG_SQL
from .q_summary import PICKS_SQL, _fallback_sql, _sql_str
from .registry import register

PAGES = S.pages_ctes()
PAGE_SEG_SQL = f"""{PAGES}, {S.paragraphs_sql()}, {S.title_sql()},
page_docs AS (SELECT page_id AS doc_id, text_content AS text FROM tcx),
{S.segments_cte('seg', 'page_docs', 'doc_id', 'text')}"""
HASH_SQL = f"""
dh AS (
  SELECT p.page_id AS doc_id,
         sha256(coalesce(string_agg(s.text, chr(10) ORDER BY s.position), '') || '{CHUNK_PARAMS}' || '{PRODUCER_TAG}') AS doc_hash,
         count(s.position) AS num_segments
  FROM pages p LEFT JOIN seg s ON s.doc_id = p.page_id GROUP BY p.page_id)"""
FETCHED = "2024-01-01 00:00:00"


def _run(spark, d):
    pages = read_table(spark, d, "pages").select("page_id", "url", "html")
    return run_pages(pages, OPTS, embedder=HashingEmbedder(DIM), fetched_at=F.lit(FETCHED).cast("timestamp"))


@register(
    "pages_documents",
    f"""
WITH {PAGE_SEG_SQL}, {HASH_SQL}
SELECT tt.page_id, dh.doc_hash AS doc_id, tt.url, coalesce(tt.title, string_split(tt.url, '/')[-1]) AS title,
       'en' AS lang, '2024-01-01T00:00:00.000000Z' AS fetched_at, dh.num_segments
FROM tt JOIN dh ON dh.doc_id = tt.page_id
""",
)
def q_pages_documents(spark, d):
    return _run(spark, d).documents.select(
        "page_id", "doc_id", "url", "title", "lang", "fetched_at", F.size("segments").cast("long").alias("num_segments"))


@register(
    "pages_analysis",
    f"""
WITH RECURSIVE {ANALYSIS_SQL.replace(SEG_SQL, PAGE_SEG_SQL)}, {HASH_SQL},
tn AS (SELECT doc_id, count(*) AS top_n FROM m GROUP BY doc_id)
SELECT p.page_id, dh.doc_hash AS doc_id, '{HashingEmbedder(DIM).fingerprint}' AS model_fingerprint, dh.num_segments,
       coalesce(tn.top_n, 0) AS top_n, CAST(m.rank AS BIGINT) AS rank, b.segment_id,
       round(m.rep, 6) AS score_representative
FROM pages p JOIN dh ON dh.doc_id = p.page_id LEFT JOIN tn ON tn.doc_id = p.page_id
LEFT JOIN m ON m.doc_id = p.page_id LEFT JOIN b ON b.doc_id = m.doc_id AND b.position = m.position
""",
)
def q_pages_analysis(spark, d):
    a = _run(spark, d).analysis
    return a.select(
        "page_id", "doc_id", "model_fingerprint", "metrics.num_segments", "metrics.top_n",
        F.posexplode_outer("top_segments").alias("pos", "s"),
    ).select(
        "page_id", "doc_id", "model_fingerprint", "num_segments", "top_n", (F.col("pos") + 1).cast("long").alias("rank"),
        "s.segment_id", F.round("s.score_representative", 6).alias("score_representative"))


@register(
    "pages_summary",
    f"""
WITH RECURSIVE {PICKS_SQL.replace(SEG_SQL, PAGE_SEG_SQL)},
f AS (SELECT p.page_id, coalesce(pl.texts, CAST([] AS VARCHAR[])) AS texts FROM pages p LEFT JOIN pl ON pl.doc_id = p.page_id)
SELECT page_id, {_fallback_sql('texts')} AS summary_text, true AS filtered,
       CAST(coalesce(list_sum(list_transform(texts, lambda t: floor(length(t) / 4))), 0) AS BIGINT) AS input_tokens
FROM f
""",
)
def q_pages_summary(spark, d):
    return _run(spark, d).summary.select("page_id", "summary_text", F.col("guardrails.filtered").alias("filtered"), "input_tokens")


@register(
    "stored_analysis_summary",
    f"""
WITH RECURSIVE {PICKS_SQL.replace(SEG_SQL, PAGE_SEG_SQL)}, {HASH_SQL},
f AS (SELECT dh.doc_hash, coalesce(pl.texts, CAST([] AS VARCHAR[])) AS texts FROM dh LEFT JOIN pl USING (doc_id))
SELECT doc_hash AS doc_id, {_fallback_sql('texts')} AS summary_text FROM f
""",
)
def q_stored_analysis_summary(spark, d):
    """Documents and analyses as stored records (JSON and back), then the summaries."""
    docs = _run(spark, d).documents.drop("page_id")
    analyses = analyze_documents(docs, OPTS, HashingEmbedder(DIM))
    back = lambda df: df.select(F.to_json(F.struct("*")).alias("j")).select(
        F.from_json("j", df.schema).alias("r")).select("r.*")
    summaries, _ = summarize_documents(back(analyses), back(docs))
    return summaries.select("doc_id", "summary_text")


@register(
    "doc_id_mismatch",
    f"""
WITH {SEG_SQL},
h AS (
  SELECT d.doc_id, d.lang,
         sha256(coalesce(string_agg(s.text, chr(10) ORDER BY s.position), '') || '{CHUNK_PARAMS}' || '{PRODUCER_TAG}') AS doc_hash
  FROM documents d LEFT JOIN seg s USING (doc_id) GROUP BY d.doc_id, d.lang)
SELECT doc_hash AS doc_id FROM h WHERE doc_hash NOT IN (SELECT doc_hash FROM h WHERE lang = 'en')
""",
)
def q_doc_id_mismatch(spark, d):
    """Analyses of all documents against the stored documents of one language."""
    rows = content_doc_id(read_table(spark, d, "documents").select("doc_id", "text", "lang"), "text").withColumn(
        "top_segments", F.array().cast("array<struct<segment_id:string>>"))
    analyses = rows.select(F.col("doc_hash").alias("doc_id"), "top_segments", F.col("doc_id").alias("row"))
    docs = rows.where("lang = 'en'").select(
        F.col("doc_hash").alias("doc_id"), F.lit("t").alias("title"), "lang",
        F.array().cast("array<struct<position:bigint,segment_id:string,text:string>>").alias("segments"))
    return summarize_documents(analyses, docs)[1]


@register(
    "analysis_coverage",
    """
WITH e AS (SELECT label, vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0 OR embedding IS NULL AS bad FROM embeddings)
SELECT label, count(*) AS num_rows, CAST(sum(CASE WHEN bad THEN 0 ELSE 1 END) AS BIGINT) AS analyzed
FROM e GROUP BY label
""",
)
def q_analysis_coverage(spark, d):
    """Rows of each topic and those whose vector takes part: every 7th vector
    is cut short, every 11th is missing, every 13th holds a NaN."""
    e = read_table(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    v = (
        F.when(F.col("vec_id") % 11 == 0, F.lit(None))
        .when(F.col("vec_id") % 13 == 0, F.transform("v", lambda x: F.lit(float("nan"))))
        .when(F.col("vec_id") % 7 == 0, F.slice("v", 1, 3)).otherwise(F.col("v"))
    )
    marked = mark_invalid(e.withColumn("v", v), "label", "v")
    return marked.groupBy("label").agg(F.count(F.lit(1)).alias("num_rows"), F.count("v").alias("analyzed"))


@register(
    "store_last_write",
    f"""
WITH {SEG_SQL},
w AS (SELECT segment_id, max(doc_id) FILTER (WHERE doc_id % 5 <> 0) AS last_doc FROM seg GROUP BY segment_id)
SELECT segment_id, last_doc IS NOT NULL AS hit, CAST(last_doc AS DOUBLE) AS stored FROM w
""",
)
def q_store_last_write(spark, d):
    """Every document writes its segments in the order of ids; each fifth
    writes invalid vectors.  The last valid write of a segment is read."""
    segs = explode_segments(read_table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    value = F.when(F.col("doc_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("doc_id")).cast("double")
    stored = segs.select("segment_id", F.array(value).alias("embedding"), F.timestamp_seconds("doc_id").alias("written_at"))
    return lookup_flagged(segs.select("segment_id").distinct(), stored, 1).select(
        "segment_id", "hit", F.col("embedding")[0].alias("stored"))


@register(
    "summary_outcomes",
    """
WITH a AS (SELECT conv_id, turn, text, (conv_id + turn) % 6 AS c FROM conversations WHERE role = 'assistant')
SELECT conv_id, turn, c IN (0, 1) AS ok, CASE WHEN c IN (0, 1) THEN text END AS content,
       CASE WHEN c = 2 THEN 'status' WHEN c = 3 THEN 'timeout' WHEN c = 4 THEN 'no choices' WHEN c = 5 THEN 'other' END AS outcome
FROM a
""",
)
def q_summary_outcomes(spark, d):
    """Every assistant turn as a chat response; its class follows from the
    conversation and turn: answered, refused, timed out, empty, broken."""
    c = (F.col("conv_id") + F.col("turn")) % 6
    message = F.struct(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"))
    choices = F.to_json(F.struct(F.array(message).alias("choices")))
    rows = read_table(spark, d, "conversations").where("role = 'assistant'").select(
        "conv_id", "turn",
        F.when(c == 2, 503).when(c == 3, F.lit(None)).otherwise(200).alias("status"),
        F.when(c == 2, "busy").when(c == 4, '{"choices":[]}').when(c == 5, "not json").when(c != 3, choices).alias("body"))
    r = response_outcome(F.col("status"), F.col("body"), F.lit(None).cast("string"))
    return rows.select("conv_id", "turn", r.alias("r")).select(
        "conv_id", "turn", "r.ok", "r.content",
        F.when(F.col("r.ok"), F.lit(None)).when(F.col("r.failure").contains("HTTP 503"), "status")
        .when(F.col("r.failure").contains("time ran out"), "timeout").when(F.col("r.failure").contains("no choice"), "no choices")
        .otherwise("other").alias("outcome"))


def _styles_sql() -> str:
    parts = [
        f"""SELECT conv_id, '{style}' AS style,
       CASE WHEN coalesce(title, '') <> '' THEN 'Document Title: ' || title || chr(10) ELSE '' END || chr(10)
       || 'Selected Passages:' || chr(10)
       || array_to_string(list_transform(texts, lambda t, i: CAST(i AS VARCHAR) || '. ' || t || chr(10)), '')
       || {_sql_str(text)} AS prompt FROM c""" for style, text in INSTRUCTIONS.items()]
    return ("WITH c AS (SELECT conv_id, list(text ORDER BY turn) FILTER (WHERE role = 'assistant') AS texts, "
            "arg_min(text, turn) FILTER (WHERE role = 'user') AS title FROM conversations GROUP BY conv_id "
            "HAVING count(*) FILTER (WHERE role = 'assistant') > 0) " + " UNION ALL ".join(parts))


@register("summary_styles", _styles_sql())
def q_summary_styles(spark, d):
    """The prompt in every style, a style per row: passages are a conversation's
    assistant turns, the title its first user turn."""
    conv = read_table(spark, d, "conversations")
    c = conv.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("t"),
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("title"),
    ).where(F.size("t") > 0).select("conv_id", F.transform("t", lambda x: x["text"]).alias("texts"), "title")
    rows = c.withColumn("style", F.explode(F.array(*[F.lit(s) for s in INSTRUCTIONS])))
    prompt = F.lit(None).cast("string")
    for s in INSTRUCTIONS:
        prompt = F.when(F.col("style") == s, build_prompt(F.col("title"), F.lit(None).cast("string"), F.col("texts"), s)).otherwise(prompt)
    return rows.select("conv_id", "style", prompt.alias("prompt"))
