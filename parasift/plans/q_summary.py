"""Registered summary queries (U1-U13) over the per-document analysis of the
``documents`` table; chat answers come from the ``conversations`` table
(every assistant turn of conversation ``conv_id = doc_id``)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.key_filter import FILTER_ROWS
from ..operators.segments import explode_segments
from ..operators.summary import (
    FALLBACK_MIN_REMAINDER,
    FALLBACK_PICKS,
    FALLBACK_REASON,
    FALLBACK_TARGET_BYTES,
    INSTRUCTIONS,
    build_prompt,
    extractive_summary,
    pick_lists,
    picks_tokens,
    resolve_picks,
    split_answer,
    summarize,
    summary_requests,
)
from ..functions.text import estimate_tokens
from ..options import SummarizerOptions
from ..sources.tables import read_table
from . import oracle_sql as S
from .pipeline import analyze
from .q_documents import ANALYSIS_SQL, DIM, OPTS
from .registry import register
from ..operators.embed import HashingEmbedder

SOPTS = SummarizerOptions()
STYLE = SOPTS.style


def _docs(spark, d):
    return read_table(spark, d, "documents").select("doc_id", "text", "lang")


def _picks(spark, d, resolve: bool = False):
    """Picks of the per-document analysis with their texts: carried through
    the selection, or (``resolve``) looked up in the segments (U1)."""
    docs = _docs(spark, d)
    segs = explode_segments(docs, "doc_id", "text")
    a = analyze(segs, docs.select("doc_id"), "doc_id", HashingEmbedder(DIM), OPTS)
    if resolve:
        return docs, resolve_picks(a.selection.select("doc_id", "rank", "segment_id"), segs, filter_rows=FILTER_ROWS)
    return docs, a.selection.select("doc_id", "rank", "segment_id", "text")


def responses_from_conversations(spark, d):
    """Chat responses table derived from the conversations: every assistant
    turn of conversation ``conv_id`` answers document ``doc_id = conv_id``."""
    conv = read_table(spark, d, "conversations").filter(F.col("role") == "assistant")
    body = F.to_json(F.struct(F.array(F.struct(F.struct(F.lit("assistant").alias("role"), F.col("text").alias("content")).alias("message"))).alias("choices")))
    return conv.select(
        F.col("conv_id").alias("doc_id"), "turn", F.lit(200).alias("status"), body.alias("body"),
        F.lit(None).cast("string").alias("error"),
    )


# ------------------------------------------------------------------ oracle
PICKS_SQL = f"""{ANALYSIS_SQL},
rp AS (SELECT m.doc_id, m.rank, b.segment_id FROM m JOIN b ON b.doc_id = m.doc_id AND b.position = m.position),
s1 AS (SELECT doc_id, segment_id, arg_max(text, position) AS text FROM seg GROUP BY doc_id, segment_id),
pt AS (SELECT rp.doc_id, rp.rank, rp.segment_id, s1.text FROM rp LEFT JOIN s1 USING (doc_id, segment_id)),
pl AS (SELECT doc_id, list(text ORDER BY rank) AS texts, list(segment_id ORDER BY rank) AS sids FROM pt GROUP BY doc_id)"""


def _sql_str(s: str) -> str:
    if s == "":
        return "''"
    parts = s.split("\n")
    return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)


def _prompt_sql(lang: str, texts: str) -> str:
    return (
        f"CASE WHEN coalesce({lang}, '') <> '' THEN 'Language: ' || {lang} || chr(10) ELSE '' END"
        f" || chr(10) || 'Selected Passages:' || chr(10)"
        f" || array_to_string(list_transform({texts}, lambda t, i: CAST(i AS VARCHAR) || '. ' || t || chr(10)), '')"
        f" || {_sql_str(INSTRUCTIONS[STYLE])}"
    )


def _prefix_sql(t: str, nbytes: str) -> str:
    """Longest prefix of t with at most nbytes UTF-8 bytes."""
    return (f"left({t}, coalesce(list_max(list_filter(range(0, greatest({nbytes}, 0) + 1), "
            f"lambda k: strlen(left({t}, k)) <= {nbytes})), 0))")


def _fallback_sql(texts: str) -> str:
    """The extractive rule unrolled over the first three texts."""
    buf, stop = "''", "false"
    for i in range(1, FALLBACK_PICKS + 1):
        t = f"{texts}[{i}]"
        have = f"(len({texts}) >= {i})"
        rem = f"greatest({FALLBACK_TARGET_BYTES} - strlen({buf}), 0)"
        over = f"(strlen({buf}) + strlen({t}) > {FALLBACK_TARGET_BYTES})"
        cut = f"CASE WHEN {rem} > {FALLBACK_MIN_REMAINDER} THEN {buf} || {_prefix_sql(t, rem)} || '...' ELSE {buf} END"
        nbuf = f"CASE WHEN {stop} OR NOT {have} THEN {buf} WHEN {over} THEN {cut} ELSE {buf} || {t} || ' ' END"
        nstop = f"({stop} OR ({have} AND {over}))"
        buf, stop = f"({nbuf})", nstop
    s = S.utrim(buf)
    return (f"CASE WHEN strlen({s}) > {FALLBACK_TARGET_BYTES} THEN {_prefix_sql(s, str(FALLBACK_TARGET_BYTES - 3))} || '...' "
            f"ELSE {s} END")


def _split_sql(content: str) -> tuple[str, str]:
    pos = f"instr({content}, chr(10) || '-')"
    head = S.utrim(f"substr({content}, 1, {pos} - 1)")
    tail = f"substr({content}, {pos} + 1)"
    lines = f"list_transform(string_split({tail}, chr(10)), lambda x: {S.utrim('x')})"
    bullets = (f"list_transform(list_filter({lines}, lambda x: starts_with(x, '- ') OR starts_with(x, '* ')), "
               f"lambda x: substr(x, 3))")
    return (f"CASE WHEN {pos} > 0 THEN {head} ELSE {content} END",
            f"CASE WHEN {pos} > 0 THEN {bullets} END")


RESP_SQL = """
resp AS (
  SELECT conv_id AS doc_id, turn, text AS content FROM conversations WHERE role = 'assistant'
)"""


# ------------------------------------------------------------------ queries
@register(
    "picks_with_text",
    f"""
WITH RECURSIVE {PICKS_SQL}
SELECT doc_id, CAST(rank AS BIGINT) AS rank, segment_id, text FROM pt
""",
)
def q_picks_with_text(spark, d):
    _, resolved = _picks(spark, d, resolve=True)
    return resolved.select("doc_id", F.col("rank").cast("long").alias("rank"), "segment_id", "text")


@register(
    "summary_prompt",
    f"""
WITH RECURSIVE {PICKS_SQL}
SELECT pl.doc_id, {_prompt_sql('d.lang', 'pl.texts')} AS prompt
FROM pl JOIN documents d USING (doc_id)
""",
)
def q_summary_prompt(spark, d):
    docs, resolved = _picks(spark, d)
    pl = pick_lists(resolved).join(docs.select("doc_id", "lang"), "doc_id")
    return pl.select("doc_id", build_prompt(F.lit(None).cast("string"), F.col("lang"), F.col("texts"), STYLE).alias("prompt"))


@register(
    "summary_extractive",
    f"""
WITH RECURSIVE {PICKS_SQL}
SELECT doc_id, {_fallback_sql('texts')} AS summary_text FROM pl
""",
)
def q_summary_extractive(spark, d):
    _, resolved = _picks(spark, d)
    return pick_lists(resolved).select("doc_id", extractive_summary(F.col("texts")).alias("summary_text"))


@register(
    "summary_tokens",
    f"""
WITH RECURSIVE {PICKS_SQL}
SELECT pl.doc_id,
       CAST(floor(length({_prompt_sql('d.lang', 'pl.texts')}) / 4) AS BIGINT) AS prompt_tokens,
       CAST(list_sum(list_transform(pl.texts, lambda t: floor(length(t) / 4))) AS BIGINT) AS picks_tokens,
       CAST(floor(length({_fallback_sql('pl.texts')}) / 4) AS BIGINT) AS fallback_tokens
FROM pl JOIN documents d USING (doc_id)
""",
)
def q_summary_tokens(spark, d):
    docs, resolved = _picks(spark, d)
    pl = pick_lists(resolved).join(docs.select("doc_id", "lang"), "doc_id")
    prompt = build_prompt(F.lit(None).cast("string"), F.col("lang"), F.col("texts"), STYLE)
    return pl.select(
        "doc_id",
        estimate_tokens(prompt).alias("prompt_tokens"),
        picks_tokens(F.col("texts")).alias("picks_tokens"),
        estimate_tokens(extractive_summary(F.col("texts"))).alias("fallback_tokens"),
    )


@register(
    "summary_requests",
    f"""
WITH RECURSIVE {PICKS_SQL}
SELECT pl.doc_id,
       CAST(to_json({{'model': '{SOPTS.model}', 'messages': [{{'role': 'user', 'content': {_prompt_sql('d.lang', 'pl.texts')}}}],
                     'temperature': CAST({SOPTS.temperature!r} AS DOUBLE), 'max_tokens': CAST(NULL AS BIGINT)}}) AS VARCHAR) AS body
FROM pl JOIN documents d USING (doc_id)
""",
)
def q_summary_requests(spark, d):
    docs, resolved = _picks(spark, d)
    req = summary_requests(docs, pick_lists(resolved), opts=SOPTS, title=None)
    return req.select("doc_id", "body")


@register(
    "summary_parse",
    f"""
WITH a AS (SELECT conv_id, turn, text AS content FROM conversations WHERE role = 'assistant'),
p AS (SELECT conv_id, turn, {_split_sql('content')[0]} AS summary_text, {_split_sql('content')[1]} AS bullets FROM a)
SELECT conv_id, turn, summary_text, CAST(len(bullets) AS BIGINT) AS n_bullets,
       array_to_string(bullets, chr(10)) AS bullets_joined
FROM p
""",
)
def q_summary_parse(spark, d):
    conv = read_table(spark, d, "conversations").filter(F.col("role") == "assistant")
    p = conv.select("conv_id", "turn", split_answer(F.col("text"), STYLE).alias("p"))
    return p.select(
        "conv_id", "turn", F.col("p.summary_text").alias("summary_text"),
        F.size("p.bullets").cast("long").alias("n_bullets"),
        F.array_join("p.bullets", "\n").alias("bullets_joined"),
    ).withColumn("n_bullets", F.when(F.col("bullets_joined").isNotNull(), F.col("n_bullets")))


def _final(spark, d):
    docs, resolved = _picks(spark, d)
    return summarize(docs, pick_lists(resolved), responses_from_conversations(spark, d), opts=SOPTS, title=None,
                     answer_keys="turn")


@register(
    "summary_final",
    f"""
WITH RECURSIVE {PICKS_SQL}, {RESP_SQL},
f AS (
  SELECT d.doc_id, coalesce(pl.texts, CAST([] AS VARCHAR[])) AS texts, d.lang, r.turn, r.content,
         {_split_sql('r.content')[0]} AS api_text, {_split_sql('r.content')[1]} AS api_bullets
  FROM documents d LEFT JOIN pl USING (doc_id) LEFT JOIN resp r USING (doc_id)
)
SELECT doc_id, turn,
       CASE WHEN content IS NOT NULL THEN api_text ELSE {_fallback_sql('texts')} END AS summary_text,
       CAST(CASE WHEN content IS NOT NULL THEN len(api_bullets) END AS BIGINT) AS n_bullets,
       CAST(CASE WHEN content IS NOT NULL THEN len(texts) END AS BIGINT) AS n_citations,
       content IS NULL AS filtered,
       CASE WHEN content IS NULL THEN '{FALLBACK_REASON}' END AS reason,
       CAST(CASE WHEN content IS NOT NULL THEN floor(length({_prompt_sql('lang', 'texts')}) / 4)
            ELSE coalesce(list_sum(list_transform(texts, lambda t: floor(length(t) / 4))), 0) END AS BIGINT) AS input_tokens,
       CAST(floor(length(CASE WHEN content IS NOT NULL THEN api_text ELSE {_fallback_sql('texts')} END) / 4) AS BIGINT) AS output_tokens
FROM f
""",
)
def q_summary_final(spark, d):
    s = _final(spark, d)
    return s.select(
        "doc_id", "turn", "summary_text", F.size("bullets").cast("long").alias("n_bullets"),
        F.size("citations").cast("long").alias("n_citations"),
        F.coalesce(F.col("guardrails.filtered"), F.lit(False)).alias("filtered"),
        F.col("guardrails.reason").alias("reason"), "input_tokens", "output_tokens",
    ).withColumn("n_bullets", F.when(F.col("n_bullets") >= 0, F.col("n_bullets"))).withColumn(
        "n_citations", F.when(F.col("n_citations") >= 0, F.col("n_citations")))


@register(
    "summary_citations",
    f"""
WITH RECURSIVE {PICKS_SQL}, {RESP_SQL}
SELECT pt.doc_id, resp.turn, CAST(pt.rank - 1 AS BIGINT) AS cite_pos, pt.segment_id, CAST(0 AS BIGINT) AS "start", CAST(0 AS BIGINT) AS "end"
FROM pt JOIN resp USING (doc_id)
""",
)
def q_summary_citations(spark, d):
    s = _final(spark, d)
    c = s.select("doc_id", "turn", F.posexplode("citations").alias("cite_pos", "c"))
    return c.select("doc_id", "turn", F.col("cite_pos").cast("long").alias("cite_pos"), "c.segment_id", "c.start", "c.end")
