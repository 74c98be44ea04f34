"""Summaries (U1-U13): prompts and chat requests out, answers in, extractive
fallback, citations, token estimates.

No executor talks to a network service: the chat step is split into a
*requests* table (one JSON body per document, for any offline batch runner)
and a *responses* table ``(doc key, status, body, error)`` read back in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import estimate_tokens, utf8_prefix, utrim
from ..options import SummarizerOptions
from .key_filter import key_bitmap, may_hold

# Prompt fragments, fallback rule and guardrail texts.
PROMPT_TITLE = "Document Title: "
PROMPT_LANG = "Language: "
PROMPT_PASSAGES = "\nSelected Passages:\n"
INSTRUCTIONS = {
    "abstract_with_bullets": (
        "\nInstructions:\n"
        "Please provide a concise summary of the selected passages above in 150-250 words.\n"
        "Also include 3-6 bullet points highlighting the key information.\n"
        "Do not include any information that is not present in the selected passages.\n"
        "Cite the passage numbers inline or list the sources used.\n"
        "If there is insufficient information to create a meaningful summary, please include a short \"Not in sources\" note.\n"
    ),
    "tldr": (
        "\nInstructions:\n"
        "Please provide a TL;DR (Too Long; Didn't Read) summary of the selected passages above in 50-100 words.\n"
        "Do not include any information that is not present in the selected passages.\n"
        "If there is insufficient information to create a meaningful summary, please include a short \"Not in sources\" note.\n"
    ),
    "extractive": "",
}
FALLBACK_PICKS = 3
FALLBACK_TARGET_BYTES = 200
FALLBACK_MIN_REMAINDER = 20
ELLIPSIS = "..."
FALLBACK_REASON = "API error or timeout, using extractive fallback"
JOB_FALLBACK_TEXT = "Summary generation failed. Using extractive fallback."
MISSING_SEGMENT = "Segment ID {id} not found in document"

CITATION = T.StructType([
    T.StructField("segment_id", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
])
GUARDRAILS = T.StructType([T.StructField("filtered", T.BooleanType()), T.StructField("reason", T.StringType())])


def _keys(keys):
    return [keys] if isinstance(keys, str) else list(keys)


# ---------------------------------------------------------------- U1 / U13
def resolve_picks(selection: DataFrame, segments: DataFrame, keys=("doc_id",), filter_rows: int | None = None) -> DataFrame:
    """Attach the text to every pick (left join on key + segment id).

    Segments are first reduced to one row per (key, segment_id) — the last
    position wins, as in a lookup map — so a repeated paragraph cannot fan
    the join out.  A pick whose id is not in its document keeps a null text
    and an ``error`` message.
    """
    k = _keys(keys)
    # only segments that some pick names are grouped; a small pick table is
    # broadcast by the planner, and then no segment text is shuffled at all
    wanted = selection.select(*k, "segment_id").distinct()
    if filter_rows:
        segments = may_hold(segments, key_bitmap(wanted, k + ["segment_id"], filter_rows), k + ["segment_id"], filter_rows)
    named = segments.join(wanted, k + ["segment_id"], "left_semi")
    seg1 = named.groupBy(*k, "segment_id").agg(F.max_by("text", "position").alias("text"))
    out = selection.join(seg1, k + ["segment_id"], "left")
    err = F.when(F.col("text").isNull(), F.format_string(MISSING_SEGMENT.replace("{id}", "%s"), F.col("segment_id")))
    return out.withColumn("error", err)


def pick_lists(resolved: DataFrame, keys=("doc_id",)) -> DataFrame:
    """One row per document: ``texts`` and ``segment_ids`` in pick order, and
    the first resolution error (if any).  ``resolved`` may also be a
    selection that already carries the pick ``text`` (no lookup needed)."""
    k = _keys(keys)
    if "error" not in resolved.columns:
        resolved = resolved.withColumn("error", F.lit(None).cast("string"))
    return resolved.groupBy(*k).agg(
        F.array_sort(F.collect_list(F.struct("rank", "text", "segment_id"))).alias("_p"),
        F.min("error").alias("error"),
    ).select(
        *k,
        F.transform("_p", lambda x: x["text"]).alias("texts"),
        F.transform("_p", lambda x: x["segment_id"]).alias("segment_ids"),
        "error",
    )


# ---------------------------------------------------------------- U2 / U3
def build_prompt(title: Column, lang: Column, texts: Column, style: str) -> Column:
    head = F.concat(
        F.when(F.coalesce(title, F.lit("")) != F.lit(""), F.concat(F.lit(PROMPT_TITLE), title, F.lit("\n"))).otherwise(F.lit("")),
        F.when(F.coalesce(lang, F.lit("")) != F.lit(""), F.concat(F.lit(PROMPT_LANG), lang, F.lit("\n"))).otherwise(F.lit("")),
        F.lit(PROMPT_PASSAGES),
    )
    passages = F.array_join(
        F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t, F.lit("\n"))), ""
    )
    return F.concat(head, passages, F.lit(INSTRUCTIONS[style]))


def request_body(prompt: Column, opts: SummarizerOptions) -> Column:
    """Chat-completion request JSON; a null ``max_tokens`` is written as null."""
    req = F.struct(
        F.lit(opts.model).alias("model"),
        F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"),
        F.lit(float(opts.temperature)).alias("temperature"),
        (F.lit(opts.max_tokens) if opts.max_tokens is not None else F.lit(None)).cast("long").alias("max_tokens"),
    )
    return F.to_json(req, {"ignoreNullFields": "false"})


# ---------------------------------------------------------------- U4 / U5 / U6
RESPONSE_BODY = T.StructType([
    T.StructField("choices", T.ArrayType(T.StructType([
        T.StructField("message", T.StructType([
            T.StructField("role", T.StringType()),
            T.StructField("content", T.StringType()),
        ])),
    ]))),
])


def response_outcome(status: Column, body: Column, error: Column) -> Column:
    """``struct(ok, content, failure)`` of one chat response row."""
    parsed = F.from_json(body, RESPONSE_BODY)
    content = F.get(parsed["choices"], 0)["message"]["content"]
    failure = (
        F.when(error.isNotNull(), F.concat(F.lit("no answer, transport: "), error))
        .when(status.isNull(), F.lit("no answer, time ran out"))
        .when((status < 200) | (status > 299),
              F.concat(F.lit("refused, HTTP "), status.cast("string"), F.lit(": "), F.coalesce(body, F.lit(""))))
        .when(parsed.isNull() | parsed["choices"].isNull(), F.lit("answer is not readable"))
        .when(F.size(parsed["choices"]) == 0, F.lit("answer has no choice"))
        .when(content.isNull(), F.lit("answer is not readable"))
    )
    return F.struct(failure.isNull().alias("ok"), content.alias("content"), failure.alias("failure"))


def split_answer(content: Column, style: str) -> Column:
    """``struct(summary_text, bullets)``.

    Bullets style: cut at the first ``\\n-``; the head (trimmed) is the
    summary and the ``- ``/``* `` lines after it are the bullets (marker
    removed).  Without ``\\n-``, or for other styles, the whole answer is the
    summary and bullets are null.
    """
    if style != "abstract_with_bullets":
        return F.struct(content.alias("summary_text"), F.lit(None).cast("array<string>").alias("bullets"))
    pos = F.instr(content, "\n-")
    head = utrim(F.substring(content, F.lit(1), pos - 1))
    tail = F.substr(content, pos + 1)
    tail_lines = F.transform(F.split(tail, "\n", -1), lambda x: utrim(x))
    bullets = F.transform(
        F.filter(tail_lines, lambda x: x.startswith("- ") | x.startswith("* ")),
        lambda x: F.substr(x, F.lit(3)),
    )
    return F.struct(
        F.when(pos > 0, head).otherwise(content).alias("summary_text"),
        F.when(pos > 0, bullets).alias("bullets"),
    )


def citations(segment_ids: Column) -> Column:
    return F.transform(
        segment_ids,
        lambda s: F.struct(s.alias("segment_id"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end")),
    )


# ---------------------------------------------------------------- U7 / U8
def extractive_summary(texts: Column) -> Column:
    """Extractive fallback over the picks in order.

    For each of the first three texts: if the buffer plus the text would pass
    200 bytes, append the part that still fits (cut at a character boundary)
    and ``...`` when more than 20 bytes remain, then stop; otherwise append
    the text and a space.  Finally trim; if still over 200 bytes, keep 197
    bytes (character boundary) and append ``...``.
    """
    target, minrem = FALLBACK_TARGET_BYTES, FALLBACK_MIN_REMAINDER
    init = F.struct(F.lit("").alias("buf"), F.lit(False).alias("stop"))

    def step(acc, t):
        buf = acc["buf"]
        rem = F.greatest(F.lit(target) - F.octet_length(buf), F.lit(0))
        over = F.octet_length(buf) + F.octet_length(t) > F.lit(target)
        cut = F.when(rem > F.lit(minrem), F.concat(buf, utf8_prefix(t, rem, bound=target), F.lit(ELLIPSIS))).otherwise(buf)
        return (
            F.when(acc["stop"], acc)
            .when(over, F.struct(cut.alias("buf"), F.lit(True).alias("stop")))
            .otherwise(F.struct(F.concat(buf, t, F.lit(" ")).alias("buf"), F.lit(False).alias("stop")))
        )

    def finish(acc):
        s = utrim(acc["buf"])
        return F.when(
            F.octet_length(s) > F.lit(target), F.concat(utf8_prefix(s, target - len(ELLIPSIS)), F.lit(ELLIPSIS))
        ).otherwise(s)

    return F.aggregate(F.slice(texts, 1, FALLBACK_PICKS), init, step, finish)


def picks_tokens(texts: Column) -> Column:
    """Sum of the token estimates of all picks."""
    return F.aggregate(texts, F.lit(0).cast("long"), lambda a, t: a + estimate_tokens(t))


# ---------------------------------------------------------------- U9 / U12
def summarize(
    docs: DataFrame,
    picks: DataFrame,
    responses: DataFrame | None = None,
    keys=("doc_id",),
    opts: SummarizerOptions | None = None,
    title: str | None = "title",
    lang: str | None = "lang",
    answer_keys=(),
) -> DataFrame:
    """One summary row per document in ``docs``; ``picks`` as in :func:`pick_lists`.

    ``responses`` (``keys, status, body, error``) holds the chat answers, one
    for a document unless ``answer_keys`` name the columns that tell its
    answers apart: then every answer has a row (with those columns), and a
    document without any has one row where they are null.  A
    document without a usable answer — or any document under the
    ``extractive`` style — gets the extractive fallback with
    ``guardrails.filtered = true``.  A document whose picks did not resolve
    gets the fixed job-level fallback row instead of failing the job.
    """
    opts = opts or SummarizerOptions()
    k, ak = _keys(keys), _keys(answer_keys)
    tcol = F.col(title) if title and title in docs.columns else F.lit(None).cast("string")
    lcol = F.col(lang) if lang and lang in docs.columns else F.lit(None).cast("string")
    d = docs.select(*k, tcol.alias("_title"), lcol.alias("_lang"))
    # the documents drive: one without picks has empty lists and gets a row too
    base = d.join(picks, k, "left")
    for c in ("texts", "segment_ids"):
        base = base.withColumn(c, F.coalesce(F.col(c), F.array().cast("array<string>")))
    base = base.withColumn("prompt", build_prompt(F.col("_title"), F.col("_lang"), F.col("texts"), opts.style))
    if responses is not None and opts.style != "extractive":
        # of several answers under one key: a usable one first, then the largest
        r = responses.select(*k, *ak, response_outcome(F.col("status"), F.col("body"), F.col("error")).alias("_r"))
        r = r.groupBy(*k, *ak).agg(F.max("_r").alias("_r"))
        base = base.join(r, k, "left")
        ok = F.coalesce(F.col("_r.ok"), F.lit(False))
        content = F.col("_r.content")
    else:
        for c in ak:
            base = base.withColumn(c, F.lit(None).cast(responses.schema[c].dataType if responses is not None else "string"))
        ok = F.lit(False)
        content = F.lit(None).cast("string")
    parsed = split_answer(content, opts.style)
    fallback = extractive_summary(F.col("texts"))
    resolved = F.col("error").isNull()
    summary_text = (
        F.when(~resolved, F.lit(JOB_FALLBACK_TEXT)).when(ok, parsed["summary_text"]).otherwise(fallback)
    )
    bullets = F.when(resolved & ok, parsed["bullets"])
    cites = F.when(resolved & ok, citations(F.col("segment_ids")))
    guard = (
        F.when(~resolved, F.struct(F.lit(True).alias("filtered"), F.concat(F.lit("API error: "), F.col("error")).alias("reason")))
        .when(ok, F.lit(None).cast(GUARDRAILS))
        .otherwise(F.struct(F.lit(True).alias("filtered"), F.lit(FALLBACK_REASON).alias("reason")))
    )
    in_tokens = (
        F.when(~resolved, F.lit(0).cast("long"))
        .when(ok, estimate_tokens(F.col("prompt")))
        .otherwise(picks_tokens(F.col("texts")))
    )
    out = base.select(*k, *ak, summary_text.alias("summary_text"), bullets.alias("bullets"), cites.alias("citations"),
                      guard.alias("guardrails"), in_tokens.alias("input_tokens"))
    out_tokens = F.when(F.col("guardrails.reason").startswith("API error: "), F.lit(0).cast("long")).otherwise(
        estimate_tokens(F.col("summary_text")))
    return out.withColumn("output_tokens", out_tokens).withColumn(
        "metrics",
        F.struct(F.lit(None).cast("long").alias("processing_time_ms"), F.col("input_tokens"), F.col("output_tokens")),
    )


def summary_requests(docs: DataFrame, picks: DataFrame, keys=("doc_id",), opts: SummarizerOptions | None = None,
                     title: str | None = "title", lang: str | None = "lang") -> DataFrame:
    """The requests table: ``keys, prompt, body`` (one chat request per document)."""
    opts = opts or SummarizerOptions()
    k = _keys(keys)
    tcol = F.col(title) if title and title in docs.columns else F.lit(None).cast("string")
    lcol = F.col(lang) if lang and lang in docs.columns else F.lit(None).cast("string")
    d = docs.select(*k, tcol.alias("_title"), lcol.alias("_lang"))
    base = picks.join(d, k, "left")
    prompt = build_prompt(F.col("_title"), F.col("_lang"), F.col("texts"), opts.style)
    return base.select(*k, prompt.alias("prompt")).withColumn("body", request_body(F.col("prompt"), opts))
