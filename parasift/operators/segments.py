"""Segmentation and document building (narrow transformations, no shuffle).

A text becomes segments line by line: split on newlines, drop blank lines,
trim, and number the survivors densely from 0.  Segment ids are content
hashes; the document id hashes the segment texts joined by newlines with the
chunking parameters and producer tag appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import CHUNK_PARAMS, PRODUCER_TAG, SCHEMA_VERSION, doc_id_from_texts, segment_id
from ..functions.text import utrim


def segment_texts(text) -> Column:
    """``array<string>`` of trimmed non-blank lines, in order."""
    c = F.col(text) if isinstance(text, str) else text
    # trimming also removes the "\r" of a "\r\n" line end
    trimmed = F.transform(F.split(F.coalesce(c, F.lit("")), "\n", -1), lambda x: utrim(x))
    return F.filter(trimmed, lambda x: x != F.lit(""))


def segment_struct_array(texts: Column) -> Column:
    """``array<struct<segment_id, text, path, position>>`` from segment texts."""
    return F.transform(
        texts,
        lambda t, i: F.struct(
            segment_id(t).alias("segment_id"),
            t.alias("text"),
            F.concat(F.lit("p["), i.cast("string"), F.lit("]")).alias("path"),
            i.cast("long").alias("position"),
        ),
    )


def with_segment_array(df: DataFrame, text: str, out: str = "_segtexts") -> DataFrame:
    return df.withColumn(out, segment_texts(text))


def explode_segments(df: DataFrame, keys, text: str, keep=()) -> DataFrame:
    """Long segments table: ``keys, position, path, segment_id, text`` (+ ``keep``).

    One output row per kept line; rows with no segments produce no rows.
    """
    k = [keys] if isinstance(keys, str) else list(keys)
    base = df.select(*k, *keep, F.posexplode(segment_texts(text)).alias("position", "text"))
    return base.select(
        *k,
        *keep,
        F.col("position").cast("long").alias("position"),
        F.concat(F.lit("p["), F.col("position").cast("string"), F.lit("]")).alias("path"),
        segment_id("text").alias("segment_id"),
        "text",
    )


def content_doc_id(df: DataFrame, text: str, out: str = "doc_hash",
                   chunk_params: str = CHUNK_PARAMS, producer: str = PRODUCER_TAG) -> DataFrame:
    """Per-row document id from the row's own text (no grouping needed)."""
    return df.withColumn(out, doc_id_from_texts(segment_texts(text), chunk_params, producer))


def title_fallback(title, url) -> Column:
    """Title if present, else the last ``/``-piece of the URL (``""`` after a trailing ``/``)."""
    t = F.col(title) if isinstance(title, str) else title
    u = F.col(url) if isinstance(url, str) else url
    return F.coalesce(t, F.element_at(F.split(u, "/", -1), -1))


def build_documents(
    df: DataFrame,
    url: str,
    title: str | None,
    text: str,
    lang: str | None = None,
    fetched_at: Column | None = None,
    keys=(),
) -> DataFrame:
    """Nested document records, one per input row.

    ``lang`` defaults to ``"en"`` when the input has no language column;
    ``fetched_at`` is one job-level timestamp literal (never a per-row clock)
    unless the input carries its own.
    """
    texts = segment_texts(text)
    title_col = title_fallback(F.col(title) if title else F.lit(None).cast("string"), url)
    lang_col = F.col(lang) if lang else F.lit("en")
    fetched = fetched_at if fetched_at is not None else F.current_timestamp()
    return df.select(
        *keys,
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        doc_id_from_texts(texts).alias("doc_id"),
        F.col(url).alias("url"),
        title_col.alias("title"),
        lang_col.alias("lang"),
        F.date_format(fetched, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("fetched_at"),
        segment_struct_array(texts).alias("segments"),
        F.create_map().cast("map<string,string>").alias("hints"),
    )


def explode_document_segments(docs: DataFrame, keys=("doc_id",)) -> DataFrame:
    """Long form of nested documents: one row per segment."""
    k = list(keys)
    return docs.select(*k, F.inline("segments"))
