"""Record schemas (exchange format of documents, analyses and summaries)."""

from __future__ import annotations

from pyspark.sql import types as T

SEGMENT = T.StructType([
    T.StructField("segment_id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("position", T.LongType()),
])

DOCUMENT = T.StructType([
    T.StructField("schema_version", T.StringType()),
    T.StructField("doc_id", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("fetched_at", T.StringType()),
    T.StructField("segments", T.ArrayType(SEGMENT)),
    T.StructField("hints", T.MapType(T.StringType(), T.StringType())),
])

SEGMENT_SCORE = T.StructType([
    T.StructField("segment_id", T.StringType()),
    T.StructField("score_representative", T.DoubleType()),
    T.StructField("score_diversity", T.DoubleType()),
    T.StructField("score_rerank", T.DoubleType()),
    T.StructField("reason", T.StringType()),
])

ANALYSIS_METRICS = T.StructType([
    T.StructField("num_segments", T.LongType()),
    T.StructField("top_n", T.LongType()),
    T.StructField("mmr_lambda", T.DoubleType()),
    T.StructField("avg_pairwise_cosine", T.DoubleType()),
])

ANALYSIS = T.StructType([
    T.StructField("doc_id", T.StringType()),
    T.StructField("model_fingerprint", T.StringType()),
    T.StructField("top_segments", T.ArrayType(SEGMENT_SCORE)),
    T.StructField("metrics", ANALYSIS_METRICS),
])

CITATION = T.StructType([
    T.StructField("segment_id", T.StringType()),
    T.StructField("start", T.LongType()),
    T.StructField("end", T.LongType()),
])

SUMMARY = T.StructType([
    T.StructField("summary_text", T.StringType()),
    T.StructField("bullets", T.ArrayType(T.StringType())),
    T.StructField("citations", T.ArrayType(CITATION)),
    T.StructField("guardrails", T.StructType([
        T.StructField("filtered", T.BooleanType()),
        T.StructField("reason", T.StringType()),
    ])),
    T.StructField("metrics", T.StructType([
        T.StructField("processing_time_ms", T.LongType()),
        T.StructField("input_tokens", T.LongType()),
        T.StructField("output_tokens", T.LongType()),
    ])),
])

PAGE_EXTRACT = T.StructType([
    T.StructField("title", T.StringType()),
    T.StructField("headings", T.ArrayType(T.StringType())),
    T.StructField("links", T.ArrayType(T.StructType([
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
    ]))),
    T.StructField("text_content", T.StringType()),
])
