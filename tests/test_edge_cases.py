"""Adversarial rows: outcome classes, invalid and zero vectors, empty and
duplicate-paragraph documents."""

import math

from pyspark.sql import functions as F

from parasift.operators.analysis import analyze_groups
from parasift.operators.embed import HashingEmbedder
from parasift.operators.summary import response_outcome
from parasift.options import AnalyzerOptions
from parasift.plans.pipeline import analyze


def test_response_outcome_classes(spark):
    ok = '{"choices":[{"message":{"role":"assistant","content":"hi"}}]}'
    rows = [
        (1, None, None, "connection refused"),
        (2, None, None, None),
        (3, 503, "busy", None),
        (4, 200, '{"choices":[]}', None),
        (5, 200, ok, None),
    ]
    df = spark.createDataFrame(rows, "k int, status int, body string, error string")
    out = {r.k: r.o for r in df.select("k", response_outcome(F.col("status"), F.col("body"), F.col("error")).alias("o")).collect()}
    assert out[1].failure == "no answer, transport: connection refused"
    assert out[2].failure == "no answer, time ran out"
    assert out[3].failure == "refused, HTTP 503: busy"
    assert out[4].failure == "answer has no choice"
    assert out[5].ok and out[5].content == "hi"


def test_invalid_and_zero_vectors(spark):
    rows = [
        (1, 0, [1.0, 0.0]), (1, 1, [float("nan"), 1.0]), (1, 2, [0.0, 0.0]), (1, 3, [0.0, 1.0]), (1, 4, None),
    ]
    df = spark.createDataFrame(rows, "doc long, pos long, v array<double>")
    out = analyze_groups(df, ["doc"], "pos", "v", 10, 0.65).collect()
    picked = sorted(r.pos for r in out)
    assert picked == [0, 2, 3]  # NaN / null rows are never picked, no row twice
    assert all(r.group_n == 5 and r.group_valid == 3 for r in out)
    zero = [r for r in out if r.pos == 2][0]
    assert zero.score_representative == 0.0 and not math.isnan(zero.mmr_score)


def test_empty_document_and_duplicate_paragraphs(spark):
    docs = spark.createDataFrame([(1, "same line\nother line\nsame line"), (2, "   \n\n")], "doc_id long, text string")
    from parasift.operators.segments import explode_segments

    segs = explode_segments(docs, "doc_id", "text")
    a = analyze(segs, docs.select("doc_id"), "doc_id", HashingEmbedder(32), AnalyzerOptions(top_n=5))
    m = {r.doc_id: r for r in a.metrics.collect()}
    assert (m[2].num_segments, m[2].top_n, m[2].avg_pairwise_cosine) == (0, 0, 0.0)
    assert m[1].num_segments == 3 and m[1].top_n == 3
    sel = a.selection.filter("doc_id = 1").orderBy("rank").collect()
    assert sorted(r.position for r in sel) == [0, 1, 2]  # both copies are rows, no fan-out
    ids = [r.segment_id for r in sel]
    assert len(set(ids)) == 2 and ids.count([i for i in ids if ids.count(i) == 2][0]) == 2
