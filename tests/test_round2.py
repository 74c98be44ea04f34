"""Edge cases of the analysis, the store, the parser and the pipelines."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from parasift.functions.text import wrap_text
from parasift.functions.vectors import l2_normalize
from parasift.operators.analysis import analyze_groups
from parasift.operators.embed import HashingEmbedder
from parasift.operators.store import EmbeddingStore, lookup
from parasift.operators.summary import pick_lists, summarize
from parasift.options import AnalyzerOptions
from parasift.plans.pipeline import analyze, analyze_documents, embed_segments, run_pages, summarize_documents
from parasift.sources.html_nodes import parse_nodes


def _mixed():
    rng = np.random.default_rng(4)
    rows = []
    for doc, sizes in ((1, [2, 2, 2]), (2, [3] * 5), (3, [3] * 5), (4, [2, 2, 3]), (5, [2, 3]), (6, [4, 0, 4])):
        rows += [(doc, i, [float(x) for x in rng.normal(size=n)]) for i, n in enumerate(sizes)]
    rows += [(7, 0, [float("nan"), 1.0]), (7, 1, None), (8, 0, [1.0, 0.0]), (8, 1, [float("inf"), 1.0]), (8, 2, [0.0, 1.0])]
    return rows


@pytest.mark.parametrize("batch", [1, 3, 10_000])
def test_picks_do_not_depend_on_batches_or_route(spark, batch):
    df = spark.createDataFrame(_mixed(), "doc long, position long, v array<double>")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        runs = []
        for most in (50_000, 1):  # grouped pass; lock-step for every group
            out = analyze_groups(df, "doc", "position", "v", k=2, lam=0.65, max_group_rows=most)
            runs.append(sorted((r["doc"], r["rank"], r["position"], round(r["mmr_score"], 6), r["group_n"], r["group_valid"]) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert runs[0] == runs[1]
    valid = {d: v for d, *_, v in runs[0]}
    # sizes equally frequent: the smallest; a group without a valid vector has no picks
    assert valid == {1: 3, 2: 5, 3: 5, 4: 2, 5: 1, 6: 2, 8: 2}


def test_metrics_count_segments_without_a_valid_vector(spark):
    segs = spark.createDataFrame([(1, i, f"s{i}", "t", [float("nan")]) for i in range(3)], "doc_id long, position long, segment_id string, text string, embedding array<double>")
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    a = analyze(segs, docs, vectors=segs.select("doc_id", "position", "segment_id", "text", "embedding"))
    got = {r["doc_id"]: (r["num_segments"], r["top_n"], r["analyzed_segments"]) for r in a.metrics.collect()}
    assert got == {1: (3, 0, 0), 2: (0, 0, 0)}


class _Holes(HashingEmbedder):
    """An embedder that fails on some texts."""

    def embed(self, segs, text="text"):
        out = super().embed(segs, text=text)
        return out.withColumn("embedding", F.when(F.col(text) != "bad", F.col("embedding")))


def test_store_keeps_rows_of_invalid_vectors_and_does_not_store_them(spark, tmp_path):
    segs = spark.createDataFrame([(1, 0, "a", "good"), (1, 1, "b", "bad"), (2, 0, "a", "good")], "doc_id long, position long, segment_id string, text string")
    store = EmbeddingStore(spark, str(tmp_path / "store"))
    for calls in (2, 1):
        rows = embed_segments(segs, _Holes(8), store).collect()
        assert sorted((r["doc_id"], r["segment_id"], r["embedding"] is None) for r in rows) == [(1, "a", False), (1, "b", True), (2, "a", False)]
        assert store.last_run.embedder_calls == calls
    assert store.read_all().count() == 1


def test_store_time_to_live_does_not_follow_the_drivers_zone(spark, tmp_path, monkeypatch):
    store = EmbeddingStore(spark, str(tmp_path / "store"), ttl_days=1)
    old = spark.range(4).select(
        F.concat(F.lit("s"), "id").alias("segment_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"),
        (F.current_timestamp() - F.make_dt_interval(hours=F.col("id").cast("int") * 11)).alias("written_at"), F.lit("m").alias("model_fingerprint"))
    store.append(old)
    monkeypatch.setenv("TZ", "America/Los_Angeles")
    time.tzset()
    try:
        assert {r["segment_id"] for r in store.read_all().collect()} == {"s0", "s1", "s2"}
    finally:
        monkeypatch.undo()
        time.tzset()


def test_equal_write_times_have_one_winner(spark):
    rows = [("s", [1.0, 0.0]), ("s", [0.0, 1.0])]
    want = spark.createDataFrame([("s", "t")], "segment_id string, text string")
    found = set()
    for order in (rows, rows[::-1]):
        stored = spark.createDataFrame(order, "segment_id string, embedding array<float>").withColumn("written_at", F.lit("2024-01-01").cast("timestamp"))
        found.add(tuple(lookup(want, stored)[0].first()["embedding"]))
    assert len(found) == 1


PAGES = [(1, "http://a/", "<title>lion</title><article><p>zebra crossing the street today</p><p>completely different words here</p></article>"),
         (2, "http://b/", "<title>nothing</title>")]


def test_every_page_has_a_summary_and_the_title_is_in_the_query(spark):
    r = run_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"), AnalyzerOptions(rerank=True))
    assert sorted((x["page_id"], x["summary_text"] == "") for x in r.summary.collect()) == [(1, False), (2, True)]
    top = r.selection.where("page_id = 1 and position = 0").first()
    # title and first segment are the query: a first segment alone would score 1.0
    assert 0 < top["score_rerank"] < 1
    assert {x["num_segments"] for x in r.metrics.where("page_id = 1").collect()} == {2}


def test_documents_that_share_an_id_stay_apart(spark):
    pages = spark.createDataFrame([*PAGES, (3, "http://c/", PAGES[0][2].replace("lion</title>", "tiger</title>"))], "page_id long, url string, html string")
    docs = run_pages(pages).documents.drop("page_id")
    assert docs.select("doc_id").distinct().count() == 2  # the title is no part of the id
    records = analyze_documents(docs, AnalyzerOptions(rerank=True))
    assert records.count() == 3
    assert all(x["model_fingerprint"].endswith("+token-overlap@1") for x in records.collect())
    lost = records.withColumn("doc_id", F.concat("doc_id", F.lit("x")))
    summaries, missing = summarize_documents(records.unionByName(lost), docs)
    assert summaries.count() == 3 and missing.count() == 3


def test_one_summary_for_two_answers(spark):
    docs = spark.createDataFrame([(1, "t", "en"), (2, "t", "en")], "doc_id long, title string, lang string")
    picks = pick_lists(spark.createDataFrame([(1, 1, "s", "text")], "doc_id long, rank int, segment_id string, text string"))
    ok = '{"choices":[{"message":{"role":"assistant","content":"fine"}}]}'
    answers = spark.createDataFrame([(1, 503, "busy", None), (1, 200, ok, None)], "doc_id long, status int, body string, error string")
    got = {r["doc_id"]: r["summary_text"] for r in summarize(docs, picks, answers).collect()}
    assert got == {1: "fine", 2: ""}


def test_pages_are_read_to_their_end():
    nodes = parse_nodes("<p>First paragraph</p><![x[ y ]]><p>Second paragraph</p>")
    assert [n["text"] for n in nodes if n["kind"] == "p"] == ["First paragraph", "Second paragraph"]
    took = []
    for n in (20_000, 80_000):
        t = time.process_time()
        assert parse_nodes("<div>" * n + "<p>deep</p>")[-1]["text"] == "deep"
        took.append(time.process_time() - t)
    assert took[1] < 10 * took[0] + 0.5  # linear in depth: four times, not sixteen


def test_normalising_is_linear_in_the_vector_size(spark):
    took = []
    for d in (128, 1024):
        df = spark.range(200).select(F.transform(F.sequence(F.lit(1), F.lit(d)), lambda x: x + F.col("id") * 0.5).alias("v"))
        best = []
        for _ in range(3):
            t = time.perf_counter()
            assert df.select(F.sum(F.size(l2_normalize("v"))), F.sum(l2_normalize("v")[0])).first()[0] == 200 * d
            best.append(time.perf_counter() - t)
        took.append(min(best))
    assert took[1] < 24 * took[0]


def test_wrapping_a_long_text(spark):
    text = " ".join(f"word{i % 97}" for i in range(60_000))
    got = spark.createDataFrame([(text,), ("",), (None,), ("a " * 300,)], "t string").select(wrap_text("t").alias("w")).collect()
    lines = got[0]["w"].split("\n")
    assert " ".join(lines) == text and max(map(len, lines)) <= 80
    assert all(len(a) + 1 + len(b.split(" ")[0]) > 80 for a, b in zip(lines, lines[1:]))
    assert got[1]["w"] == "" and got[2]["w"] is None and got[3]["w"].split() == ["a"] * 300
