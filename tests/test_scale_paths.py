"""Skew routing and plan-shape checks."""

from pyspark.sql import functions as F

from parasift.operators.analysis import analyze_groups
from parasift.operators.embed import HashingEmbedder
from parasift.operators.segments import explode_segments
from parasift.options import AnalyzerOptions
from parasift.plans.pipeline import embed_segments
from parasift.sources.tables import read_table


def _vectors(spark, sf0001):
    docs = read_table(spark, sf0001, "documents").select("doc_id", "text")
    segs = explode_segments(docs, "doc_id", "text")
    return embed_segments(segs, HashingEmbedder(64))


def test_hot_groups_take_lockstep_path_with_same_result(spark, sf0001):
    v = _vectors(spark, sf0001).cache()
    cols = ["doc_id", "rank", "position", "group_n", "group_top_n"]
    a = analyze_groups(v, ["doc_id"], "position", "embedding", 5, 0.65, payload=("segment_id",))
    # every document with more than 8 segments is treated as a hot group
    b = analyze_groups(v, ["doc_id"], "position", "embedding", 5, 0.65, payload=("segment_id",), max_group_rows=8)
    ra = sorted(tuple(r[c] for c in cols) + (round(r.score_representative, 6), round(r.group_apc, 6)) for r in a.collect())
    rb = sorted(tuple(r[c] for c in cols) + (round(r.score_representative, 6), round(r.group_apc, 6)) for r in b.collect())
    assert ra == rb
    big = v.groupBy("doc_id").count().filter(F.col("count") > 8).count()
    assert big > 0


def test_scan_prunes_columns_and_vectors_are_not_broadcast(spark, sf0001):
    v = _vectors(spark, sf0001)
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    docs = read_table(spark, sf0001, "documents").select("doc_id", "text")
    scan = explode_segments(docs, "doc_id", "text")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in scan or "struct<doc_id:bigint,text:string>" in scan


def test_store_read_prunes_fingerprint_partition(spark, tmp_path):
    from parasift.operators.store import EmbeddingStore

    store = EmbeddingStore(spark, str(tmp_path / "store"))
    emb = HashingEmbedder(8)
    segs = spark.createDataFrame([(1, 0, "a", "alpha")], "doc_id long, position long, segment_id string, text string")
    embed_segments(segs, emb, store).count()
    plan = store.read(emb.fingerprint)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(model_fingerprint" in plan


def test_groups_straddling_arrow_batches(spark, sf0001):
    v = _vectors(spark, sf0001).cache()
    cols = ["doc_id", "rank", "position", "group_n", "group_top_n", "group_valid"]

    def picks():
        out = analyze_groups(v, ["doc_id"], "position", "embedding", 4, 0.65, payload=("segment_id",))
        return sorted(tuple(r[c] for c in cols) + (round(r.group_apc, 6),) for r in out.collect())

    base = picks()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        small = picks()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert small == base and len(base) > 0


def test_analyze_hot_documents_with_bucket_vectors(spark, sf0001):
    from parasift.options import AnalyzerOptions
    from parasift.plans.pipeline import analyze

    docs = read_table(spark, sf0001, "documents").select("doc_id", "text")
    segs = explode_segments(docs, "doc_id", "text")

    def run(max_rows):
        a = analyze(segs, docs.select("doc_id"), "doc_id", HashingEmbedder(64),
                    AnalyzerOptions(top_n=4, max_group_rows=max_rows))
        sel = sorted((r.doc_id, r.rank, r.position, round(r.score_representative, 6)) for r in a.selection.collect())
        met = sorted((r.doc_id, r.num_segments, r.top_n, round(r.avg_pairwise_cosine, 6)) for r in a.metrics.collect())
        return sel, met

    assert run(50_000) == run(8)


def _counted(df, seen):
    """``df``, each row of which adds one to ``seen`` whenever it is computed."""
    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return df.mapInArrow(run, df.schema)


def test_rerank_moves_no_vector_that_follows_from_the_text(spark, monkeypatch):
    from parasift.operators.analysis import UNIT
    from parasift.plans import pipeline

    seen, real = [], pipeline.rerank
    monkeypatch.setattr(pipeline, "rerank", lambda short, *a: seen.append(short.columns) or real(short, *a))
    segs = spark.createDataFrame(
        [(d, p, f"s{d}-{p}", f"word{p % 3} of text {d} and {p}") for d in range(3) for p in range(1 + 4 * d)],
        "doc_id long, position long, segment_id string, text string")
    docs = spark.createDataFrame([(d,) for d in range(4)], "doc_id long")
    emb, opts = pipeline.HashingEmbedder(32), AnalyzerOptions(rerank=True, top_m=6, top_n=3)
    lean = pipeline.analyze(segs, docs, "doc_id", emb, opts)
    full = pipeline.analyze(segs, docs, "doc_id", emb, opts, vectors=pipeline.embed_segments(segs, emb))
    assert UNIT not in seen[0] and UNIT in seen[1]
    assert sorted(lean.selection.collect()) == sorted(full.selection.collect())
    a, b = ({r["doc_id"]: r for r in x.metrics.collect()} for x in (lean, full))
    for d in range(4):
        assert abs(a[d]["avg_pairwise_cosine"] - b[d]["avg_pairwise_cosine"]) < 1e-9
        assert a[d].asDict() | {"avg_pairwise_cosine": 0} == b[d].asDict() | {"avg_pairwise_cosine": 0}


def test_stored_documents_and_analyses_are_computed_once(spark):
    from parasift.plans.pipeline import analyze_documents, run_pages, summarize_documents

    page = "<title>T</title><p>A first long paragraph.</p><p>And a second paragraph.</p>"
    pages = spark.createDataFrame([(1, "u", page), (2, "u", page), (3, "v", ""), (4, "w", page)], "page_id long, url string, html string")
    docs = run_pages(pages, fetched_at=F.lit("2024-01-01").cast("timestamp")).documents.drop("page_id").localCheckpoint()
    seen = spark.sparkContext.accumulator(0)
    analyses = analyze_documents(_counted(docs, seen))
    rows = analyses.collect()
    assert len(rows) == 4 and seen.value == 4  # equal documents get a record each
    analyses = analyses.localCheckpoint()
    seen = spark.sparkContext.accumulator(0)
    summaries, _ = summarize_documents(_counted(analyses, seen), docs)
    assert summaries.count() == 4 and seen.value == 4


def test_store_runs_cut_the_documents_once(spark, sf0001, monkeypatch):
    from parasift.plans import q_store

    seen, real = spark.sparkContext.accumulator(0), q_store.read_table
    monkeypatch.setattr(q_store, "read_table", lambda s, d, name: _counted(real(s, d, name), seen))
    assert q_store.q_store_read_through(spark, sf0001).count() > 0
    assert seen.value == real(spark, sf0001, "documents").count()
