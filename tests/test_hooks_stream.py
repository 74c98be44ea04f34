"""User model hooks (predict_batch_udf), pair windows and the streaming runner."""

import os
import tempfile

import numpy as np
from pyspark.sql import functions as F

from parasift.operators.embed import ModelEmbedder
from parasift.operators.rerank import ModelScorer, pair_window, rerank
from parasift.plans.pipeline import embed_segments


def _models():
    # defined inside a function so they are shipped by value to the workers
    def make_len_embedder():
        def predict(texts):
            import numpy as np

            return np.stack([[len(t), t.count("a") + 1.0, 1.0] for t in texts]).astype(np.float32)

        return predict

    def make_overlap_scorer():
        def predict(queries, texts):
            import numpy as np

            return np.array([float(len(set(q.split()) & set(t.split()))) for q, t in zip(queries, texts)],
                            dtype=np.float32)

        return predict

    return make_len_embedder, make_overlap_scorer


def test_model_embedder_normalises_and_dedupes(spark):
    segs = spark.createDataFrame(
        [(1, 0, "a", "banana"), (1, 1, "b", "kiwi"), (2, 0, "a", "banana")],
        "doc_id long, position long, segment_id string, text string")
    make_len_embedder, _ = _models()
    emb = ModelEmbedder(make_len_embedder, dim=3, fingerprint="toy@1", batch_size=2)
    rows = {(r.doc_id, r.position): r.embedding for r in embed_segments(segs, emb).collect()}
    v = np.array(rows[(1, 0)])
    assert abs(np.linalg.norm(v) - 1) < 1e-6 and rows[(1, 0)] == rows[(2, 0)]


def test_model_scorer_reranks_shortlist(spark):
    short = spark.createDataFrame(
        [(1, 0, "x", "alpha beta"), (1, 1, "y", "gamma"), (1, 2, "z", "alpha beta gamma")],
        "doc_id long, shortlist_pos long, segment_id string, text string")
    q = spark.createDataFrame([(1, "alpha gamma")], "doc_id long, query string")
    _, make_overlap_scorer = _models()
    out = rerank(short, q, "doc_id", ModelScorer(make_overlap_scorer, "toy-ce@1"), top_n=2).orderBy("rank").collect()
    assert [r.segment_id for r in out] == ["z", "x"] and out[1].reason == "rerank: highly relevant"


def test_pair_window_truncates_candidate_tail(spark):
    df = spark.createDataFrame([("a b", "c d e f")], "q string, t string")
    w = df.select(pair_window("q", "t", 4).alias("w")).first().w
    assert len(w.ids) == 4 and w.mask == [1, 1, 1, 1]
    w = df.select(pair_window("q", "t", 8).alias("w")).first().w
    assert w.mask == [1, 1, 1, 1, 1, 1, 0, 0]


def test_streaming_runner_processes_page_files(spark, sf0001):
    from parasift.sources.tables import read_table
    from parasift.streaming.pages_stream import start_pages_stream

    base = tempfile.mkdtemp(prefix="stream-test-")
    src = os.path.join(base, "in")
    read_table(spark, sf0001, "pages").repartition(3).write.parquet(src)
    q = start_pages_stream(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"), max_files_per_trigger=1)
    q.awaitTermination(300)
    summ = spark.read.parquet(os.path.join(base, "out", "summary"))
    assert summ.count() == read_table(spark, sf0001, "pages").count()
    assert summ.select("batch_id").distinct().count() >= 2
