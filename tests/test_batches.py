import numpy as np
from pyspark.sql import functions as F

from parasift.operators.attempts import AttemptLedger
from parasift.operators.embed import ModelEmbedder
from parasift.operators.key_filter import key_bitmap, may_hold
from parasift.operators.length_batches import LengthBatchedEmbedder, batch_padding, by_length
from parasift.operators.segments import explode_segments
from parasift.operators.summary import resolve_picks
from parasift.sources.tables import read_table

RESPONSE = "request_id string, status int, body string, error string"
GOOD = '{"choices":[{"message":{"role":"assistant","content":"%s"}}]}'


def test_attempts_until_answered_refused_or_exhausted(spark, tmp_path):
    ledger = AttemptLedger(spark, str(tmp_path / "ledger"), max_attempts=2)
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (None, "d"), (1, "a"), (5, None)], "k int, body string")
    req = ledger.requests(df, ["k"])
    ids = {r["body"]: r["request_id"] for r in req.collect()}
    first = ledger.issue(req, 1)
    assert {r["attempt"] for r in first.collect()} == {1} and first.count() == 5

    def record(n, rows):
        ledger.record(n, ledger.issue(req, n), spark.createDataFrame([(ids.get(k, k), *r) for k, *r in rows], RESPONSE))

    one = [("a", 200, GOOD % "yes", None), ("a", 200, GOOD % "also", None), ("a", 500, "x", None), ("b", 404, "no", None),
           ("c", 503, "busy", None), ("unknown", 200, GOOD % "?", None)]
    record(1, one)
    assert {r["body"] for r in ledger.issue(req, 2).collect()} == {"c", "d", None}
    record(2, [("c", 200, GOOD % "late", None), ("d", None, None, "down")])
    want = {"a": ("answered", 1, 1, "also", None), "b": ("refused", 1, None, None, "refused, HTTP 404: no"),
            "c": ("answered", 2, 2, "late", None), "d": ("exhausted", 2, None, None, "no answer, transport: down"),
            None: ("exhausted", 2, None, None, "no answer, time ran out")}

    def table():
        return {r["body"]: (r["state"], r["attempts"], r["answer_attempt"], r["content"], r["failure"]) for r in ledger.table(req).collect()}

    assert table() == want
    record(1, one)  # a replayed round replaces itself
    assert table() == want and ledger.issue(req, 3).count() == 0
    # a round that was not written to its end is as if it had not been
    (tmp_path / "ledger" / "round=2" / "_SUCCESS").unlink()
    assert table()["c"][0] == "open"
    empty = ledger.requests(df.limit(0), ["k"])
    assert ledger.table(empty).count() == 0


def test_shards_are_even_for_one_hot_key(spark, tmp_path):
    ledger = AttemptLedger(spark, str(tmp_path / "l"), shards=4)
    req = ledger.requests(spark.range(4000).select(F.lit(7).alias("k"), F.col("id").cast("string").alias("body")), ["k"])
    counts = [r["count"] for r in req.groupBy("shard").count().collect()]
    assert len(counts) == 4 and min(counts) > 850


def test_length_batches_pad_less_and_give_the_same_vectors(spark, sf0001):
    segs = explode_segments(read_table(spark, sf0001, "documents").select("doc_id", "text"), "doc_id", "text")
    hot = spark.range(300).select(F.concat(F.lit("one two "), F.col("id").cast("string")).alias("text"))
    texts = segs.select("text").distinct().union(hot).union(spark.createDataFrame([("",), (None,)], "text string"))
    dealt = by_length(texts, 4)
    mixed = batch_padding(texts.repartition(4, F.xxhash64("text")), 16).first()
    even = batch_padding(dealt, 16).first()
    assert even["tokens"] == mixed["tokens"] and even["padded"] * 3 < mixed["padded"]
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.5 * sum(sizes) and sum(sizes) == texts.count()
    assert batch_padding(texts.limit(0), 16).first()["padded"] == 0

    def make():
        def predict(batch):
            return np.array([[len(t or ""), 1.0, (t or "").count("e")] for t in batch], dtype="float32")
        return predict

    model = ModelEmbedder(make, 3, "toy@1", batch_size=16)
    batched = LengthBatchedEmbedder(model, 4)
    given = texts.where("text is not null").withColumn("_bucket", F.lit("kept"))
    a = {r["text"]: (tuple(r["embedding"]), r["_bucket"]) for r in model.embed(given).collect()}
    b = {r["text"]: (tuple(r["embedding"]), r["_bucket"]) for r in batched.embed(given).collect()}
    assert a == b and batched.fingerprint == model.fingerprint


def test_bitmap_loses_no_key_and_drops_most_others(spark):
    keys = spark.range(0, 20000, 20).select("id", F.col("id").cast("string").alias("s"))
    rows = spark.range(20000).select("id", F.col("id").cast("string").alias("s"), F.lit("x").alias("text"))
    passed = may_hold(rows, key_bitmap(keys, ["id", "s"], 4), ["id", "s"], 4)
    got = {r["id"] for r in passed.collect()}
    assert got >= set(range(0, 20000, 20)) and len(got) < 1300 and passed.columns == rows.columns
    assert may_hold(rows, key_bitmap(keys.limit(0), ["id"], 4), ["id"], 4).count() == 0
    # far more keys than bits: all pass, and the join after it stays exact
    assert may_hold(rows, key_bitmap(spark.range(400000), ["id"], 1), ["id"], 1).count() == 20000


def test_text_shuffled_follows_the_picks(spark):
    segs = spark.range(40000).select(
        F.floor(F.col("id") / 10).alias("doc_id"), (F.col("id") % 10).alias("position"), F.sha2(F.col("id").cast("string"), 256).alias("segment_id"),
        F.repeat(F.lit("text "), 20).alias("text"))
    picks = segs.filter("doc_id % 50 = 0 and position < 2").select("doc_id", "segment_id", (F.col("position") + 1).alias("rank"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # picks too big to broadcast
    try:
        plain, reduced = resolve_picks(picks, segs), resolve_picks(picks, segs, filter_rows=16)
        plan = reduced._jdf.queryExecution().executedPlan().toString()
        assert "bitmap_construct_agg" in plan and "BroadcastHashJoin" in plan
        assert sorted(reduced.collect()) == sorted(plain.collect()) and reduced.count() == 160
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_length_batches_hold_equal_bytes_in_partitions_that_follow_the_input(spark, monkeypatch):
    from parasift.operators import length_batches

    name = F.col("id").cast("string")
    texts = spark.range(400).select(F.concat(F.lit("short "), name).alias("text")).union(
        spark.range(400).select(F.concat(F.repeat(F.lit("one "), 400), F.repeat(F.lit("x"), 20000), name)))

    def parts(df):
        return [r["b"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length("text")).alias("b")).orderBy("p").collect()]

    held = parts(by_length(texts, 4))
    assert len(held) == 4 and max(held) < 0.45 * sum(held)
    monkeypatch.setattr(length_batches, "PART_BYTES", 1 << 19)
    dealt = by_length(texts, 4)
    assert max(parts(dealt)) < 2 * (1 << 19) and dealt.count() == 800 and dealt.columns == ["text"]
    assert sorted(r["text"] for r in dealt.collect()) == sorted(r["text"] for r in texts.collect())
