import os
import tempfile

from pyspark.sql import functions as F

from parasift.functions.ids import parse_store_key, store_key
from parasift.operators.embed import HashingEmbedder
from parasift.operators.store import EmbeddingStore
from parasift.plans.pipeline import embed_segments


def _segs(spark):
    return spark.createDataFrame(
        [(1, 0, "a", "alpha beta"), (1, 1, "b", "gamma"), (2, 0, "a", "alpha beta"), (2, 1, "c", "delta delta")],
        "doc_id long, position long, segment_id string, text string")


def test_read_through_second_run_calls_embedder_zero_times(spark):
    root = tempfile.mkdtemp(prefix="store-test-")
    store = EmbeddingStore(spark, root)
    emb = HashingEmbedder(16)
    v1 = embed_segments(_segs(spark), emb, store)
    assert v1.count() == 4 and store.last_run.embedder_calls == 3
    v2 = embed_segments(_segs(spark), emb, store)
    assert v2.count() == 4 and store.last_run.embedder_calls == 0
    st = store.stats().first()
    assert st.entry_count == 3 and st.total_size_bytes == 3 * (16 * 4 + 8)
    # vectors identical on both runs
    a = {r.segment_id: r.embedding for r in v1.collect()}
    b = {r.segment_id: r.embedding for r in v2.collect()}
    assert a == b
    store.clear()
    embed_segments(_segs(spark), emb, store).count()
    assert store.last_run.embedder_calls == 3


def test_corrupt_entry_is_a_miss(spark):
    root = tempfile.mkdtemp(prefix="store-test-")
    store = EmbeddingStore(spark, root)
    emb = HashingEmbedder(8)
    bad = spark.createDataFrame([("a", [float("nan")] * 8)], "segment_id string, embedding array<float>").select(
        "segment_id", "embedding", F.current_timestamp().alias("written_at"), F.lit(emb.fingerprint).alias("model_fingerprint"))
    store.append(bad)
    embed_segments(_segs(spark), emb, store).count()
    assert store.last_run.embedder_calls == 3


def test_disabled_store_never_writes(spark):
    root = os.path.join(tempfile.mkdtemp(prefix="store-test-"), "s")
    store = EmbeddingStore(spark, root, enabled=False)
    assert embed_segments(_segs(spark), HashingEmbedder(8), store).count() == 4
    assert not os.path.exists(root)


def test_key_round_trip_with_local_fingerprint(spark):
    df = spark.createDataFrame([("seg1", "local:/m/x"), ("seg2", "BAAI/bge@main")], "s string, fp string")
    r = df.select(parse_store_key(store_key("s", "fp")).alias("p")).collect()
    assert [(x.p.segment_id, x.p.model_fingerprint) for x in r] == [("seg1", "local:/m/x"), ("seg2", "BAAI/bge@main")]
    bad = spark.createDataFrame([("x:y",), ("emb:only",)], "k string").select(parse_store_key("k").alias("p")).collect()
    assert all(x.p is None for x in bad)


def _entries(spark, rows, fingerprint="m"):
    return spark.createDataFrame(rows, "segment_id string, x float, at string").select(
        "segment_id", F.array("x").alias("embedding"), F.col("at").cast("timestamp").alias("written_at"),
        F.lit(fingerprint).alias("model_fingerprint"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookup_moves_no_stored_row_and_reads_no_vector(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "s"), buckets=4)
    store.append(_entries(spark, [(c, 1.0, "2024-01-01") for c in "abc"]))
    uniq = spark.createDataFrame([("a",), ("z",)], "segment_id string")
    found = store.lookup(uniq, "m", 1)
    assert {tuple(r) for r in found.collect()} == {("a", True), ("z", False)}
    plan = _plan(store.lookup(uniq, "m", 1))
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan and plan.count("FileScan") == 1
    assert "Bucketed: true" in plan and "embedding" not in plan.split("ReadSchema")[1]
    assert _plan(store.vectors(uniq, "m", 1)).count("Exchange hashpartitioning") == 1


def test_files_outlive_the_session_catalog(spark, tmp_path):
    root = str(tmp_path / "s")
    first = EmbeddingStore(spark, root, buckets=3)
    first.append(_entries(spark, [("a", 1.0, "2024-01-01")]))
    spark.sql(f"DROP TABLE {first._name(first.current())}")
    again = EmbeddingStore(spark, root, buckets=7)  # a generation keeps its own buckets
    again.append(_entries(spark, [("b", 2.0, "2024-01-02")], "n"))
    assert again.current().buckets == 3 and {r["segment_id"] for r in again.read_all().collect()} == {"a", "b"}
    assert first.read("n").count() == 1  # what another object wrote is seen


def test_time_to_live_as_of_a_clock_prunes_dates(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "s"), ttl_days=2, buckets=2)
    store.append(_entries(spark, [(f"s{d}", 1.0, f"2024-01-{d:02d} 12:00:00") for d in range(1, 10)]))
    kept = store.read("m", as_of="2024-01-06 12:00:00")
    assert {r["segment_id"] for r in kept.collect()} == {"s4", "s5", "s6"}
    assert "written_date" in _plan(kept).split("PartitionFilters")[1].split("]")[0]
    files = {f.split("written_date=")[1][:10] for f in kept.inputFiles()}
    assert files == {f"2024-01-{d:02d}" for d in (3, 4, 5, 6, 7)}
    assert store.read_all().count() == 0  # by the session's own clock all are old


def test_compaction_keeps_last_valid_writes_and_readers_see_one_generation(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "s"), buckets=2)
    store.append(_entries(spark, [("a", 1.0, "2024-01-01"), ("b", 1.0, "2024-01-01")]))
    store.append(_entries(spark, [("a", 2.0, "2024-01-02"), ("b", float("nan"), "2024-01-03")]))
    store.append(_entries(spark, [("a", 9.0, "2024-01-01")], "n"))
    reader = store.read_all()  # opened before the switch
    assert store.compact().number == 2 and store.current().number == 2
    rows = {(r["segment_id"], r["embedding"][0], r["model_fingerprint"]) for r in store.read_all().collect()}
    assert rows == {("a", 2.0, "m"), ("b", 1.0, "m"), ("a", 9.0, "n")}
    assert reader.count() == 5  # the old generation stays until it expires
    import datetime as dt

    now = dt.datetime.now(dt.timezone.utc)
    assert store.expire(dt.timedelta(days=1), now) == []
    assert store.expire(dt.timedelta(days=1), now + dt.timedelta(days=2)) == [1]
    assert store.read_all().count() == 3 and not os.path.exists(f"{store.root}/gen=000001")


def test_only_one_writer_publishes_a_generation(spark, tmp_path):
    import pytest

    store = EmbeddingStore(spark, str(tmp_path / "s"), buckets=2)
    store.clear()
    one, two = store._next(store.current()), store._next(store.current())
    store._publish(one)
    with pytest.raises(RuntimeError):
        store._publish(two)
    assert store.current() == one and store.read_all().count() == 0


def test_compacting_an_empty_store(spark, tmp_path):
    store = EmbeddingStore(spark, str(tmp_path / "s"))
    assert store.compact().number == 1 and store.read_all().count() == 0 and store.stats().first()["entry_count"] == 0
