import math

from pyspark.sql import functions as F

from parasift.functions.vectors import attention_mask, cosine, l2_normalize, masked_mean_pool, pad_truncate


def _one(spark, expr, schema, row):
    return spark.createDataFrame([row], schema).select(expr.alias("r")).first()["r"]


def test_cosine_reference_cases(spark):
    s = "a array<double>, b array<double>"
    assert _one(spark, cosine("a", "b"), s, ([1.0, 0.0], [0.0, 1.0])) == 0.0
    assert abs(_one(spark, cosine("a", "b"), s, ([1.0, 2.0, 3.0], [1.0, 2.0, 3.0])) - 1.0) < 1e-12
    assert abs(_one(spark, cosine("a", "b"), s, ([1.0, 2.0], [-1.0, -2.0])) + 1.0) < 1e-12
    # zero vector -> 0, never NaN
    assert _one(spark, cosine("a", "b"), s, ([0.0, 0.0], [1.0, 2.0])) == 0.0


def test_l2_normalize_reference_cases(spark):
    s = "v array<double>"
    out = _one(spark, l2_normalize("v"), s, ([3.0, 4.0, 0.0],))
    assert [round(x, 6) for x in out] == [0.6, 0.8, 0.0]
    out = _one(spark, l2_normalize("v"), s, ([1.0, 1.0, 1.0],))
    assert all(abs(x - 1 / math.sqrt(3)) < 1e-6 for x in out)
    assert _one(spark, l2_normalize("v"), s, ([0.0, 0.0],)) == [0.0, 0.0]


def test_pad_truncate_and_mask(spark):
    s = "ids array<long>"
    assert _one(spark, pad_truncate("ids", 5), s, ([7, 8],)) == [7, 8, 0, 0, 0]
    assert _one(spark, pad_truncate("ids", 2), s, ([7, 8, 9],)) == [7, 8]
    assert _one(spark, attention_mask(pad_truncate("ids", 4)), s, ([7, 8],)) == [1, 1, 0, 0]


def test_masked_mean_pool_all_masked_is_zero(spark):
    s = "t array<array<double>>, m array<int>"
    assert _one(spark, masked_mean_pool("t", "m"), s, ([[1.0, 2.0], [3.0, 4.0]], [1, 0])) == [1.0, 2.0]
    assert _one(spark, masked_mean_pool("t", "m"), s, ([[1.0, 2.0], [3.0, 4.0]], [1, 1])) == [2.0, 3.0]
    assert _one(spark, masked_mean_pool("t", "m"), s, ([[1.0, 2.0], [3.0, 4.0]], [0, 0])) == [0.0, 0.0]


def test_valid_vectors_without_a_call_per_component(spark):
    from parasift.functions.vectors import is_valid_vector

    nan, inf = float("nan"), float("inf")
    cases = [([1.0, 0.0], True), ([], True), (None, False), ([None], False), ([1.0, None], False), ([None, None], False), ([nan], False),
             ([1.0, nan], False), ([inf, 1.0], False), ([1.0, -inf], False), ([nan, -inf], False), ([None, inf], False), ([-0.0], True)]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], f"i int, v array<{kind}>")
        out = df.select("i", is_valid_vector("v").alias("ok"), is_valid_vector("v", 2).alias("ok2"))
        assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
        for r in out.collect():
            v, ok = cases[r["i"]]
            assert (r["ok"], r["ok2"]) == (ok, ok and len(v) == 2), v
