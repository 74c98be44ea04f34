import random

from parasift.functions.text import clean_text, estimate_tokens, utf8_prefix, utrim, wrap_text


def _one(spark, expr, value):
    return spark.createDataFrame([(value,)], "t string").select(expr.alias("r")).first()["r"]


def test_clean_text_order(spark):
    assert _one(spark, clean_text("t"), "&amp;lt;") == "<"
    assert _one(spark, clean_text("t"), "  a&nbsp;b \n\t c  ") == "a b c"


def test_unicode_trim(spark):
    assert _one(spark, utrim("t"), "　\xa0 x y  ") == "x y"


def _wrap_py(text, width):
    out, cur = [], ""
    for w in text.split():
        if cur and len(cur.encode()) + len(w.encode()) + 1 > width:
            out.append(cur)
            cur = ""
        cur = w if not cur else cur + " " + w
    if cur:
        out.append(cur)
    return "\n".join(out)


def test_wrap_matches_rule(spark):
    rng = random.Random(3)
    words = ["a", "bb", "ccc", "ümlaut", "x" * 90, "漢字", "end."]
    cases = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) for _ in range(30)]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    got = [r["r"] for r in df.select(wrap_text("t", 80).alias("r")).collect()]
    assert got == [_wrap_py(c, 80) for c in cases]


def test_token_estimate_counts_code_points(spark):
    assert _one(spark, estimate_tokens("t"), "héllo😀xy") == 2


def test_utf8_prefix_cuts_on_boundary(spark):
    assert _one(spark, utf8_prefix("t", 3), "aé€") == "aé"
    assert _one(spark, utf8_prefix("t", 2), "aé€") == "a"
    assert _one(spark, utf8_prefix("t", 10), "abc") == "abc"
