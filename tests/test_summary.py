from pyspark.sql import functions as F

from parasift.operators.summary import (
    FALLBACK_REASON,
    JOB_FALLBACK_TEXT,
    extractive_summary,
    pick_lists,
    resolve_picks,
    split_answer,
    summarize,
)
from parasift.options import SummarizerOptions


def _fallback(spark, texts):
    return spark.createDataFrame([(texts,)], "t array<string>").select(extractive_summary(F.col("t")).alias("s")).first().s


def _fallback_py(texts):
    buf = b""
    for t in texts[:3]:
        tb = t.encode()
        if len(buf) + len(tb) > 200:
            rem = max(200 - len(buf), 0)
            if rem > 20:
                cut = tb[:rem]
                while cut:
                    try:
                        cut.decode()
                        break
                    except UnicodeDecodeError:
                        cut = cut[:-1]
                buf += cut + b"..."
            break
        buf += tb + b" "
    s = buf.decode().strip()
    if len(s.encode()) > 200:
        b = s.encode()[:197]
        while True:
            try:
                b.decode()
                break
            except UnicodeDecodeError:
                b = b[:-1]
        s = b.decode() + "..."
    return s


def test_fallback_rules(spark):
    cases = [
        ["short one.", "short two."],
        ["a" * 150, "b" * 100, "c"],
        ["x" * 200, "more text follows here"],
        ["x" * 185, "y" * 40],
        ["é" * 99 + "z", "ü" * 80],
        ["a" * 196 + "€€", "next"],
    ]
    for c in cases:
        assert _fallback(spark, c) == _fallback_py(c), c
    assert _fallback(spark, ["x" * 200, "more"]) == "x" * 200


def test_cut_results_are_at_most_200_bytes(spark):
    s = _fallback(spark, ["word " * 30, "another " * 30])
    assert len(s.encode()) <= 200 and s.endswith("...")


def test_bullet_parsing(spark):
    rows = [("The gist.\n\n- first idea\n- second idea",), ("head\n- a\n* b\nplain",), ("* only\n* stars",), ("no list",)]
    df = spark.createDataFrame(rows, "c string").select(split_answer(F.col("c"), "abstract_with_bullets").alias("p"))
    got = [(r.p.summary_text, r.p.bullets) for r in df.collect()]
    assert got[0] == ("The gist.", ["first idea", "second idea"])
    assert got[1] == ("head", ["a", "b"])
    assert got[2] == ("* only\n* stars", None)
    assert got[3] == ("no list", None)


def test_summarize_api_fallback_and_missing_segment(spark):
    segs = spark.createDataFrame(
        [(1, 0, "s1", "First text."), (1, 1, "s2", "Second text."), (2, 0, "s3", "Other doc.")],
        "doc_id long, position long, segment_id string, text string")
    sel = spark.createDataFrame([(1, 1, "s2"), (1, 2, "s1"), (2, 1, "zz")], "doc_id long, rank int, segment_id string")
    picks = pick_lists(resolve_picks(sel, segs))
    docs = spark.createDataFrame([(1, "T", "en"), (2, "", "en")], "doc_id long, title string, lang string")
    body = '{"choices":[{"message":{"role":"assistant","content":"Sum.\\n- a\\n- b"}}]}'
    resp = spark.createDataFrame([(1, 200, body, None)], "doc_id long, status int, body string, error string")
    out = {r.doc_id: r for r in summarize(docs, picks, resp, opts=SummarizerOptions()).collect()}
    assert out[1].summary_text == "Sum." and out[1].bullets == ["a", "b"]
    assert [c.segment_id for c in out[1].citations] == ["s2", "s1"] and out[1].guardrails is None
    assert out[2].summary_text == JOB_FALLBACK_TEXT and out[2].guardrails.reason.startswith("API error: Segment ID zz")
    # no response at all -> extractive fallback
    out2 = {r.doc_id: r for r in summarize(docs, picks, None).collect()}
    assert out2[1].summary_text == "Second text. First text." and out2[1].guardrails.reason == FALLBACK_REASON
    assert out2[1].input_tokens == 3 + 2 and out2[1].bullets is None


def test_every_answer_of_a_document_has_its_row(spark):
    docs = spark.createDataFrame([(1, "en"), (2, "en"), (3, "en")], "doc_id long, lang string")
    picks = spark.createDataFrame([(1, ["One text."], ["s1"], None), (2, ["Two."], ["s2"], None)],
                                  "doc_id long, texts array<string>, segment_ids array<string>, error string")
    body = '{"choices":[{"message":{"role":"assistant","content":"%s"}}]}'
    resp = spark.createDataFrame([(1, 0, 200, body % "A.", None), (1, 4, 200, body % "B.", None), (1, 6, 500, "x", None),
                                  (2, 1, None, None, None), (1, 4, None, None, "late")],
                                 "doc_id long, turn int, status int, body string, error string")
    out = summarize(docs, picks, resp, answer_keys="turn")
    rows = {(r.doc_id, r.turn): (r.summary_text, r.citations is not None) for r in out.collect()}
    assert out.count() == len(rows) == 5
    assert rows == {(1, 0): ("A.", True), (1, 4): ("B.", True), (1, 6): ("One text.", False), (2, 1): ("Two.", False),
                    (3, None): ("", False)}
    none = summarize(docs, picks, None, answer_keys="turn").collect()
    assert sorted((r.doc_id, r.turn) for r in none) == [(1, None), (2, None), (3, None)]


def test_fallback_matches_restatement_on_random_unicode(spark):
    import random

    rng = random.Random(11)
    alphabet = ["a", "b", " ", "é", "ü", "€", "漢", "😀", ".", "ß"]
    cases = []
    for _ in range(60):
        n = rng.randint(0, 4)
        cases.append(["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 120))).strip() or "x"
                      for _ in range(n)])
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t array<string>")
    got = {r.i: r.s for r in df.select("i", extractive_summary(F.col("t")).alias("s")).collect()}
    for i, c in enumerate(cases):
        assert got[i] == _fallback_py(c), c
        assert len(got[i].encode()) <= 200
