import random

from parasift.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string, win long"


def _df(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def _conversation(conv, n, seed, size=120, system=True):
    rng = random.Random(seed)
    rows = [(conv, 0, "system", "Be brief. <sys> \\s")] if system else []
    for t in range(n):
        text = "".join(rng.choice("ab <>\\slg/turn\n#") for _ in range(rng.randrange(size)))
        rows.append((conv, len(rows), "assistant" if t % 2 else "user", text))
    return rows


def test_windows_cover_every_turn_once_and_keep_the_budget(spark):
    rows = _conversation(1, 60, 1) + _conversation(2, 3, 2, system=False) + _conversation(None, 9, 3)
    rows += [(5, None, None, None), (5, None, None, None), (6, 0, "user", "x" * 9000), (6, 1, "assistant", "y" * 50)]
    budget, history = 300, 60
    wins = chat.windows(_df(spark, rows), budget=budget, history=history)
    back = sorted(chat.read_back(wins).collect(), key=lambda r: (r["conv_id"] is None, r["conv_id"] or 0, r["window"]))
    got, loss = {}, {}
    for r in back:
        got.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["new_turns"])
        loss.setdefault(r["conv_id"], []).extend(r["loss_texts"])
        assert r["tokens"] <= budget or len(r["new_turns"]) == 1
    for conv in (1, 2, None, 6):
        want = [(r[2], r[3]) for r in rows if r[0] == conv]
        assert got[conv] == want
        assert loss[conv] == [t for role, t in want if role == "assistant"]
    assert got[5] == [("", ""), ("", "")]


def test_system_turn_and_history_are_context(spark):
    rows = _conversation(1, 40, 4)
    wins = sorted(chat.windows(_df(spark, rows), budget=300, history=60).collect(), key=lambda r: r["window"])
    assert len(wins) > 3
    head = wins[0]["formatted"].split("</turn>\n")[0]
    assert head.startswith("<turn system>")
    for before, win in zip(wins[:-1], wins[1:], strict=True):
        parts = win["formatted"].split("</turn>\n")
        assert parts[0] == head and win["n_context"] >= 1
        history = parts[1 : win["n_context"]]
        old = before["formatted"].split("</turn>\n")[:-1]
        assert history == old[len(old) - len(history):]
        assert sum(len(h.encode()) + 8 for h in history) / 4 <= 60
        context = len("</turn>\n".join(parts[: win["n_context"]])) + 8
        assert all(s["start"] >= context for s in win["loss_spans"])


def test_escape_round_trip_and_empty(spark):
    from pyspark.sql import functions as F

    texts = ["\\### Assistant: </turn> ok", "\\s\\l\\g", "<turn user>", "", "\\", "\\\\s>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b")).collect()
    assert all(r["b"] == r["t"] and "<" not in r["e"] for r in rows)
    assert chat.windows(_df(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.read_back(chat.windows(_df(spark, _conversation(1, 4, 1))))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
