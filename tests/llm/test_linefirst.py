import re
from collections import Counter

import duckdb
import pytest

from parasift.llm.linefirst import FIELDS, clean_documents, failed_rule, judge, judge_documents
from parasift.llm.q_linefirst import ORACLE

PROSE = "\n".join("Few " + " ".join(f"word{i * 20 + j}" for j in range(11)) + " end here." for i in range(8))
CASES = {
    1: None, 2: "", 3: "   \n\t\n ", 4: PROSE, 5: PROSE + "\nhome | news | sport | weather | contact",
    6: "Home > a\n" * 3 + "menu item\n" * 60 + PROSE, 7: "the same words again. " * 40, 8: PROSE + "\n" + PROSE.split("\n")[2],
    9: PROSE + "\nAll rights reserved.\nWe use cookies.", 10: "\n".join(f"{i}*** b$$$ c%%% d&&&" for i in range(40)),
    11: "".join(f"Très long texte {i}, avec{i} des{i} mots{i} divers{i} et{i} variés{i} qui{i} finissent{i} bien{i} ici.\n" for i in range(3000)),
    12: "one two　three " * 30, 13: PROSE.replace("\n", "\r\n"), 14: "word " * 49 + "end.", 15: "a b c a b c " + PROSE,
}


def base_by_rule(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_base_equals_the_rules(make_docs):
    docs = make_docs(list(CASES.items()), extra=True)
    out = judge_documents(docs)
    assert out.columns == ["doc_id", *[f.split()[0] for f in FIELDS.split(", ")]]
    rows = {r["doc_id"]: r for r in out.collect()}
    for i, text in CASES.items():
        assert tuple(rows[i])[1:7] == base_by_rule(text), i
    assert {i for i, r in rows.items() if r["kept"]} == {4, 5, 8, 9, 11, 13, 15}
    assert rows[5]["clean_text"] == PROSE and rows[9]["clean_text"] == PROSE
    assert rows[5]["n_navigation"] == 0 and rows[5]["n_punctuation"] + rows[9]["n_boilerplate"] == 3


def test_equals_sql_on_the_cases(make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([*CASES.items(), (4, PROSE), (None, PROSE)])
    got = judge_documents(docs).withColumn("clean_sha256", F.sha2(F.col("clean_text").cast("binary"), 256)).drop("clean_text")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    want = con.sql(ORACLE)
    place = [want.columns.index(c) for c in got.columns]
    rows = Counter(tuple(r[i] if r[i] == r[i] else None for i in place) for r in want.fetchall())
    assert Counter(map(tuple, got.collect())) == rows


@pytest.mark.parametrize("line,rule", [
    ("A line that ends a sentence.", None), ("no end here", "punctuation"), ("« Une phrase finie. »", None), ("end.  ", None),
    ("word " * 20, None), ("*** a $$$ b.", "punctuation"), ("News | Sport | Weather.", "navigation"), ("Home.", "navigation"),
    ("Homely places are often small.", None), ("Copyright 2020 by us.", "boilerplate"),
    ("A paragraph of some length that only speaks of a cookie " + "and of much else " * 15 + "too.", None),
])
def test_line_rules(line, rule):
    assert failed_rule(line, len(line.split())) == rule


def test_losing_too_much_rejects():
    mostly = PROSE + "\n" + "\n".join(f"Entry number {i} without an end" for i in range(12))
    assert judge(PROSE)[6] and not judge(mostly)[6] and not judge(mostly)[5]


def test_clean_documents_keeps_columns(make_docs):
    docs = make_docs(list(CASES.items()), extra=True)
    out = clean_documents(docs)
    assert out.columns == docs.columns
    rows = {r["doc_id"]: r for r in out.collect()}
    assert set(rows) == {4, 5, 8, 9, 11, 13, 15} and rows[5]["text"] == PROSE and rows[5]["score"] == "clash"


def test_empty_table(make_docs):
    assert judge_documents(make_docs([])).count() == 0 and clean_documents(make_docs([])).count() == 0
