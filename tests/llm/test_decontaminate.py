import random
import re

import numpy as np
import pytest

from parasift.llm import decontaminate as dc
from parasift.llm.q_decontaminate import op6_decontamination


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def least(item, doc):
    """Brute force: least word edit distance of item to any substring."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(doc, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def brute(docs, items, percent=80):
    found = set()
    for i, t in docs:
        d = words(t)
        for j, u in items:
            w = words(u)
            if w and least(w, d) <= len(w) * (100 - percent) // 100:
                found.add((i, j))
    return found


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 4)))
    items = [(j, " ".join(word() for _ in range(rng.choice([3, 6, 12, 25, 45])))) for j in range(20)]
    docs = []
    for i in range(n):
        own = [word() for _ in range(rng.randrange(0, 120))]
        if i % 2:
            w = words(rng.choice(items)[1])
            for _ in range(rng.randrange(0, len(w) // 4 + 1)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [word()] * rng.randrange(2)
            own[len(own) // 2 : len(own) // 2] = w
        docs.append((i, " ".join(own).capitalize() + "."))
    return docs, items


def test_same_leaks_as_brute_force(spark, make_docs):
    docs, items = corpus(5)
    table = spark.createDataFrame([*items, (100, None), (101, " .. "), (102, items[3][1])], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in dc.leaks(make_docs(docs, extra=True), table).collect()}
    want = brute(docs, [*items, (102, items[3][1])])
    assert set(got) <= want
    assert len(got) >= 0.98 * len(want) and len(want) > 20
    by_doc, by_item = dict(docs), dict([*items, (102, items[3][1])])
    for (i, j), r in got.items():
        assert r["distance"] == least(words(by_item[j]), words(by_doc[i]))


def test_recall_at_the_largest_distance():
    rng = np.random.default_rng(8)
    pool = rng.integers(1, 2**63, 5000, dtype=np.uint64)
    texts = [" ".join(f"w{int(x) % 99991}" for x in rng.choice(pool, 40)) for _ in range(100)]
    block = dc.Items(list(range(100)), texts, 80)
    hit = 0
    for j, t in enumerate(texts):
        w = t.split()
        for k in sorted(rng.choice(40, 8, replace=False), reverse=True):
            w[k : k + 1] = [[], ["zz"], [w[k], "yy"]][int(rng.integers(3))]
        h = dc.word_hashes("left side words " + " ".join(w) + " right side words")
        hit += any(i == j for _, i, *_ in block.search(h, np.zeros(len(h), int), np.array([0, len(h)])))
    assert hit >= 95


@pytest.mark.parametrize("kind", ["deletions", "insertions", "mixed"])
@pytest.mark.parametrize("n", [5, 10, 20, 30, 40, 41, 60, 81, 100, 200, 400])
def test_recall_at_the_largest_distance_by_length_and_kind(n, kind):
    assert recall(n, kind) >= 0.95


def recall(n, kind, trials=60):
    rng = np.random.default_rng(n)
    texts = [" ".join(f"w{int(x)}" for x in rng.integers(0, 99_991, n)) for _ in range(trials)]
    block = dc.Items(list(range(trials)), texts, 80)
    hit = 0
    for j, t in enumerate(texts):
        w = t.split()
        for k in sorted(rng.choice(n, n // 5, replace=False), reverse=True):
            to = {"deletions": 0, "insertions": 2, "mixed": int(rng.integers(3))}[kind]
            w[k : k + 1] = [[], ["zz"], [w[k], "yy"]][to]
        h = dc.word_hashes("left side words " + " ".join(w) + " right side words")
        hit += any(i == j for _, i, *_ in block.search(h, np.zeros(len(h), int), np.array([0, len(h)])))
    return hit / trials


def test_embedding_walks_together_again():
    rng = np.random.default_rng(1)
    a = rng.integers(1, 2**63, (1, 60), dtype=np.uint64)
    b, c = a.copy(), rng.integers(1, 2**63, (1, 60), dtype=np.uint64)
    b[0, 5:-1] = a[0, 6:]  # one deletion
    near = np.mean([(dc.embed(a, w, 100) != dc.embed(b, w, 100)).mean() for w in range(20)])
    far = np.mean([(dc.embed(a, w, 100) != dc.embed(c, w, 100)).mean() for w in range(20)])
    assert near < 0.6 * far


def test_edge_cases(spark, make_docs):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    docs = make_docs([(1, None), (2, ""), (None, "x ONE two, three four five six seven eight nine ten!"), (3, "one two three"),
                      (4, "pad " * 300_000 + "one two three four FIVE six seven eight nine ten"), (4, "clean")], extra=True)
    assert sorted((r["doc_id"] or 0, r["distance"]) for r in dc.leaks(docs, items).collect()) == [(0, 0), (4, 0)]
    kept = dc.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4]
    assert dc.leaks(docs, items.where("false")).count() == 0 and dc.keep_clean(docs, items.where("false")).count() == 6
    assert dc.leaks(make_docs([]), items).count() == 0 and dc.keep_clean(make_docs([]), items).count() == 0


def test_query_finds_every_verbatim_item(spark, sf_dir, duck):
    docs = duck.sql("SELECT doc_id, text FROM documents").fetchall()
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    got = {(r["doc_id"], r["item_id"]) for r in op6_decontamination(spark, sf_dir).collect()}
    whole = {i: " " + " ".join(words(t)) + " " for i, t in docs}
    want = {(i, j) for i, t in whole.items() for j, u in items if " " + " ".join(words(u)) + " " in t}
    assert want <= got
    assert all(least(words(dict(items)[j]), words(dict(docs)[i])) <= len(words(dict(items)[j])) // 5 for i, j in got)
