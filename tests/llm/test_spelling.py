import random
import re
import zlib
from collections import Counter

import numpy as np

from parasift.llm import spelling
from parasift.llm.spelling import (choose_groups, gram_pairs, letter_groups, letter_use, letters_matrix, near_words, roots, variants,
                                   vocabulary)


def words_by_rule(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 2}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_rule(rows):
    n = words_by_rule(rows)
    out = {}
    for w in n:
        close = sorted((v for v in n if near(w, v)), key=lambda v: (-n[v], v))
        form = close[0] if close and n[close[0]] >= 10 * n[w] else None
        out[w] = [form, n[w], len(close), n[form] if form else None]
    for w in out:
        r = w
        while out[r][0]:
            r = out[r][0]
        out[w].append(r)
    return out


def run(df):
    rows = variants(df).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: [r["form"], r["n"], r["n_near"], r["form_n"], r["root"]] for r in rows}


def planted_rows():
    """Frequent words, slips of them, slips of slips, anagrams and accents."""
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(7, 10))) for _ in range(25)]
    rows = []
    for k, w in enumerate(base):
        i = rng.randrange(len(w))
        slip = w[:i] + "x" + w[i:]
        twice = slip[:-1] + "y"
        swap = w[1] + w[0] + w[2:]
        rows.append((100 + k, " ".join([w] * 400 + [slip] * 35 + [twice] * 3 + [swap] * 2 + [w[:-1]] * 5 + [w.upper()] * 4)))
    return rows


def test_equals_brute_force_on_planted_words(make_docs):
    rows = planted_rows() + [(1, None), (2, ""), (None, "justonce nullident nullident"), (3, "short words only Ænigmatic ænigmatic"),
                             (4, "repeated repeated"), (4, "repeated repeated"), (5, "word×word÷mark word×word÷mark")]
    got, want = run(make_docs(rows, extra=True)), by_rule(rows)
    assert got == want
    assert max(sum(1 for _ in iter(lambda c=[w]: c.__setitem__(0, want[c[0]][0]) or c[0], None)) for w in want) >= 2  # chains


def test_query_equals_brute_force_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert run(docs) == by_rule([tuple(r) for r in docs.collect()])


def test_tiles_of_any_size_give_the_same_words(make_docs, monkeypatch):
    rows = planted_rows()
    words = vocabulary(make_docs(rows))
    whole = sorted(near_words(words).collect())
    for groups in (3, 6):
        monkeypatch.setattr(spelling, "LEFT_ROWS", 2)
        monkeypatch.setattr(spelling, "RIGHT_ROWS", 3)
        monkeypatch.setattr(spelling, "CELLS", 4)
        monkeypatch.setattr(spelling, "LETTERS", 16)
        assert sorted(near_words(words, letter_groups(letter_use(words), groups)).collect()) == whole


def test_more_words_take_more_letter_groups(make_docs, monkeypatch):
    words = vocabulary(make_docs(planted_rows()))
    assert len(choose_groups(words)) == 3
    monkeypatch.setattr(spelling, "PAIRS_PER_WORD", 1)
    assert len(choose_groups(words)) > 3


def test_gram_distances_are_those_of_letter_counts():
    rng = random.Random(2)
    left = ["".join(rng.choice("abcd") for _ in range(7)).encode() for _ in range(60)]
    right = ["".join(rng.choice("abcd") for _ in range(8)).encode() for _ in range(50)]
    got = {(int(i), int(j)) for a, b in gram_pairs(letters_matrix(left), letters_matrix(right)) for i, j in zip(a, b)}
    far = lambda a, b: sum((a.count(c) - b.count(c)) ** 2 for c in b"abcd")
    assert got == {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if far(a, b) <= 2} and got


def test_very_long_words(make_docs):
    w = "ab" * 30_000
    rows = [(k, f"{w} {w} {w[:-1]} {w[:-1]} {w[:-1]}c {w[:-1]}c") for k in (1, 2, 7)]
    assert run(make_docs(rows)) == by_rule(rows)


def test_empty_table_and_no_words(make_docs):
    assert run(make_docs([])) == {} and run(make_docs([(1, None), (2, "a b c")])) == {}


def test_long_chain_reaches_its_root(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(7)]
    got = dict(map(tuple, roots(spark.createDataFrame(chain, "word string, form string"), 10**7).collect()))
    assert got == {f"w{i}": "w7" for i in range(7)}


def test_letter_groups_share_the_load():
    groups = letter_groups([("a", 10), ("b", 9), ("c", 1), ("d", 1)], 3)
    assert sorted(groups) == ["a", "b", "cd"] and np.prod([len(g) for g in groups])
