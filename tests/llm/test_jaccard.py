import random
import re
from itertools import combinations

import numpy as np
import pytest

from parasift.llm.hashing import shingle_sets, utf8_parts
from parasift.llm.jaccard import TAG_BITS, JaccardJoin, block_index, block_keys, classes, keep_one
from parasift.llm.q_jaccard import op5_ngram_jaccard_join


def shingles(text, n):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", folded)
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute(rows, n, percent):
    sets, up = [(i, shingles(t, n)) for i, t in rows], {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for (i, a), (j, b) in combinations(sets, 2):
        both = len(a & b)
        if both and 100 * both >= percent * (len(a) + len(b) - both):
            x, y = sorted((find(i), find(j)))
            up[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed, n_base=6, copies=9):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 4)))
    shared = [word() for _ in range(30)]
    rows = []
    for _ in range(n_base):
        base = [word() for _ in range(rng.randrange(8, 160))] + shared
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randrange(0, 6)):
                k = rng.randrange(len(w))
                w[k : k + rng.randrange(2)] = [word()]
            rows.append((len(rows) + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize(("words", "percent"), [(3, 90), (5, 80), (1, 60)])
def test_same_components_as_brute_force(make_docs, words, percent):
    rows = corpus(words * 100 + percent)
    rows += [(900, None), (901, ""), (902, " \n\t "), (903, "Two words"), (904, "two WORDS"), (905, "one"), (906, "x y z " * 20_000)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes(make_docs(rows, extra=True), words=words, percent=percent).collect()}
    assert got == brute(rows, words, percent)


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for percent in (60, 80, 90, 95):
        for _ in range(150):
            n = int(rng.integers(2, 400))
            base = rng.integers(0, 2**64, n, dtype=np.uint64)
            gone = int(rng.integers(0, max(1, n * (100 - percent) // 100) + 1))
            other = np.concatenate([base[gone:], rng.integers(0, 2**64, int(rng.integers(0, gone + 1)), dtype=np.uint64)])
            a, b = np.unique(base), np.unique(other)
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert len(np.intersect1d(block_keys(a, percent), block_keys(b, percent)))


def test_null_ids_repeated_rows_and_empty_table(make_docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b c d e f")]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in classes(make_docs(rows), words=3, percent=90).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 1)]
    assert classes(make_docs([])).count() == 0 and keep_one(make_docs([])).count() == 0


def test_keep_one_of_each_group(make_docs):
    rows = corpus(11)
    docs = make_docs([*rows, (None, rows[0][1]), rows[0], (800, None), (801, "")], extra=True)
    want = {c for _, c in brute(rows, 5, 80).values()} | {800, 801}
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(want)


def test_hashes_do_not_depend_on_neighbours():
    import pyarrow as pa

    texts = ["One two  three four", None, "", "x", "é one two three", "ONE two three four " * 400]
    alone = [next(shingle_sets(*p[1:], 3)).tolist() for t in texts for p in utf8_parts(pa.array([t], pa.string()))]
    for limit in (1, 50, 1 << 20):
        together = [s.tolist() for p in utf8_parts(pa.array(texts), limit) for s in shingle_sets(p[1], p[2], 3)]
        assert together == alone


def test_query_against_brute_force(spark, sf_dir, duck):
    want = brute(duck.sql("SELECT doc_id, text FROM documents").fetchall(), 3, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in op5_ngram_jaccard_join(spark, sf_dir).collect()}
    assert got == want


def test_one_id_with_several_texts(make_docs):
    base = " ".join(f"w{i}" for i in range(120))
    near = base.replace("w60 ", "x ")
    rows = [(1, "other words of no relation at all"), (1, base), (1, base), (2, near), (3, base + " tail")]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in classes(make_docs(rows), words=3, percent=90).collect())
    assert got == [(1, 5, 1), (1, 118, 1), (1, 118, 1), (2, 118, 1), (3, 119, 1)]


def test_texts_reach_the_workers_in_small_batches_and_parts(spark, make_docs, monkeypatch):
    from parasift.llm import common, jaccard

    seen = []
    own = common.materialise_at

    def watched(df, path):
        if "jaccard-keys" in path or "jaccard-star-" in path or "jaccard-rep-sets" in path:
            seen.append(int(spark.conf.get(common._BATCH_CONF)))
        return own(df, path)

    monkeypatch.setattr(jaccard, "materialise_at", watched)
    before = spark.conf.get(common._BATCH_CONF)
    text = " ".join(f"w{k}" for k in range(300))
    rows = jaccard.classes(make_docs([(1, text), (2, text + " x"), (3, "other words than those of the rest")])).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {1: 1, 2: 1, 3: 3}
    assert len(seen) == 2 and max(seen) <= common.BATCH_ROWS and spark.conf.get(common._BATCH_CONF) == before


def test_texts_that_share_phrases_only_are_not_compared(make_docs):
    rng = random.Random(11)
    phrases = [" ".join(f"p{k}x{j}" for j in range(5)) for k in range(4)]
    rows = []
    for i in range(1, 61):
        parts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(25)) for _ in range(12)]
        for at, phrase in zip(rng.sample(range(12), 4), phrases, strict=True):
            parts[at] += f" {phrase}"
        rows.append((i, " ".join(parts)))
    rows.append((61, f"{rows[0][1]} end"))
    join = JaccardJoin(make_docs(rows), words=5, percent=80)
    assert join._star().count() == 1
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in classes(make_docs(rows), words=5, percent=80).collect()}
    assert got == brute(rows, 5, 80) and got[61][1] == 1


def test_linked_sets_meet_in_one_of_the_lists_that_are_kept():
    rng = np.random.default_rng(5)
    for percent in (60, 80, 90):
        for n in (5, 30, 200, 900):
            base = np.unique(rng.integers(0, 2**64, n, np.uint64))
            sets = [base]
            while len(sets) < 6:
                other = np.unique(np.append(rng.permutation(base)[: n - rng.integers(n // 5 + 1)], rng.integers(0, 2**64, rng.integers(n // 5 + 1), np.uint64)))
                both = len(np.intersect1d(base, other))
                if 100 * both >= percent * (len(base) + len(other) - both):
                    sets.append(other)
            index = [block_index(s, percent) for s in sets]
            for keys, needs in index[1:]:
                agreed = np.intersect1d(keys, index[0][0]) % (1 << TAG_BITS)
                tags = [dict(zip(x % (1 << TAG_BITS), x >> TAG_BITS, strict=True)) for x in (needs, index[0][1])]
                if len(keys):
                    assert any((agreed == t).sum() >= max(tags[0][t], tags[1][t]) for t in tags[0].keys() & tags[1].keys())
