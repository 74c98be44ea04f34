import zlib
from types import SimpleNamespace

import numpy as np

from parasift.llm import langid, pseudo, toxicity
from parasift.llm.q_langid import op7_language_mixture
from parasift.llm.q_pseudo import op10_pseudo_likelihood
from parasift.llm.q_toxicity import op8_toxicity

SF = "/root/testdata/sf0.01"


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def _rows(name):
    import duckdb

    return duckdb.sql(f"SELECT * FROM '{SF}/{name}.parquet'")


def test_language_accuracy_on_held_out_rows(spark):
    lang = dict(_rows("documents").select("doc_id, lang").fetchall())
    rows = op7_language_mixture(spark, SF).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(lang) and all(r["held_out"] == fold(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.97 * len(held)


def test_language_mixture_and_edge_cases(spark, make_docs):
    learn = spark.createDataFrame(
        [("the cat and the house of the king " * 5, "en"), ("die katze und das haus der könige " * 5, "de"), ("nothing", None), (None, "en")],
        "text string, lang string")
    model = langid.train(langid.count(learn))
    docs = make_docs([(1, "the house of the cat " * 20 + "das haus und die katze " * 10), (2, "the king and the cat"), (3, None), (4, ""),
                      (5, "123 -- !!"), (8, "½ ² ①② Ⅷ 〇"), (None, "der könig " * 9), (7, "das haus " * 30_000)], extra=True)
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert got[1]["lang_pred"] == "en" and set(got[1]["mixture"]) == {"en", "de"} and 0.5 < got[1]["score"] < 0.85
    assert got[2]["lang_pred"] == "en" and set(got[2]["mixture"]) == {"en"}
    assert [got[i]["lang_pred"] for i in (3, 4, 5, 8)] == ["und"] * 4 and got[3]["score"] == 0
    assert got[None]["lang_pred"] == "de" and got[7]["lang_pred"] == "de" and got[7]["id"] == "clash"
    none = langid.train(langid.count(learn.where("false")))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(make_docs([]), model).count() == 0


def _mixture_by_rule(text, model):
    """Proportions by EM and elimination, in plain Python."""
    import math

    folded = [c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in text.encode()]
    words = bytes(folded).split(b" ")
    langs = range(len(model.langs))
    rows = []
    for w in filter(None, words):
        b = [32, *w, 32]
        grams = [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 0x9E3779B1 % 2**32) >> 18 for i in range(len(w))]
        rows.append([sum(float(model.logp[g][k]) for g in grams) for k in langs])
    like = [[math.exp(x - max(r)) for x in r] for r in rows]

    def em(chosen):
        share = [1 / len(chosen)] * len(chosen)
        for _ in range(langid.STEPS if len(chosen) > 1 else 0):
            total = [sum(s * r[k] for s, k in zip(share, chosen)) for r in like]
            new = [s * sum(r[k] / t for r, t in zip(like, total)) / len(like) for s, k in zip(share, chosen)]
            moved, share = max(abs(a - b) for a, b in zip(new, share)), new
            if moved < 1e-4:
                break
        whole = sum(share)
        share = [s / whole for s in share]
        return share, sum(math.log(sum(s * r[k] for s, k in zip(share, chosen))) for r in like)

    chosen = list(langs)
    share, fit = em(chosen)
    while len(chosen) > 1:
        least = share.index(min(share))
        rest = chosen[:least] + chosen[least + 1 :]
        share2, fit2 = em(rest)
        if fit - fit2 > langid.PENALTY * math.log(len(rows) + 1):
            break
        chosen, share, fit = rest, share2, fit2
    return {model.langs[k]: s for k, s in zip(chosen, share)}


def test_language_mixture_equals_plain_em(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(langid.count(docs.where("doc_id % 3 > 0").select("text", "lang")))
    few = docs.where("doc_id % 40 = 0").select("doc_id", "text")
    got = {r["doc_id"]: r for r in langid.predict(few, model).collect()}
    for r in few.collect():
        want = _mixture_by_rule(r["text"], model)
        mine = got[r["doc_id"]]
        assert set(mine["mixture"]) == {k for k, v in want.items() if v > 0}, r["doc_id"]
        assert all(abs(mine["mixture"][k] - v) < 1e-6 for k, v in want.items() if v > 0)
        assert abs(mine["score"] - max(want.values())) < 1e-6


def test_toxicity_on_held_out_rows(spark):
    labels = dict(_rows("labels").select("doc_id, toxic").fetchall())
    rows = op8_toxicity(spark, SF).collect()
    assert all(r["held_out"] == fold(r["doc_id"]) and (r["predicted"] == 1) == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    clean = [p for p, y in held if y == 0]
    assert sum(clean) <= 0.05 * len(clean)  # clean documents are left alone, even with few labels to learn from
    assert sum(p for p, y in held if y == 1) >= 0.25 * sum(y for _, y in held)


def _toxic_rows():
    plain = [(" ".join(f"w{(i * 7 + k * k) % 97}" for k in range(30)), 0) for i in range(400)]
    bad = [(" ".join(f"w{(i * 5 + k * k) % 97}" for k in range(30)) + [" vile", " scum"][i % 2] + f" w{i % 90}", 1) for i in range(120)]
    return plain + bad


def test_toxic_words_are_learned_and_found_anywhere(make_docs):
    model = toxicity.train(_toxic_rows())
    long_text = "w1 w2 w3 w4 w5 " * 20_000
    docs = make_docs([(1, "w3 w4 VILE! w5"), (2, long_text + "scum"), (3, long_text), (4, None), (5, ""), (None, "w9 scum"), (6, "vi le s cum")], extra=True)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3, 4, 5, None, 6)] == [1, 1, 0, 0, 0, 1, 0]
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6]
    assert toxicity.score(make_docs([]), model).count() == 0


def test_margin_equals_plain_compression():
    """Window lengths by fresh compressors, one call a window."""
    import zstandard

    model = toxicity.train(_toxic_rows())

    def length(window, content):
        params = zstandard.ZstdCompressionParameters(
            strategy=zstandard.STRATEGY_GREEDY, min_match=6, hash_log=14, chain_log=14, search_log=5, window_log=14,
            target_length=0, write_content_size=False, write_checksum=False, write_dict_id=False)
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
        return len(zstandard.ZstdCompressor(compression_params=params, **({"dict_data": held} if held else {})).compress(window))

    for text in ["w3 vile w4", "plain words only here", " ".join(f"w{i}" for i in range(200)) + " scum and vile", ""]:
        words = toxicity.words_of(text)
        margins = [0]
        for i in range(0, len(words), toxicity.WINDOW_WORDS):
            codes = b"".join(toxicity.word_codes([w])[0] for w in dict.fromkeys(words[i : i + toxicity.WINDOW_WORDS]))
            window = toxicity.PADDING + codes
            margins.append(length(window, model.ordinary) - length(window, model.toxic))
        assert model.scorer()(text)[0] == max(margins)


def test_clean_rows_keep_their_columns(spark):
    model = toxicity.train(_toxic_rows())
    docs = spark.createDataFrame([(1, "w1 vile", "a", 5, "k", "b"), (2, "w1 w2", "x", 7, "y", None)],
                                 "doc_id long, text string, score string, margin int, _body string, c0 string")
    kept = toxicity.keep_clean(docs, model)
    assert kept.dtypes == docs.dtypes and [tuple(r) for r in kept.collect()] == [(2, "w1 w2", "x", 7, "y", None)]


def test_rows_are_dropped_whatever_their_columns_are_named(spark):
    from parasift.llm.common import row_key, without_rows

    docs = spark.createDataFrame([(1, "a", 2), (2, "b", 3), (2, "b", 3)], "_key long, _gone string, _key2 int")
    gone = docs.where("_key = 1").select(*row_key(docs))
    assert [tuple(r) for r in without_rows(docs, gone, True).collect()] == [(2, "b", 3)]


def test_toxic_passage_of_words_that_occurred_before():
    model = toxicity.Model(toxicity.segment_codes([b"vile ", b"scum ", b"filth ", b"creep "]), b"", 5)
    weak, filler = ["vile", "scum", "filth", "creep"], [f"w{i}" for i in range(400)]
    apart = [w for i, x in enumerate(weak) for w in [x, *filler[i * 100 : i * 100 + 95]]]  # one to a window
    margin = model.scorer()
    alone, whole = margin(" ".join(weak))[0], margin(" ".join(apart))[0]
    assert alone > whole
    assert margin(" ".join(apart + weak))[0] == alone


def test_toxicity_without_labels(spark, make_docs):
    model = toxicity.fit(spark.createDataFrame([("x", None), (None, 0)], "text string, toxic int"))
    assert [r["predicted"] for r in toxicity.score(make_docs([(1, "x"), (2, None)]), model).collect()] == [0, 0]


def test_pseudo_likelihood_prefers_learned_order(spark, make_docs):
    order = [f"k{i}" for i in range(40)]
    docs = make_docs([(i, " ".join(order[(i + k) % 40] for k in range(120))) for i in range(300)])
    net = pseudo.train(docs)
    test = make_docs([(1, " ".join(order)), (2, " ".join(order[::-1])), (3, None), (4, " .. "), (None, "k1"), (5, "k1 k2 " * 60_000)], extra=True)
    got = {r["doc_id"]: r for r in pseudo.score(test, net).collect()}
    assert got[1]["mean_log_prob"] > got[2]["mean_log_prob"] + 1
    assert got[3]["n_words"] == 0 and got[3]["pseudo_log_likelihood"] == 0 and got[3]["mean_log_prob"] is None
    assert got[4]["n_words"] == 0 and got[None]["n_words"] == 1 and got[5]["n_words"] == 120_000 and got[1]["score"] == "clash"
    empty = pseudo.train(make_docs([]))
    assert pseudo.score(make_docs([(1, "a b")]), empty).count() == 1 and pseudo.score(make_docs([]), empty).count() == 0


def test_pseudo_likelihood_is_a_distribution():
    import numpy as np

    net = pseudo.Network.fresh([1, 2, 3], [5, 4, 3], 20)
    around = np.array([[0, 1, pseudo.CLASSES, 2]])
    total = sum(np.exp(net.log_probs(around, np.array([c]))[0]) for c in range(pseudo.CLASSES))
    assert abs(total - 1) < 1e-4


def test_pseudo_likelihood_tells_words_of_a_shared_class_apart(spark, make_docs):
    import math

    many = [f"q{i}zz" for i in range(3000)]  # one ending, far more than the classes
    docs = make_docs([(i, " ".join(many[(i * 75 + k) % 3000] for k in range(300))) for i in range(40)] + [(99, "rarezz " * 3)])
    model = pseudo.train(docs)
    assert len(model.net.known) < 3000
    known = set(model.net.known.tolist())
    one = {w: int(pseudo._words(pseudo._FOLD[list(w.encode())])[0].hash[0]) for w in [*many, "rarezz", "madeupzz"]}
    shared = next(w for w in many if one[w] not in known)
    got = {r["doc_id"]: r["pseudo_log_likelihood"] for r in pseudo.score(make_docs([(1, shared), (2, "rarezz"), (3, "madeupzz"), (4, shared)]), model).collect()}
    assert one["rarezz"] not in known and got[1] == got[4]
    assert abs(got[1] - got[3] - math.log(4)) < 1e-6  # every word of many occurs four times
    assert abs(got[2] - got[3] - math.log(3)) < 1e-6
    assert model.net.shared.sum() + sum(r["n"] for r in pseudo.count_words(docs).collect() if r["word"] % 2**64 in known) == 12_003


def test_pseudo_likelihood_trains_on_every_position():
    import numpy as np

    hashes = np.random.default_rng(3).integers(0, 2**63, 10_000, dtype=np.uint64)
    picked = pseudo._rounds(hashes, np.array([0, 4000, 4000, 10_000]))
    assert sorted(set(picked.tolist())) == list(range(pseudo.ROUNDS)) and len(picked) == len(hashes)
    assert (pseudo._rounds(hashes[4000:], np.array([0, 6000])) == picked[4000:]).all()  # wherever the text is read
    net = pseudo.Network.fresh([1, 2, 3], [5, 4, 3], 20)
    around, target = np.array([[0, 1, pseudo.CLASSES, 2]] * 64), np.ones(64, int)
    before = net.log_probs(around, target)[0]
    net.learn(around, target, [np.zeros_like(p) for p in net.parameters()])
    assert net.log_probs(around, target)[0] > before


def test_query_scores_every_document(spark, sf_dir, duck):
    rows = op10_pseudo_likelihood(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in duck.sql("SELECT doc_id FROM documents").fetchall())
    assert all(r["pseudo_log_likelihood"] < 0 for r in rows if r["n_words"])


def test_pseudo_likelihood_same_sums_by_table_and_join(spark, make_docs):
    docs = make_docs([(i, " ".join(f"w{(i * 7 + k * k) % 4000}y" for k in range(200))) for i in range(60)])
    score = lambda m: {r["doc_id"]: r["pseudo_log_likelihood"] for r in pseudo.score(docs, m).collect()}
    model = pseudo.train(docs)
    none, some = pseudo.train(docs, table_words=0), pseudo.train(docs, table_words=100)
    assert len(model.words) and not model.vocabulary.count()
    assert not len(none.words) and 0 < len(some.words) <= 100 and some.vocabulary.count() + len(some.words) == len(model.words)
    want = score(model)
    for other in (none, some):
        got = score(pseudo.Model(model.net, other.words, other.log_n, other.vocabulary))
        assert all(abs(got[i] - want[i]) < 1e-9 * abs(want[i]) for i in want)


def test_pseudo_likelihood_copies_follow_the_corpus():
    # bytes of all copies for each word of the corpus, for vocabularies that grow with it
    for words in (10**6, 10**8, 10**10):
        side = max(pseudo.GROUPS, int((2 * (words / 20) ** 0.5) ** 0.5) + 1)
        parameters = len(pseudo.Network.fresh([], [], 0, side).flat())
        copies = pseudo.most_copies(words, parameters)
        assert copies == 1 or copies * parameters * 4 <= 4 * words / (pseudo.ROUNDS * pseudo.LEAST_TARGETS)


def test_pseudo_likelihood_step_equals_the_plain_rule():
    import numpy as np

    net = pseudo.Network.fresh([1, 2, 3], [5, 4, 3], 20)
    draw = np.random.default_rng(2)
    around, target = draw.integers(0, net.classes + 1, (200, 4)), draw.integers(0, net.classes, 200)
    plain = net.replaced(net.flat().copy())
    hidden = np.tanh(plain.bias + sum(plain.inside[k][around[:, k]] for k in range(4)))
    soft = lambda x: np.exp(x - x.max(axis=1, keepdims=True)) / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
    group, own = target % net.groups, target // net.groups
    error = (soft(hidden @ plain.group + plain.group_prior) - np.eye(net.groups)[group]) / 200
    low = (soft(np.einsum("nh,nhm->nm", hidden, plain.member[group]) + plain.member_prior[group]) - np.eye(net.groups)[own]) / 200
    back = (error @ plain.group.T + np.einsum("nm,nhm->nh", low, plain.member[group])) * (1 - hidden**2)
    grads = [np.zeros(p.shape) for p in plain.parameters()]
    for k in range(4):
        np.add.at(grads[0][k], around[:, k], back)
    grads[1], grads[2], grads[3] = back.sum(axis=0), hidden.T @ error, error.sum(axis=0)
    np.add.at(grads[4], group, np.einsum("nh,nm->nhm", hidden, low))
    np.add.at(grads[5], group, low)
    seen = [np.zeros_like(p) for p in net.parameters()]
    net.learn(around, target, seen)
    for p, q, g, s in zip(net.parameters(), plain.parameters(), grads, seen, strict=True):
        assert np.allclose(s, g * g, rtol=1e-3, atol=1e-9)
        assert np.allclose(p, q - pseudo.RATE * g / np.sqrt(g * g + 1e-8), atol=1e-3)


def test_pseudo_sums_of_runs_and_logits_beyond_the_range_of_exp():
    rows = np.random.default_rng(2).normal(size=(50, 24)).astype(np.float32)
    head = np.array([0, 1, 7, 8, 30])
    for columns in (24, 23):
        part = np.ascontiguousarray(rows[:, :columns])
        assert np.allclose(pseudo._sums(part, head), np.add.reduceat(part, head, axis=0), atol=1e-5)
    small = rows.copy()
    pseudo._lower(small)
    assert (small == rows).all()
    for large in (rows + 500, rows - 500):
        pseudo._lower(large)
        assert (large.max(axis=1) == 0).all()


def _plain_step(p, seen, around, target):
    """One Adagrad step on 64-bit copies of a network's parameters."""
    inside, bias, group, group_prior, member, member_prior = p
    side, n, rows = len(group_prior), len(target), np.arange(len(target))
    hidden = np.tanh(bias + sum(inside[k][around[:, k]] for k in range(4)))
    soft = lambda x: np.exp(x - x.max(axis=1, keepdims=True)) / np.exp(x - x.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
    of, own = target % side, target // side
    error = soft(hidden @ group + group_prior)
    low = soft(np.einsum("nh,nhm->nm", hidden, member[of]) + member_prior[of])
    error[rows, of] -= 1
    low[rows, own] -= 1
    error, low = error / n, low / n
    back = (error @ group.T + np.einsum("nm,nhm->nh", low, member[of])) * (1 - hidden**2)
    grads = [np.zeros(x.shape) for x in p]
    for k in range(4):
        np.add.at(grads[0][k], around[:, k], back)
    grads[1], grads[2], grads[3] = back.sum(axis=0), hidden.T @ error, error.sum(axis=0)
    np.add.at(grads[4], of, np.einsum("nh,nm->nhm", hidden, low))
    np.add.at(grads[5], of, low)
    for x, g, s in zip(p, grads, seen, strict=True):
        s += g * g
        x -= pseudo.RATE * g / np.sqrt(s + 1e-8)


def test_pseudo_steps_sorted_together_equal_plain_steps():
    draw = np.random.default_rng(4)
    for side, groups in ((32, 32), (33, 3)):
        net = pseudo.Network.fresh([1, 2, 3], [5, 4, 3], 20, side)
        n = 64 * (pseudo.PLANNED + 2) + 13  # two plans and a shorter step
        around = draw.integers(0, net.classes + 1, (n, 4))
        around[draw.random((n, 4)) < 0.5] = 7  # in more rows of a step than are added up by rank
        target = draw.integers(0, side, n) * side + draw.integers(0, groups, n)
        plain = [p.astype(np.float64) for p in net.parameters()]
        seen = [np.zeros(p.shape) for p in plain]
        copy = pseudo.Copy(net)
        copy.learn(around, target, 64)
        for at in range(0, n, 64):
            _plain_step(plain, seen, around[at : at + 64], target[at : at + 64])
        for p, q in zip([*copy.parameters(0), *copy.parameters(1)], [*plain, *seen], strict=True):
            assert np.allclose(p, q, rtol=1e-3, atol=2e-3)
        assert all((p == q).all() for p, q in zip(copy.network().parameters(), copy.parameters(0), strict=True))


def test_pseudo_logits_beyond_the_range_of_exp_are_shifted():
    draw = np.random.default_rng(6)
    around, target = draw.integers(0, 1024, (100, 4)), draw.integers(0, 1024, 100)
    net = pseudo.Network.fresh([1, 2, 3], [5, 4, 3], 20)
    want = net.log_probs(around, target)
    for by in (200, -200):  # the same distribution
        net.group_prior += np.float32(by)
        net.member_prior += np.float32(by)
        assert np.allclose(net.log_probs(around, target), want, atol=1e-3)
        copy = pseudo.Copy(net)
        copy.learn(around, target)
        assert all(np.isfinite(p).all() for k in (0, 1) for p in copy.parameters(k))
        assert copy.network().log_probs(around, target).mean() > want.mean()
        net.group_prior -= np.float32(by)
        net.member_prior -= np.float32(by)


def test_pseudo_distinct_words_and_table_with_common_first_bits():
    draw = np.random.default_rng(8)
    words = draw.integers(0, 40, 3000, dtype=np.uint64) << np.uint64(58) | draw.integers(0, 60, 3000, dtype=np.uint64)
    tails = words * np.uint64(31) % np.uint64(65_521)
    for some in (words, words[:1], words[:0]):
        want = np.unique(some, return_counts=True)
        word, n, tail = pseudo._distinct(some, tails[: len(some)])
        assert (word == want[0]).all() and (n == want[1]).all() and (tail == word * np.uint64(31) % np.uint64(65_521)).all()
    known = np.unique(words)[::2]
    model = pseudo.Model(None, known, np.arange(len(known)) + 0.5, None)
    found, log_n = model.logs(words)
    assert (found == np.isin(words, known)).all()
    assert (log_n == np.where(found, np.searchsorted(known, words) + 0.5, 0)).all()


def test_pseudo_steps_of_numbers_beyond_32_bits():
    draw = np.random.default_rng(9)
    around, target = draw.integers(0, 90, (64 * 3, 4)), draw.integers(0, 1000, 64 * 3)
    one, two = (list(pseudo._steps(around, target, SimpleNamespace(groups=33, classes=c), 64)) for c in (1089, 1 << 26))
    for a, b in zip(one, two, strict=True):
        for x, y in zip((a[0], a[3]), (b[0], b[3]), strict=True):  # side and class of each cell
            assert (x // 1090 == y // ((1 << 26) + 1)).all() and (x % 1090 == y % ((1 << 26) + 1)).all()
        assert a[1] == b[1] and all((x == y).all() for x, y in zip([a[2], *a[4], *a[5:]], [b[2], *b[4], *b[5:]], strict=True))
    values = draw.integers(0, 50, 1000)
    value, place = pseudo._sorted(values, 10, 1 << 40)
    assert (place == np.argsort(values, kind="stable")).all() and (value == np.sort(values)).all() and len(values.take(place)) == 1000
