"""Stages against plain versions of the same decisions."""

import tiktoken

import corpus_pipeline as cp
from parasift.llm import toxicity
from parasift.llm.q_toxicity import labelled_rows

from test_decontaminate import brute as leak_pairs
from test_jaccard import brute as components


def test_stages_and_their_order():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "ngram_jaccard_join", "decontamination", "byte_bpe"]


def test_every_stage_against_brute_force(spark, sf_dir, duck):
    import public_tokenizers

    from parasift.llm.bpe import load_ranks
    from parasift.llm.common import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, text = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    margin = toxicity.fit(labelled_rows(spark, docs, sf_dir))
    scorer = margin.scorer()
    want = {i for i, t in text.items() if margin.score(scorer(t)[0]) < 0.7}
    items = duck.sql("SELECT item_id, text FROM benchmark").fetchall()
    kept = []
    for name, stage in cp.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
        if name == "exact_dedup":
            best = {}
            for i in want:
                key = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text[i] or "")
                best[key] = max(best.get(key, -1), i)
            want = set(best.values())
        elif name == "ngram_jaccard_join":
            want = {c for _, c in components([(i, text[i]) for i in want], 5, 80).values()}
        elif name == "decontamination":
            found = {i for i, _ in leak_pairs([(i, text[i]) for i in want], [(j, t) for j, t in items if t])}
            want -= found
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == want
        kept.append(len(want))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                              mergeable_ranks=load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    out = cp.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"]: r["ids"] for r in out} == {i: plain.encode_ordinary(text[i] or "") for i in want}
    assert kept[0] >= kept[1] > kept[2] > kept[3]


def test_stages_take_odd_rows(spark, make_docs, sf_dir):
    docs = make_docs([(1, None), (None, "a b c d e f g"), (2, ""), (2, ""), (3, "x " * 50_000)], extra=True)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    assert sorted((r["doc_id"] or 0) for r in cp.STAGES[-1][1](spark, docs, sf_dir).collect()) == [0, 2, 3]


def test_stages_take_an_empty_table(spark, make_docs, sf_dir):
    docs = make_docs([])
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, sf_dir)
    assert docs.count() == 0
