import hashlib

import public_tokenizers
import pytest
import tiktoken

from parasift.llm import bpe
from parasift.llm.q_bpe import VOCABULARY, default_codec, op2_byte_bpe

TEXTS = [None, "", "Hello world, it's 2024!  \n\n x", "naïve café — 東京 🙂 ü", "a" * 3000, " " * 500, "\t\n   end ", "<|endoftext|> 'S 's",
         "don't we'll THEY'RE", "\u0000\u0007 zero", "한국어 텍스트 ١٢٣ ½"]


@pytest.fixture(scope="module")
def plain():
    ranks = bpe.load_ranks(public_tokenizers.path(VOCABULARY))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("table_words", [1 << 20, 3, 0])
def test_same_ids_as_the_library(make_docs, plain, table_words):
    docs = make_docs([(i, t) for i, t in enumerate(TEXTS)] + [(None, "x y"), (2, TEXTS[2])], extra=True)
    rows = bpe.encode(docs, default_codec(), keep=["doc_id", "text", "words"], table_words=table_words).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        assert r["ids"] == plain.encode_ordinary(r["text"] or "") and r["words"] == "clash"


def test_decode_round_trip(make_docs):
    from pyspark.sql import functions as F

    codec = default_codec()
    docs = make_docs([(i, t) for i, t in enumerate(TEXTS)])
    rows = bpe.encode(docs, codec, keep=["text"]).select("text", codec.decode(F.col("ids")).alias("b")).collect()
    assert all(bytes(r["b"]).decode() == (r["text"] or "") for r in rows)


def test_empty_table(make_docs):
    assert bpe.encode(make_docs([]), default_codec()).count() == 0


def test_query_against_the_library(spark, sf_dir, duck, plain):
    want = {}
    for i, t in duck.sql("SELECT doc_id, text FROM documents").fetchall():
        ids = plain.encode_ordinary(t or "")
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op2_byte_bpe(spark, sf_dir).collect()}
    assert got == want


def test_long_and_short_words_fold_as_in_the_library(plain):
    import pyarrow as pa

    words = ["", "a", "zzqxj", "é東🙂", "ab" * 30_000, *("xqzjk é" * n for n in range(1, 60)), *(f"w{n * n}q" for n in range(500))]
    at, ids = default_codec().merges.fold(pa.array(words).slice(0))
    for w, a, b in zip(words, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == (plain._core_bpe.encode_single_piece(w.encode()) if w else [])
    part, few = default_codec().merges.fold(pa.array(words).slice(5, 7))
    assert few.tolist() == ids[at[5] : at[12]].tolist() and (part == at[5:13] - at[5]).all()
    at, ids = default_codec().merges.fold(pa.array([], pa.string()))
    assert at.tolist() == [0] and not len(ids)
