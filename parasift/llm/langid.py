"""Language identification by multilingual mixture inference.

Training counts hashed byte trigrams of words (with their borders) for every
language over all labelled rows; tasks count into fixed-size tables, the counts
are added by language and bucket, and the driver gets one table of
``BUCKETS`` x languages.  For a document, each word has a likelihood under
every language; expectation-maximisation estimates the proportions of the
languages.  Languages are then taken out, least proportion first, as long as
that costs less log-likelihood than the penalty ``PENALTY * log(words)``.  The
prediction is the language of largest proportion in what remains.

Edge cases: null text, and text without a letter, is ``und`` with score 0; no
labelled rows: ``und`` everywhere; ties go to the first language by name; ids
and extra columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashing import utf8_parts

BUCKETS, SMOOTHING, PENALTY, STEPS = 1 << 14, 0.5, 3.0, 20
UNKNOWN = "und"
_FOLD = np.array([c + 32 if 65 <= c < 91 else c if 97 <= c < 123 or c >= 128 else 32 for c in range(256)], np.uint8)


def has_letter(text: str) -> bool:
    """Whether some character is a letter (Unicode category L: no number
    signs such as the half, circled digits or Roman numerals)."""
    return any(map(str.isalpha, text))


def _grams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each word byte (space outside of words),
    first byte of each word, and number of bytes of each word."""
    b = np.concatenate([[np.uint8(32)], _FOLD[raw], [np.uint8(32)]]).astype(np.uint32)
    inside = b[1:-1] != 32
    gram = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    bucket = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - (BUCKETS.bit_length() - 1))
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return bucket, edge[0::2], edge[1::2] - edge[0::2]


def count(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang, bucket, n`` over all rows with a language."""
    rows = labelled.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("_lang").to_pylist()
            for row, raw, offsets in utf8_parts(batch.column("_text")):
                bucket, start, size = _grams(raw)
                word = np.concatenate([[0], np.cumsum(size)])
                flat = bucket[np.repeat(start - word[:-1], size) + np.arange(word[-1])]
                at = word[np.searchsorted(start, offsets)]
                for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    total = held.setdefault(langs[row + i], np.zeros(BUCKETS, np.int64))
                    total += np.bincount(flat[a:b], minlength=BUCKETS)
        for lang, total in held.items():
            has = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(has), pa.string()), pa.array(has, pa.int32()), pa.array(total[has], pa.int64())],
                names=["lang", "bucket", "n"])

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    logp: np.ndarray  # BUCKETS x languages

    def infer(self, words: np.ndarray) -> tuple[int, np.ndarray]:
        """Language and proportions from word log-likelihoods (words x langs)."""
        top = words.max(axis=1, keepdims=True)
        like = np.exp(words - top)
        chosen = np.arange(len(self.langs))
        share, fit = _mixture(like)
        while len(chosen) > 1:
            least = int(np.argmin(share))
            rest = np.delete(np.arange(len(chosen)), least)
            smaller = like[:, chosen[rest]]
            share2, fit2 = _mixture(smaller)
            if fit - fit2 > PENALTY * np.log(len(words) + 1):
                break
            chosen, share, fit = chosen[rest], share2, fit2
        out = np.zeros(len(self.langs))
        out[chosen] = share
        return int(np.argmax(out)), out


def _mixture(like: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions by EM and the log-likelihood they reach."""
    share = np.full(like.shape[1], 1.0 / like.shape[1])
    if like.shape[1] == 1:
        return share, float(np.log(np.maximum(like[:, 0], 1e-300)).sum())
    for _ in range(STEPS):
        total = np.maximum(like @ share, 1e-300)
        new = share * (like.T @ (1.0 / total)) / len(like)
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-4:
            break
    return share / share.sum(), float(np.log(np.maximum(like @ share, 1e-300)).sum())


def train(counts: DataFrame) -> Model:
    """Model from the counts (at most ``BUCKETS`` rows a language)."""
    rows = counts.toPandas()
    langs = tuple(sorted(rows["lang"].unique()))
    table = np.zeros((BUCKETS, len(langs)))
    for k, lang in enumerate(langs):
        own = rows[rows["lang"] == lang]
        table[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    table += SMOOTHING
    return Model(langs, np.log(table / table.sum(axis=0)).astype(np.float32))


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``lang_pred``, ``score`` (proportion of
    that language) and ``mixture`` (language to proportion, those chosen)."""
    own = ["lang_pred", "score", "mixture"]
    keep = [c for c in docs.columns if c != text_col and c not in own]
    mixture = T.MapType(T.StringType(), T.DoubleType())
    schema = T.StructType([docs.schema[c] for c in keep]).add("lang_pred", T.StringType()).add(
        "score", T.DoubleType()).add("mixture", mixture)
    source = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("_text_"))

    def one(text: str | None, like: np.ndarray):
        if not len(like) or not model.langs or text is None or not has_letter(text):
            return UNKNOWN, 0.0, []
        best, share = model.infer(like)
        return model.langs[best], float(min(1.0, share[best])), [
            (model.langs[k], float(v)) for k, v in enumerate(share) if v > 0]

    def run(batches):
        for batch in batches:
            texts = batch.column(len(keep))
            for row, raw, offsets in utf8_parts(texts):
                bucket, start, size = _grams(raw)
                if len(start) and model.langs:
                    logp = model.logp[bucket].astype(np.float64)
                    logp[np.flatnonzero(_FOLD[raw] == 32)] = 0
                    like = np.add.reduceat(logp, start, axis=0)
                else:
                    like = np.zeros((len(start), 0))
                at = np.searchsorted(start, offsets).tolist()
                out = [one(texts[row + i].as_py(), like[a:b]) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(row, len(out)) for i in range(len(keep))),
                     pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()),
                     pa.array([o[2] for o in out], pa.map_(pa.string(), pa.float64()))], names=[*keep, *own])

    return source.mapInArrow(run, schema)
