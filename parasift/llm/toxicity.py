"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary text:
each holds the segments (beginnings of words and whole words) that its text has
significantly more often than the other, counted once per document and once
per group of near copies (Poisson test, Bonferroni-corrected).  A text's words
are written as hash codes of their beginnings of 4, 6, 8 and 10 bytes and of the whole
word, so that a match in a dictionary is always such a beginning and never a
piece of another word.  A window is ``WINDOW_WORDS`` words of the text one after the
other, each distinct one written once; equal windows are compressed once.  A window's margin is its compressed length under the ordinary
dictionary less that under the toxic one; a document's margin is the largest of
its windows, over the whole text.  The threshold is the margin of best F1 on
labelled rows that training did not see.

The fit uses a bounded sample of labelled rows: of each label the ``SAMPLE``
rows of least text hash, texts up to ``SAMPLE_BYTES``.  Scoring has no bound.

Edge cases: a null text counts as empty; a text without words has margin 0; a
label other than 0 and 1 or null teaches nothing; without toxic or without
ordinary rows to learn from every margin is 0; ids and extra columns pass
through; an empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty
from .hashing import _BYTE, _P, _P_INV, _powers, mix

SAMPLE = {1: 2000, 0: 4000}
SAMPLE_BYTES = 1 << 16
WINDOW_WORDS = 16
PLACES, CODE_BYTES, WORD_BYTES = (4, 6, 8, 10), 6, 6
#: Zeros before each window: it is then always stored compressed, so its length shows every match.
PADDING = bytes(48)
#: The last bytes of a dictionary are never the start of a match.
DICTIONARY_END = b"\xff" * 16
FOLD_RATIO, SIGNIFICANCE, LEAST_DOCS = 15.0, 0.01, 3
THRESHOLD, MARGINS = 0.7, range(2, 15)
_WORD_BYTES_ONLY = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_WORD_BYTES_ONLY).split()


def word_codes(words: list[bytes]) -> tuple[bytes, np.ndarray]:
    """Codes of ``words`` one after the other, and where each begins."""
    if not words:
        return b"", np.zeros(1, np.int64)
    raw = np.frombuffer(b" ".join(words), np.uint8)
    size = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(size + 1) - size - 1
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _powers(_P, len(raw)))])
    back, before = _powers(_P_INV, len(raw))[start], running[start]
    places = np.clip((size - 2) // 2, 0, len(PLACES))
    bounds = np.concatenate([[0], np.cumsum(2 + CODE_BYTES * places + WORD_BYTES)])
    out = np.zeros(bounds[-1], np.uint8)
    out[bounds[:-1]] = 1  # two bytes, 1 and 0, begin a word

    def put(at, code, n):
        for k in range(n):
            out[at + k] = (code >> np.uint64(8 * k)).astype(np.uint8)

    for j, p in enumerate(PLACES):
        has = np.flatnonzero(size >= p)
        code = mix((running[start[has] + p] - before[has]) * back[has] + np.uint64(p))
        put(bounds[has] + 2 + CODE_BYTES * j, code, CODE_BYTES)
    put(bounds[1:] - WORD_BYTES, mix((running[start + size] - before) * back + np.uint64(99)), WORD_BYTES)
    return out.tobytes(), bounds


def segment_codes(segments: list[bytes]) -> bytes:
    """Dictionary content; a segment that ends in a space is a whole word."""
    out = b""
    for s in segments:
        code, _ = word_codes([s.strip()])
        begin = code[:-WORD_BYTES]
        if s.endswith(b" "):
            out += code[-WORD_BYTES - CODE_BYTES:] if len(begin) > 2 else code
        else:
            out += begin if len(begin) == 2 + CODE_BYTES else begin[-2 * CODE_BYTES:]
    return out + DICTIONARY_END if out else out


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    threshold: int
    segments: tuple[bytes, ...] = ()

    def scorer(self):
        """A function from texts to largest margin and number of windows."""
        one, two = _compressor(self.ordinary), _compressor(self.toxic)

        def margin(text: str | None) -> tuple[int, int]:
            words = words_of(text)
            place = {w: k for k, w in enumerate(dict.fromkeys(words))}
            codes, at = word_codes(list(place))
            code = [codes[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            windows = [tuple(dict.fromkeys(place[w] for w in words[i : i + WINDOW_WORDS])) for i in range(0, len(words), WINDOW_WORDS)]
            most = 0
            for held in dict.fromkeys(windows):
                window = PADDING + b"".join(code[k] for k in held)
                most = max(most, len(one.compress(window)) - len(two.compress(window)))
            return most, len(windows)

        return margin

    def score(self, margin: int) -> float:
        """0 to 1, at least ``THRESHOLD`` from the calibrated margin on."""
        over = margin - self.threshold
        if over >= 0:
            return THRESHOLD + (1 - THRESHOLD) * over / (over + 6.0)
        return (THRESHOLD - 0.05) * math.exp(over / 2.0)


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    params = zstandard.ZstdCompressionParameters(
        strategy=zstandard.STRATEGY_GREEDY, min_match=6, hash_log=14, chain_log=14, search_log=5, window_log=14,
        target_length=0, write_content_size=False, write_checksum=False, write_dict_id=False)
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=params)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(compression_params=params, dict_data=held)


def _counts(rows: list[tuple[str, int]]) -> tuple[dict[int, Counter], dict[int, int]]:
    """Documents that have a segment, by label; of near copies one counts."""
    counts, docs, seen = {0: Counter(), 1: Counter()}, {0: 0, 1: 0}, set()
    for text, label in rows:
        words = words_of(text)
        if len(words) >= 8:
            grams = [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
            keys = [(salt, min(zlib.crc32(g, salt) for g in grams)) for salt in (1, 2)]
            if any(k in seen for k in keys):
                continue
            seen.update(keys)
        if not words:
            continue
        docs[label] += 1
        found = set()
        for w in set(words):
            found.add(w + b" ")
            found.update(w[:p] for p in PLACES if len(w) >= p)
        counts[label].update(found)
    return counts, docs


def _over_represented(counts, docs, label: int) -> list[bytes]:
    here, there = counts[label], counts[1 - label]
    if not docs[label] or not docs[1 - label]:
        return []
    share = docs[label] / docs[1 - label]
    limit = math.log(SIGNIFICANCE / max(1, len(here)))
    pick = set()
    for s, a in here.items():
        b = there[s]
        expected = (b + 1) * share
        if a >= LEAST_DOCS and a > expected and a >= FOLD_RATIO * (b + 0.5) * share:
            if a * math.log(expected) - expected - math.lgamma(a + 1) < limit:
                pick.add(s)
    # a beginning that (nearly) only this text has stands for its longer forms
    return sorted(s for s in pick if not any(s[:p] != s and s[:p] in pick and there[s[:p]] <= 2 for p in PLACES))


def train(rows: list[tuple[str, int]]) -> Model:
    """Model from (text, label) rows, three quarters of them (by text hash) for
    the dictionaries and the others for the threshold."""
    quarter = [zlib.crc32((t or "").encode("utf-8", "replace")) % 4 == 0 for t, _ in rows]
    counts, docs = _counts([r for r, q in zip(rows, quarter, strict=True) if not q])
    toxic, ordinary = (_over_represented(counts, docs, label) for label in (1, 0))
    model = Model(segment_codes(toxic), segment_codes(ordinary), MARGINS[1], tuple(toxic))
    held = [r for r, q in zip(rows, quarter, strict=True) if q]
    held = held if sum(y for _, y in held) >= 5 else rows
    margin = model.scorer()
    seen = [(margin(t)[0], y) for t, y in held]

    def f1(least: int) -> float:
        hits = sum(y for m, y in seen if m >= least)
        return 2 * hits / max(1, sum(m >= least for m, _ in seen) + sum(y for _, y in seen))

    best = max(MARGINS, key=lambda m: (f1(m), -m)) if any(y for _, y in seen) else MARGINS[1]
    return Model(model.toxic, model.ordinary, best, model.segments)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic") -> Model:
    """Model from labelled rows; the driver gets the bounded sample only."""
    rows = []
    text = text_or_empty(F.col(text_col))
    for label, n in SAMPLE.items():
        rows += [
            (r[0], label)
            for r in labelled.where((F.col(label_col) == label) & (F.octet_length(text) <= SAMPLE_BYTES))
            .select(text.alias("t")).orderBy(F.xxhash64("t"), "t").limit(n).collect()
        ]
    return train(rows)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``margin``, ``windows``, ``score`` and
    ``predicted`` (names already taken by a column of ``docs`` replace it)."""
    own = ["margin", "windows", "score", "predicted"]
    keep = [c for c in docs.columns if c != text_col and c not in own]
    schema = T.StructType([docs.schema[c] for c in keep]).add("margin", T.IntegerType()).add(
        "windows", T.IntegerType()).add("score", T.DoubleType()).add("predicted", T.IntegerType())
    source = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("_text_"))

    def run(batches):
        margin = model.scorer()
        for batch in batches:
            found = [margin(t.as_py()) for t in batch.column(len(keep))]
            scores = [model.score(m) for m, _ in found]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))),
                 pa.array([m for m, _ in found], pa.int32()), pa.array([n for _, n in found], pa.int32()),
                 pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                names=[*keep, *own])

    return source.mapInArrow(run, schema)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are whatever their names, that
    the model does not reject.  Only the text passes to the Python workers, once."""

    @F.pandas_udf("int")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        margin = model.scorer()
        for texts in batches:
            yield pd.Series([int(model.score(margin(t)[0]) >= THRESHOLD) for t in texts], dtype="int32")

    return docs.where(predicted(docs[text_col].cast("string")) == 0)
