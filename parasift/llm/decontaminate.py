"""Benchmark decontamination: edit-similar copies of benchmark items in texts.

A leak is a stretch of words in a document within ``floor((100 - percent) / 100
* n)`` word edits of an item of n words (words: runs of letters, digits and bytes
from 0x80, A-Z in lower case).

Item-sized windows of a document are embedded by CGK random walks: step j of a
walk writes the symbol under the pointer and moves on if a hash bit of (j, symbol)
says so; strings of small edit distance walk together again, so most of
their 3 n written symbols agree.  Bit sampling turns each walk into
``TABLES`` keys of ``SAMPLES`` positions; a window and an item with a key in
common are a candidate pair (``WALKS`` x ``TABLES`` chances), and candidates are
verified by their exact edit distance (the best substring around the window).
The longer a string, the further the walks drift apart at the same share of edits (one
sided ones most), so an item of over ``PART_WORDS`` words is cut into equal parts of
at most that many.  If the item is within its distance, some part is within the
same share of its own words; windows are part-sized, and a window that has a key in
common with a part makes the whole item a candidate there.

Which windows are embedded: every window that can be within the distance.  By
the q-gram lemma it shares at least ``n + 1 - q - q * edits`` of the item's q-grams
within its length, at places that fix where it starts; all others are out
of reach and are skipped without loss.

Items travel with the tasks in blocks of ``ITEM_BLOCK`` words (one pass each), so
a benchmark of any size has a bounded block in memory; documents are never
shuffled for the search.

Edge cases: null or blank documents and items have no words and no leaks; an
item shorter than 5 words must occur exactly; equal items are reported each by its
id; a null id is reported as null; extra columns pass through ``keep_clean``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, row_key, without_rows
from .hashing import Words, combine, mix, utf8_parts

PERCENT, WALKS, TABLES, SAMPLES = 80, 8, 15, 3
PART_WORDS = 40
ITEM_BLOCK = 1 << 20
_FOLD = np.array([c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256)], np.uint8)
_PAD = np.uint64(0)


def word_hashes(text: str | None) -> np.ndarray:
    return Words(_FOLD[np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)]).hash


def embed(strings: np.ndarray, walk: int, steps: int) -> np.ndarray:
    """The first ``steps`` symbols of the CGK embedding (3 n in full) of equally
    long strings (rows of symbols); 0 once a string is used up."""
    rows, n = strings.shape
    padded = np.concatenate([strings, np.zeros((rows, 1), np.uint64)], axis=1)
    salts = mix(np.arange(steps, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((walk + 1) << 32))
    at, every = np.zeros(rows, np.int64), np.arange(rows)
    out = np.empty((rows, steps), np.uint64)
    for step in range(steps):
        out[:, step] = padded[every, at]
        at = np.minimum(at + (mix(out[:, step] ^ salts[step]) & np.uint64(1)).astype(np.int64), n)
    return out


def keys(strings: np.ndarray) -> np.ndarray:
    """Bit-sampling keys, rows x (WALKS x TABLES); 0, which is no key, where a
    sample fell behind the end of a string.  A walk uses a string up in about
    2 n steps; what is written after that agrees for all strings, so samples
    are drawn from the first 1.7 n."""
    rows, n = strings.shape
    steps = max(1, n * 17 // 10)
    out = np.empty((rows, WALKS * TABLES), np.uint64)
    for walk in range(WALKS):
        written = embed(strings, walk, steps)
        draw = np.random.default_rng([n, walk])
        for t in range(TABLES):
            key = np.full(rows, n * 4096 + walk * TABLES + t, np.uint64)
            whole = np.ones(rows, bool)
            for place in draw.choice(steps, min(SAMPLES, steps), replace=False):
                key = mix(key ^ written[:, place]) + np.uint64(place)
                whole &= written[:, place] != 0
            out[:, walk * TABLES + t] = np.where(whole, key, np.uint64(0))
    return out


def distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Least edit distance of ``item`` to a substring of ``region``, and where
    that substring ends and (nearly) starts."""
    row = np.zeros(len(region) + 1, np.int64)
    begin = np.arange(len(region) + 1)
    places = np.arange(len(region) + 1)
    for i, symbol in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (region != symbol))
        from_left = row[:-1] + (region != symbol) <= row[1:] + 1
        starts = np.where(from_left, begin[:-1], begin[1:])
        new, starts = np.concatenate([[i], new]), np.concatenate([[0], starts])
        # deletions from the region run to the right: a running minimum of cost less place
        best = np.minimum.accumulate(new - places)
        source = np.maximum.accumulate(np.where(new - places == best, places, 0))
        row, begin = best + places, starts[source]
    end = int(np.argmin(row))
    return int(row[end]), int(begin[end]), end


class Items:
    """Search structures of a block of items."""

    def __init__(self, ids: list, texts: list[str | None], percent: int):
        self.ids = ids
        self.words = [word_hashes(t) for t in texts]
        size = np.array([len(w) for w in self.words], np.int64)
        self.size, self.edits = size, size * (100 - percent) // 100
        # q-grams: the longest q (to 3) for which the lemma demands at least one
        self.q = np.array([max((q for q in (1, 2, 3) if n + 1 - q - q * e >= 1), default=1) for n, e in zip(size, self.edits, strict=True)], np.int64)
        self.demand = np.maximum(1, size + 1 - self.q - self.q * self.edits)
        self.grams = {}
        for q in (1, 2, 3):
            own = [i for i in range(len(ids)) if self.q[i] == q and size[i] >= q]
            if own:
                gram = np.concatenate([combine(self.words[i], q) for i in own])
                item = np.repeat(own, [size[i] - q + 1 for i in own])
                place = np.concatenate([np.arange(size[i] - q + 1) for i in own])
                order = np.argsort(gram, kind="stable")
                gram = gram[order]
                head = np.flatnonzero(np.diff(gram, prepend=gram[0] + np.uint64(1)))
                maybe = np.zeros(1 << 20, bool)
                maybe[gram >> np.uint64(44)] = True
                self.grams[q] = (gram[head], np.append(head, len(gram)), item[order], place[order], maybe)
        # parts of items: of which item, first word, words
        cuts = [np.linspace(0, n, -(-n // PART_WORDS) + 1).astype(np.int64) for n in size.tolist()]
        self.first_part = np.concatenate([[0], np.cumsum([len(c) - 1 for c in cuts])]).astype(np.int64)
        self.part_item = np.repeat(np.arange(len(ids)), np.diff(self.first_part))
        self.part_at = np.concatenate([np.zeros(0, np.int64), *(c[:-1] for c in cuts)])
        self.part_size = np.concatenate([np.zeros(0, np.int64), *(np.diff(c) for c in cuts)])
        self.keys = {}
        for n in np.unique(self.part_size).tolist():
            own = np.flatnonzero(self.part_size == n)
            k = keys(np.stack([self.words[self.part_item[i]][self.part_at[i] : self.part_at[i] + n] for i in own]))
            flat, who = k.ravel(), np.repeat(own, k.shape[1])
            flat, who = flat[flat != 0], who[flat != 0]
            order = np.argsort(flat, kind="stable")
            self.keys[n] = (flat[order], who[order])

    def hits(self, words: np.ndarray, text_of: np.ndarray):
        """Shared q-grams that enough others accompany: text, part of an item,
        start of the window they suggest for it."""
        found = []
        for q, (gram, head, item, place, maybe) in self.grams.items():
            own = combine(words, q)
            at = np.flatnonzero(maybe[own >> np.uint64(44)])
            slot = np.minimum(np.searchsorted(gram, own[at]), len(gram) - 1)
            same = (gram[slot] == own[at]) & (text_of[at] == text_of[at + q - 1])
            at, slot = at[same], slot[same]
            times = head[slot + 1] - head[slot]
            ends = np.cumsum(times)
            entry = np.repeat(head[slot] - (ends - times), times) + np.arange(ends[-1] if len(ends) else 0)
            found.append((np.repeat(at, times), item[entry], place[entry]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, item, place = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((at, item, text_of[at]))
        at, item, place = at[order], item[order], place[order]
        group = text_of[at] * len(self.ids) + item
        last = np.minimum(np.arange(len(at)) + self.demand[item] - 1, len(at) - 1)
        reach = self.size[item] + self.edits[item]
        full = (np.arange(len(at)) + self.demand[item] - 1 < len(at)) & (group[last] == group) & (at[last] - at <= reach)
        # every hit between the first and the last of a full run belongs to it
        marks = np.zeros(len(at) + 1, np.int64)
        np.add.at(marks, np.flatnonzero(full), 1)
        np.add.at(marks, last[full] + 1, -1)
        keep = np.cumsum(marks)[:-1] > 0
        at, item, place = at[keep], item[keep], place[keep]
        # parts are in the order of items and their words, so is item * wide + first word
        wide = int(self.size.max()) + 1
        part = np.searchsorted(self.part_item * wide + self.part_at, item * wide + place, "right") - 1
        return text_of[at], part, at - place + self.part_at[part]

    def search(self, words: np.ndarray, text_of: np.ndarray, bounds: np.ndarray):
        """Leaks in the texts of a part: ``text, item, distance, start, end``."""
        text, part, start = self.hits(words, text_of)
        if not len(text):
            return
        start = np.clip(start, bounds[text], bounds[text + 1] - 1)
        pairs = set()
        sized = np.unique(np.stack([self.part_size[part], text, start]), axis=1)
        for n in np.unique(sized[0]).tolist():
            _, t, s = sized[:, sized[0] == n]
            for lo in range(0, len(t), 4096):
                tt, ss = t[lo : lo + 4096], s[lo : lo + 4096]
                place = ss[:, None] + np.arange(n)
                window = np.where(place < bounds[tt + 1][:, None], words[np.minimum(place, len(words) - 1)], _PAD)
                key, who = self.keys[n]
                mine = keys(window)
                left = np.searchsorted(key, mine.ravel(), "left")
                right = np.searchsorted(key, mine.ravel(), "right")
                times = right - left
                row = np.repeat(np.arange(len(tt)).repeat(mine.shape[1]), times)
                ends = np.cumsum(times)
                entry = np.repeat(left - (ends - times), times) + np.arange(ends[-1])
                begin = np.maximum(ss[row] - self.part_at[who[entry]], bounds[tt[row]])
                pairs.update(zip(tt[row].tolist(), self.part_item[who[entry]].tolist(), begin.tolist(), strict=True))
        done: dict[tuple[int, int], tuple[int, int, int]] = {}
        tried: dict[tuple[int, int], int] = {}
        for t, i, s in sorted(pairs):
            n, e = int(self.size[i]), int(self.edits[i])
            best = done.get((t, i))
            if best and best[0] == 0 or s - tried.get((t, i), -n) <= e:
                continue  # what can start here was covered by the region tried before
            tried[t, i] = s
            lo, hi = max(int(bounds[t]), s - 2 * e), min(int(bounds[t + 1]), s + n + 2 * e)
            d, a, b = distance(self.words[i], words[lo:hi])
            if d <= e and (not best or d < best[0]):
                done[t, i] = (d, lo + a, lo + b)
        for (t, i), (d, a, b) in done.items():
            yield t, i, d, a - int(bounds[t]), b - int(bounds[t])


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          item_id_col: str = "item_id", item_text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document and item that leaks into it: the document id, the
    item id, ``n_words`` of the item, ``distance`` and the words
    ``first_word`` to ``end_word`` (exclusive) of its best place."""
    doc_type = docs.schema[id_col].dataType.simpleString()
    item_type = items.schema[item_id_col].dataType.simpleString()
    schema = f"doc {doc_type}, item {item_type}, n_words int, distance int, first_word int, end_word int"
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    out = None
    for ids, texts in _blocks(items, item_id_col, item_text_col):
        def run(batches, ids=ids, texts=texts):
            block = Items(ids, texts, percent)
            for batch in batches:
                doc = batch.column("doc")
                for row, raw, offsets in utf8_parts(batch.column("text")):
                    words = Words(_FOLD[raw])
                    bounds = np.searchsorted(words.start, offsets)
                    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
                    found = list(block.search(words.hash, text_of, bounds))
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [doc.take(pa.array([row + f[0] for f in found])),
                             pa.array([ids[f[1]] for f in found], pa.from_numpy_dtype(np.int64) if item_type in ("bigint", "long") else None),
                             *(pa.array(x, pa.int32()) for x in (
                                 [int(block.size[f[1]]) for f in found], [f[2] for f in found],
                                 [f[3] for f in found], [f[4] for f in found]))],
                            names=["doc", "item", "n_words", "distance", "first_word", "end_word"])

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_id_col), "n_words", "distance", "first_word", "end_word")


def _blocks(items: DataFrame, id_col: str, text_col: str):
    """Items in blocks of bounded size, one block at a time on the driver."""
    sized = items.where(F.trim(F.col(text_col).cast("string")) != "").select(
        F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ids, texts, words = [], [], 0
    for r in sized.toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        words += r[1].count(" ") + 1
        if words >= ITEM_BLOCK:
            yield ids, texts
            ids, texts, words = [], [], 0
    if ids:
        yield ids, texts


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that no item leaks into, all columns.  Rows are
    marked by row hashes, so null and repeated ids work too."""
    key = F.struct(*row_key(docs))
    marked = docs.select(F.concat_ws(" ", key["_key"], key["_key2"]).alias("_row"), docs[text_col].alias("_t"))
    found = leaks(marked, items, "_row", "_t", percent=percent).select("_row").distinct()
    parts = F.split("_row", " ")
    bad = materialise(found.select(parts[0].cast("long").alias("_key"), parts[1].cast("int").alias("_key2")), "leaking")
    return without_rows(docs, bad, False)
