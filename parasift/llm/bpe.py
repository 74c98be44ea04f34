"""Byte-level BPE encoding and decoding.

Texts are split into words by the tokenizer's pattern and distinct words are
encoded: merges are folded over many words at once, each word's adjacent pair of
lowest rank first.  A piece is carried as its rank, so a merge looks up a pair of ranks
and puts the rank it finds in their place.  The rank map of pairs is an array with a
place for every pair of its own (a hash table whose displacements were chosen free of
collisions).  Words of more than ``LONG_BYTES`` bytes are folded one by one with a heap of
pairs, so no word takes time by the square of its length.  ``decode`` puts the binary
pieces of the ranks together again.

Words are counted over all documents.  Those that occur most (``TABLE_WORDS`` at
most, of at most ``TABLE_WORD_BYTES`` bytes: a proven bound) are folded once and
their ids sent to all tasks.  Every other word is folded where it occurs, once for
each batch of texts that has it.  So the only shuffle is that of the word counts;
neither texts nor word occurrences move.  Word lists pass to the Python workers in
small batches, as a list takes several times the memory of its text; the ids are
written before anything reads them.

The result equals the tokenizer library's ordinary encoding (no special tokens)
for the same ranks and pattern.  Edge cases: null text counts as empty and has
no tokens; repeated rows and null ids are encoded one by one; columns other than
the text pass through (``keep``); an empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_count, materialise, small_batches, text_or_empty

TABLE_WORDS, TABLE_WORD_BYTES, LONG_BYTES = 1 << 19, 32, 128
ABSENT = (1 << 16) - 1
FOLD_BYTES = 1 << 18  # of words folded at once


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken-format vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Pairs of ranks and the rank of the piece they make, as two arrays.

    ``(a, b)`` has the key ``a * 2^16 + b``; the displacement of its group,
    found by one product, gives its own place in ``slots`` by another.  A slot
    holds ``key * 2^16 + rank``, or -1.
    """

    FIRST, SECOND = 715827883, 805306457  # odd factors below 2^30: products of 32-bit keys fit 64 bits

    def __init__(self, pairs: dict[int, int]):
        keys = np.fromiter(pairs, np.int64, len(pairs))
        ranks = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.groups, self.size = max(1, len(keys) // 3) | 1, max(1, len(keys) * 3 // 2) | 1
        group, base = keys * self.FIRST % self.groups, keys * self.SECOND % self.size
        shift, slots = np.zeros(self.groups, np.int64), np.full(self.size, -1, np.int64)
        order = np.argsort(group, kind="stable")
        count = np.bincount(group, minlength=self.groups)
        start = np.concatenate([[0], np.cumsum(count)])
        for g in np.argsort(-count, kind="stable")[: np.count_nonzero(count)].tolist():
            mine = order[start[g] : start[g + 1]]
            at = (base[mine]).tolist()
            for d in range(self.size):
                places = {(p + d) % self.size for p in at}
                if len(places) == len(at) and all(slots[p] < 0 for p in places):
                    break
            else:
                raise ValueError("two pairs of one group share every place")
            shift[g] = d
            slots[(base[mine] + d) % self.size] = keys[mine] << 16 | ranks[mine]
        self.shift, self.slots = shift, slots

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pieces that the pieces of ranks ``a`` and ``b`` make."""
        key = a << 16 | b
        slot = self.slots[(key * self.SECOND + self.shift[key * self.FIRST % self.groups]) % self.size]
        return np.where(slot >> 16 == key, slot & ABSENT, ABSENT)

    def rank(self, a: int, b: int) -> int:
        key = a << 16 | b
        slot = int(self.slots[(key * self.SECOND + int(self.shift[key * self.FIRST % self.groups])) % self.size])
        return slot & ABSENT if slot >> 16 == key else ABSENT


def rank_pairs(ranks: dict[bytes, int]) -> dict[int, int]:
    """All pairs of pieces whose bytes together are a piece: key and rank."""
    return {ranks[p[:i]] << 16 | ranks[p[i:]]: rank for p, rank in ranks.items() for i in range(1, len(p))
            if p[:i] in ranks and p[i:] in ranks}


class Merges:
    """Folds words to ids: a word of the vocabulary at once, any other by
    merging the adjacent pair of lowest rank, leftmost first, until no pair is
    in the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.pieces, self.piece_ranks = pa.array(list(ranks), pa.binary()), np.array(list(ranks.values()), np.int64)
        self.byte_ranks = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = PairTable(rank_pairs(ranks))

    def fold(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``words`` (strings), and where those of each begin."""
        words = words.cast(pa.large_string()).cast(pa.large_binary())
        at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        whole = pc.fill_null(pc.index_in(words, value_set=self.pieces.cast(pa.large_binary())), -1).to_numpy(zero_copy_only=False)
        size = np.diff(at)
        known = np.flatnonzero(whole >= 0)
        found = [(known, self.piece_ranks[whole[known]])]
        for w in np.flatnonzero((whole < 0) & (size > LONG_BYTES)).tolist():
            ids = self._long(self.byte_ranks[raw[at[w] : at[w + 1]]])
            found.append((np.full(len(ids), w), np.array(ids, np.int64)))
        short = np.flatnonzero((whole < 0) & (size <= LONG_BYTES) & (size > 0))
        upto = np.concatenate([[0], np.cumsum(size[short])])
        for a, b in _slices(upto, FOLD_BYTES):
            mine, many = np.repeat(short[a:b], size[short[a:b]]), upto[b] - upto[a]
            places = np.repeat(at[short[a:b]] - (upto[a:b] - upto[a]), size[short[a:b]]) + np.arange(many)
            found += self._many(self.byte_ranks[raw[places]], mine)
        word, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        return np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))]), ids[np.argsort(word, kind="stable")].astype(np.int32)

    def _many(self, ids: np.ndarray, word: np.ndarray):
        """Word numbers and ids of words whose pieces ``ids`` stand one after
        the other, as words come to their end; a step merges one pair of each."""
        pair, done = np.full(len(ids), ABSENT, np.int64), []

        def renew(at):
            after = np.minimum(at + 1, len(ids) - 1)
            pair[at] = np.where((word[after] == word[at]) & (after > at), self.pairs.ranks(ids[at], ids[after]), ABSENT)

        renew(np.arange(len(ids)))
        while len(ids):
            start = np.flatnonzero(np.diff(word, prepend=-1))
            least = np.minimum.reduceat(pair << 32 | np.arange(len(ids)), start)
            over = least >> 32 == ABSENT
            ended = np.repeat(over, np.diff(start, append=len(ids)))
            done.append((word[ended], ids[ended]))
            at, rank = least[~over] & 0xFFFFFFFF, least[~over] >> 32
            ids[at] = rank
            keep = ~ended
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            ids, word, pair = ids[keep], word[keep], pair[keep]
            renew(at)
            renew(at[at > 0] - 1)
        return done

    def _long(self, ids: np.ndarray) -> list[int]:
        """Ids of one word of pieces ``ids``: its pieces are a linked list."""
        first, ids, n = self.pairs.ranks(ids[:-1], ids[1:]).tolist(), ids.tolist(), len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != ABSENT]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j == n or ids[j] != b:
                continue  # merged meanwhile
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (new := self.pairs.rank(ids[k], ids[after[k]])) != ABSENT:
                    heapq.heappush(heap, (new, k, ids[k], ids[after[k]]))
        return [x for x in ids if x >= 0]


class Codec:
    """One vocabulary of at most 2^16 pieces that holds every single byte (its
    size bounds the literal of ``decode``)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        if max(ranks.values()) >= ABSENT or any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("ranks must be below 65,535 and include every byte")
        self.pattern = "(?U)" + pattern
        pieces = [""] * (max(ranks.values()) + 1)
        for piece, rank in ranks.items():
            pieces[rank] = piece.decode("latin-1")
        self._pieces = json.dumps(pieces)
        self.merges = Merges(ranks)

    def words(self, text: Column) -> Column:
        return F.regexp_extract_all(text, F.lit(self.pattern), F.lit(0))

    def decode(self, ids: Column) -> Column:
        """Bytes of the pieces of ``ids``, one after the other."""
        literal = F.from_json(F.lit(self._pieces), "array<string>")
        return F.encode(F.array_join(F.transform(ids, lambda i: F.get(literal, i)), ""), "ISO-8859-1")


def vocabulary(words: DataFrame, codec: Codec) -> DataFrame:
    """``word, ids`` of the distinct words in column ``word``."""
    merges = codec.merges

    def run(batches):
        for batch in batches:
            at, ids = merges.fold(batch.column("word"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("word"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word string, ids array<int>")


def _count_batches(batches):
    """Words and their counts, one batch of texts at a time."""
    for batch in batches:
        bounds, flat = _lists(batch.column("words"))
        for a, b in _slices(bounds, 1 << 22):
            found = pc.value_counts(flat.slice(bounds[a], bounds[b] - bounds[a]))
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "n"])
            del found
        del batch, flat
        pa.default_memory_pool().release_unused()  # a reused worker would hold it


def count_words(words: DataFrame) -> DataFrame:
    """``word, n`` of a list column ``words``, combined in the task first."""
    return words.select("words").mapInArrow(_count_batches, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def common_words(counts: DataFrame, most: int = TABLE_WORDS) -> DataFrame:
    """Words of ``counts`` (word, n) with a count so high that no more than
    ``most`` words reach it."""
    short = counts.where(F.octet_length("word") <= TABLE_WORD_BYTES)
    least = least_count(short, most)
    return short.where(F.col("n") >= least).select("word") if least is not None else short.where("false").select("word")


def encode(docs: DataFrame, codec: Codec, text_col: str = "text", keep: list[str] | None = None,
           table_words: int = TABLE_WORDS) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (all but the text by
    default) and ``ids`` (array of int)."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    kept = [docs[c].alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, codec.words(text_or_empty(docs[text_col])).alias("words"))
    with small_batches(docs.sparkSession):
        counts = materialise(count_words(rows), "bpe-words")
    table = materialise(vocabulary(common_words(counts, table_words), codec), "bpe-table").toArrow()
    send = docs.sparkSession.sparkContext.broadcast
    known = send(_packed(table.column("word").combine_chunks().cast(pa.string())))
    ids = send(_packed(table.column("ids").combine_chunks().cast(pa.list_(pa.int32()))))
    del table
    names = [f"k{i}" for i in range(len(keep))]
    same = [rows.schema[n] for n in names]
    out = rows.mapInArrow(
        _encoder(known, ids, codec.merges, len(keep)), T.StructType(list(same)).add("ids", T.ArrayType(T.IntegerType())))
    with small_batches(docs.sparkSession):
        out = materialise(out, "bpe-ids")
    for sent in (known, ids):
        sent.destroy()
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], "ids")


def _packed(column: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("c", column.type)])) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([column], names=["c"]))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pa.Array:
    return pa.ipc.open_stream(data).read_all().column("c").combine_chunks()


def _lists(column: pa.ListArray) -> tuple[np.ndarray, pa.Array]:
    """Offsets from 0 and values of a list column that may be a slice."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    return offsets - offsets[0], column.flatten()


def _slices(bounds: np.ndarray, limit: int = 1 << 18):
    """Runs of rows with about ``limit`` list elements, one row at least."""
    row, n = 0, len(bounds) - 1
    while row < n:
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1)
        yield row, stop
        row = stop


def _encoder(known, ids, merges: Merges, n: int):
    """Words to ids: those of the table as they are, others folded once a batch."""

    def run(batches):
        table = _unpacked(known.value)
        table_at, table_ids = _lists(_unpacked(ids.value))
        table_ids = table_ids.to_numpy(zero_copy_only=False)
        for batch in batches:
            bounds, flat = _lists(batch.column("words"))
            coded = flat.dictionary_encode()
            distinct, index = coded.dictionary, np.asarray(coded.indices)
            own_columns = [pc.take(batch.column(i), pa.array(np.arange(batch.num_rows))) for i in range(n)]  # copies
            del batch, flat, coded  # the words themselves are not needed any more
            place = pc.fill_null(pc.index_in(distinct, value_set=table), -1).to_numpy(zero_copy_only=False)
            common, rare = np.flatnonzero(place >= 0), np.flatnonzero(place < 0)
            rare_at, rare_ids = merges.fold(distinct.take(pa.array(rare)))
            begin, size = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
            begin[common], size[common] = table_at[place[common]], np.diff(table_at)[place[common]]
            begin[rare], size[rare] = rare_at[:-1] + len(table_ids), np.diff(rare_at)
            every = np.concatenate([table_ids, rare_ids])
            del distinct, place
            pa.default_memory_pool().release_unused()
            for a, b in _slices(bounds):
                own = index[bounds[a] : bounds[b]]
                sizes = size[own]
                upto = np.concatenate([[0], np.cumsum(sizes)])
                take = np.repeat(begin[own] - upto[:-1], sizes) + np.arange(upto[-1])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(a, b - a) for c in own_columns),
                     pa.ListArray.from_arrays(pa.array(upto[bounds[a : b + 1] - bounds[a]], pa.int32()), pa.array(every[take]))],
                    names=[*(f"k{i}" for i in range(n)), "ids"])
            del index, begin, size, every, own_columns
            pa.default_memory_pool().release_unused()  # a reused worker would hold it

    return run
