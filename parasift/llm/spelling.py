"""Spelling variants: words that one inserted, deleted or replaced letter apart.

A word is a vector of letter counts.  One edit moves that vector by a squared
distance of 1 (insertion, deletion; lengths differ by one) or 2 (replacement;
equal lengths), so a NumPy product of two blocks of count vectors (a Gram
matrix) gives all squared distances, pairs of at most two stay, and their
edits are verified on the letters.

A block holds the words of one length and of equal counts in each of a few
groups of letters.  An edit takes a word to its own block, to one where a
group has a letter more, or to one where a letter moved between groups, so
words of other blocks are never compared.  The number of groups follows the
vocabulary (``PAIRS_PER_WORD``), and a block of any size is cut into tiles of
bounded rows, so no task holds an unbounded block.

Only counts per word leave the text pass (combined in the task first); only
words and counts of their near words are shuffled after it, never pairs.

Edge cases: a null or empty text has no words; a null id counts as empty text;
an empty table gives an empty result; rows that repeat count again; of near
words with equal counts the smaller in code-point order is the form; words of
any length are compared (beyond 2,000 letters in double precision, where
products of counts stay exact).  Other columns of the input are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, sized_side

MIN_LETTERS, MIN_COUNT, FORM_TIMES, SLIP_ONE_IN = 7, 2, 10, 31
#: Words that a word's block may hold on average (weighted by words); more: one letter group more.
PAIRS_PER_WORD = 2_000
GROUPS = range(3, 11)
#: Rows of a tile: words compared, and words they are compared with.
LEFT_ROWS, RIGHT_ROWS = 1 << 12, 1 << 16
#: Cells of one Gram product, letters of one verification, distinct words of one count table.
CELLS, LETTERS, TABLE = 1 << 22, 1 << 23, 1 << 17
#: Counts up to this length are exact in single precision (4 * 2000^2 < 2^24).
SINGLE = 2_000

_LOWER = {c: c + 32 for c in range(65, 91)}
_RUNS = re.compile(r"[a-zÀ-ÿ]{%d,}" % MIN_LETTERS)  # maximal: a shorter run has no such part


def slip(seed: int, run: str) -> str:
    """The run, one letter short if the checksum of id and run says so
    (``seed``: the checksum of the id and a colon)."""
    h = zlib.crc32(run.encode(), seed)
    if h % SLIP_ONE_IN:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1 :]


def _count_batches(batches):
    def table(counts):
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                          names=["word", "n"])

    counts = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seed = zlib.crc32(f"{doc_id or ''}:".encode())
            for run, n in Counter(_RUNS.findall((text.as_py() or "").translate(_LOWER))).items():
                word = slip(seed, run)
                if len(word) >= MIN_LETTERS:
                    counts[word] += n
            if len(counts) >= TABLE:
                yield table(counts)
                counts = Counter()
    yield table(counts)


def vocabulary(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``word, n``: distinct words of at least seven letters and two occurrences."""
    rows = docs.select(docs[id_col].cast("string").alias("_id"), docs[text_col].cast("string").alias("_text"))
    return (rows.mapInArrow(_count_batches, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT))


# ------------------------------------------------------------------ blocks
def letter_use(words: DataFrame) -> list[tuple[str, int]]:
    """Letters (at most 90) and how often the words use them, most used first."""
    rows = words.select(F.explode(F.split("word", "")).alias("c")).where("c <> ''").groupBy("c").count().collect()
    return sorted(((r["c"], r["count"]) for r in rows), key=lambda u: (-u[1], u[0]))


def letter_groups(used: list[tuple[str, int]], groups: int) -> list[str]:
    """Letters dealt into groups of about equal use."""
    out, load = [""] * groups, [0] * groups
    for letter, n in used:
        g = load.index(min(load))
        out[g] += letter
        load[g] += n
    return out


def _key(counts: list[Column]) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in counts])


def _counts(word: Column, groups: list[str]) -> list[Column]:
    return [F.length(word) - F.length(F.translate(word, g, "")) if g else F.lit(0) for g in groups]


def choose_groups(words: DataFrame) -> list[str]:
    """The least number of letter groups that keeps blocks within
    ``PAIRS_PER_WORD`` words on average (the most there are, if none does)."""
    total, used = words.count(), letter_use(words)
    for g in GROUPS:
        groups = letter_groups(used, g)
        sizes = words.groupBy(_key(_counts(F.col("word"), groups)).alias("k")).count()
        pairs = sizes.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
        if pairs <= PAIRS_PER_WORD * total:
            break
    return groups


def _arrivals(words: DataFrame, groups: list[str]) -> DataFrame:
    """``key, own, word, n``: each word in its own block, in the blocks with a
    letter less and in those with a letter moved to an earlier group.  Of two
    neighbouring blocks exactly one sees the other's words."""
    counts = [F.col(f"c{i}") for i in range(len(groups))]  # each counted once, in a projection of its own
    counted = words.select("word", "n", *[c.alias(f"c{i}") for i, c in enumerate(_counts(F.col("word"), groups))])

    def moved(less, more=None):
        return _key([c - 1 if i == less else c + 1 if i == more else c for i, c in enumerate(counts)])

    def visit(less, more=None):
        return F.when(counts[less] > 0, F.struct(moved(less, more).alias("key"), F.lit(False).alias("own")))

    places = [F.struct(_key(counts).alias("key"), F.lit(True).alias("own"))]
    places += [visit(i) for i in range(len(groups))]
    places += [visit(j, i) for i, j in combinations(range(len(groups)), 2)]
    return (counted.select("word", "n", F.explode(F.array_compact(F.array(*places))).alias("p"))
            .select("p.key", "p.own", "word", "n"))


def tiles(words: DataFrame, groups: list[str]) -> DataFrame:
    """``key, i, j, side, own, word, n``: tile (i, j) of a block compares part
    i of the block's words (side 0) with part j of all that arrive (side 1)."""
    arrive = materialise(_arrivals(words, groups), "spelling-arrivals")
    sizes = arrive.groupBy("key").agg(
        F.ceil(F.count_if("own") / LEFT_ROWS).cast("int").alias("parts"),
        F.ceil(F.count(F.lit(1)) / RIGHT_ROWS).cast("int").alias("sides")).where("parts > 0")
    sizes = sizes.withColumnRenamed("key", "_key")
    sized = arrive.join(sized_side(sizes, F.length("_key") + 16), F.col("key") == F.col("_key"))
    part, side = F.pmod(F.xxhash64("word"), F.col("parts")), F.pmod(F.hash("word"), F.col("sides"))
    until = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = sized.where("own").select(
        "key", part.cast("int").alias("i"), F.explode(until("sides")).alias("j"), F.lit(0).alias("side"), "own", "word", "n")
    right = sized.select(
        "key", F.explode(until("parts")).alias("i"), side.cast("int").alias("j"), F.lit(1).alias("side"), "own", "word", "n")
    return left.unionByName(right)


# ------------------------------------------------------------------ one tile
def letters_matrix(words: list[bytes]) -> np.ndarray:
    """Letters of words of one length, a row each."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def gram_pairs(left: np.ndarray, right: np.ndarray, at_most: int = 2):
    """Pairs of rows of two letter matrices whose letter counts are at squared
    distance ``at_most`` or less, from blocked products of the counts."""
    used, dtype = np.unique(np.concatenate([np.unique(left), np.unique(right)])), np.float32
    if max(left.shape[1], right.shape[1]) > SINGLE:
        dtype = np.float64
    place = np.zeros(256, np.int64)
    place[used] = np.arange(len(used))

    def counts(rows):
        cells = place[rows] + (np.arange(len(rows)) * len(used))[:, None]
        return np.bincount(cells.ravel(), minlength=len(rows) * len(used)).reshape(len(rows), len(used)).astype(dtype)

    def wide(rows, times, square, one):
        """Counts with their squared norm, so that one product gives |a|^2 - 2ab + |b|^2."""
        out = np.empty((len(rows), len(used) + 2), dtype)
        c = counts(rows)
        out[:, :-2], out[:, square], out[:, one] = times * c, np.einsum("ij,ij->i", c, c), 1
        return out

    b = wide(right, 1, -1, -2).T
    step = max(1, CELLS // max(len(right), 1))
    for lo in range(0, len(left), step):
        cells = np.flatnonzero(wide(left[lo : lo + step], -2, -2, -1) @ b <= at_most)
        i, j = np.divmod(cells, len(right))
        yield i + lo, j


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of equal length that differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def one_inserted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows where ``b`` is ``a`` with one letter put in."""
    n = a.shape[1]
    head, tail = a == b[:, :n], (a == b[:, 1:])[:, ::-1]
    run = lambda m: np.where(m.all(axis=1), n, np.argmin(m, axis=1))
    return run(head) + run(tail) >= n


def _near(left: np.ndarray, right: np.ndarray):
    check = one_replaced if left.shape[1] == right.shape[1] else one_inserted
    step = max(1, LETTERS // right.shape[1])
    for i, j in gram_pairs(left, right):
        for lo in range(0, len(i), step):
            a, b = i[lo : lo + step], j[lo : lo + step]
            ok = check(left[a], right[b])
            yield a[ok], b[ok]


def _sums(rows: np.ndarray, other: np.ndarray, rank: np.ndarray):
    """For each distinct row: how many others, and the one of least rank."""
    order = np.lexsort((rank[other], rows))
    rows, other = rows[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
    return rows[first], np.diff(np.append(first, len(rows))), other[first]


def _tile(table: pa.Table) -> pa.Table:
    """Near words of one tile: per word their number and the best of them."""
    words = np.array([w.encode("latin-1") for w in table["word"].to_pylist()], object)
    n, side, own = (table[c].to_numpy() for c in ("n", "side", "own"))
    left, size = np.flatnonzero(side == 0), np.array([len(w) for w in words])
    rank = np.empty(len(words), np.int64)
    rank[np.lexsort((words.astype(bytes) if size.max() <= SINGLE else _places(words), -n))] = np.arange(len(words))
    found = []
    base = int(size[left[0]]) if len(left) else 0
    a = letters_matrix(list(words[left])) if len(left) else None
    for length in (base, base + 1) if len(left) else ():
        right = np.flatnonzero((side == 1) & (size == length))
        if not len(right):
            continue
        for i, j in _near(a, letters_matrix(list(words[right]))):
            found.append((left[i], right[j]))
    i = np.concatenate([f[0] for f in found]) if found else np.zeros(0, int)
    j = np.concatenate([f[1] for f in found]) if found else np.zeros(0, int)
    back = ~own[j].astype(bool)  # the block's own words meet from both sides
    parts = [_sums(i, j, rank), _sums(j[back], i[back], rank)]
    who, near, best = (np.concatenate([p[k] for p in parts]) for k in range(3))
    text = lambda ks: pa.array([words[k].decode("latin-1") for k in ks], pa.string())
    return pa.table({"word": text(who), "n_near": pa.array(near.astype(np.int64)), "form": text(best),
                     "form_n": pa.array(n[best].astype(np.int64))})


def _places(words: np.ndarray) -> np.ndarray:
    """Places of the words in code-point order (latin-1 bytes keep it)."""
    order = sorted(range(len(words)), key=words.__getitem__)
    out = np.empty(len(words), np.int64)
    out[order] = np.arange(len(words))
    return out


def near_words(words: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """``word, n_near, best_n, best`` of the words that have near words."""
    groups = groups or choose_groups(words)
    part = (tiles(words, groups).groupBy("key", "i", "j")
            .applyInArrow(_tile, "word string, n_near long, form string, form_n long"))
    return part.groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("w"))).alias("b")
    ).select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


# ------------------------------------------------------------------ forms
def roots(forms: DataFrame, most: int) -> DataFrame:
    """``word, root`` by pointer doubling over ``word, form``.  A form is at
    least ten times as frequent, so a chain has at most log10(``most``) links."""
    links = math.ceil(math.log2(max(math.log10(max(most, 10)), 1) + 1))
    at = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    for _ in range(links):
        nxt = at.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        at = materialise(
            at.join(sized_side(nxt, F.length("_w") + F.length("_next") + 16), F.col("root") == F.col("_w"), "left")
            .select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")
    return at


def variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``."""
    words = materialise(vocabulary(docs, text_col, id_col), "spelling-words")
    most = words.agg(F.max("n")).first()[0] or 0
    near = near_words(words).withColumnRenamed("word", "_w")
    is_form = F.col("best_n") >= FORM_TIMES * F.col("n")
    known = materialise(words.join(near.hint("merge"), F.col("word") == F.col("_w"), "left").select(
        "word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, F.col("best_n")).alias("form_n")), "spelling-known")
    last = roots(known.where("form IS NOT NULL"), most).select(F.col("word").alias("_w"), "root")
    return known.join(last.hint("merge"), F.col("word") == F.col("_w"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
