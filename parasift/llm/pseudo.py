"""Language-model scoring by masked pseudo-likelihood.

A small network predicts every word from both sides: position-specific vectors of
the two words before and the two after are added, pass a tanh layer and a
two-level softmax: the group of the word's class, then the class in its group, so a
word costs 2 x 32 outputs, not 1,024.  A document's score is the sum over all its words
of the log-probability of the word given its neighbours.

Classes: the words that occur most in the whole corpus (all documents are
counted) have one each; all others share one in ``SHARED`` of the classes, by a hash of
their last two bytes.  The classes number twice the square root of the vocabulary,
``CLASSES`` at least.  A word w of a shared class c has the probability P(c) x n(w) /
(n(c) + 1) by the counts of all words, a word that the corpus does not have P(c) /
(n(c) + 1); so the probabilities of all words and of one unknown word per shared
class add up to 1.  The counts of the up to ``TABLE_WORDS`` most frequent words are sent
to the tasks; those of all others stay a table and come to the documents by a join.  Training is distributed: in each of ``ROUNDS`` passes every task trains a
copy of the network (numpy, Adagrad) on its documents; every position is a
target in one pass, chosen by hash, and context in all.  The copies are averaged per
parameter, weighted by their positions.  A copy learns from ``LEAST_TARGETS`` positions
for each of its parameters at least (tasks read more of the corpus as the network
grows), so the shuffle of the copies follows the corpus.  The driver gets the averaged
parameters and the word table only.

Edge cases: null or blank texts have no words, score 0 and mean null; a document
of one word is predicted from borders only; a corpus without words gives the
untrained network and unknown words only; rows with equal or null ids are scored one by one; extra
columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import least_count, materialise, sized_side
from .hashing import Words, mapped, mix, utf8_parts

GROUPS, MEMBERS, SHARED, HIDDEN = 32, 32, 16, 24
CLASSES = GROUPS * MEMBERS  # class c is member c // groups of group c % groups
SIDES = (-2, -1, 1, 2)
ROUNDS, BATCH, RATE = 2, 1024, 0.15
COUNT_BLOCK = 1 << 21
SCORED, PLANNED, RANKS, DENSE_BLOCK = 2048, 16, 12, 1 << 14  # rows at once, steps sorted at once, rows of a cell added up by rank
EXPONENT = 64  # logits below it in size need no shift: sums of their exponentials stay in 32 bits
TABLE_WORDS, LEAST_TARGETS, PARAMETER_BLOCK = 1 << 19, 2, 1 << 12
_FOLD = np.array([c + 32 if 65 <= c < 91 else c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else 32 for c in range(256)], np.uint8)
_SLOTS = 1 << 20
BUCKET_BITS, PLACE_BITS = 19, 21


def _words(raw: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of a part and each one's last two bytes as a number."""
    folded = mapped(raw, _FOLD.tobytes())
    words = Words(folded)
    tail = folded[words.end - 1].astype(np.uint64) if len(words.end) else np.zeros(0, np.uint64)
    before = np.maximum(words.end - 2, words.start)
    return words, tail * np.uint64(256) + folded[before] if len(words.end) else tail


def _distinct(words: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words, ascending, how often each occurs, and its tail.  The
    hashes alone are sorted; a place of each word is kept by its first bits,
    and only words that lost theirs to another are sorted with their places."""
    ranked = np.sort(words)
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(words)), bool), ranked[1:] != ranked[:-1]]))
    word, n = ranked.take(head), np.diff(head, append=len(words))
    held, bits = np.zeros(1 << PLACE_BITS, np.int32), np.uint64(64 - PLACE_BITS)
    held[words >> bits] = np.arange(len(words))
    at = held.take((word >> bits).view(np.int64))
    lost = np.flatnonzero(words.take(at) != word)
    if len(lost):
        rest = np.flatnonzero(words.take(held.take((words >> bits).view(np.int64))) != words)
        at[lost] = rest[np.unique(words.take(rest), return_index=True)[1]]
    return word, n, tails.take(at)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (hash), ``n`` over all documents, ``tail`` (last two bytes)."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            words, tails = (np.concatenate(x) for x in zip(*held, strict=True))
            word, n, tail = _distinct(words, tails)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(word.view(np.int64)), pa.array(n, pa.int64()), pa.array(tail.astype(np.int32))],
                names=["word", "n", "tail"])

        for batch in batches:
            for _, raw, _ in utf8_parts(batch.column(0)):
                words, tails = _words(raw)
                held.append((words.hash, tails.astype(np.uint16)))
                size += len(words.hash)
                if size >= COUNT_BLOCK:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, "word long, n long, tail int").groupBy("word").agg(
        F.sum("n").alias("n"), F.min("tail").alias("tail"))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(44)


def _shared_class(tails: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` shared classes a word of that tail belongs to."""
    return (mix(tails.astype(np.uint64)) % np.uint64(n)).astype(np.int64)


@dataclass
class Network:
    """``known``: hashes of the words with a class of their own; ``shared``:
    occurrences in each of the shared classes, which are the last ones.  The
    class after the last is the border."""

    known: np.ndarray
    shared: np.ndarray
    inside: np.ndarray  # sides x (classes + border) x hidden
    bias: np.ndarray
    group: np.ndarray  # hidden x groups
    group_prior: np.ndarray
    member: np.ndarray  # groups x hidden x members
    member_prior: np.ndarray  # groups x members

    @staticmethod
    def fresh(words: list[int], counts: list[int], total: int, side: int = GROUPS, shared: np.ndarray | None = None) -> Network:
        """``side`` groups of as many members; ``shared`` is by default what
        ``total`` leaves, spread evenly."""
        draw = np.random.default_rng(5)
        classes, n = side * side, side * side // SHARED
        shared = np.full(n, max(0, total - sum(counts)) / n) if shared is None else shared
        share = np.full(classes, 1e-3)
        share[: len(counts)] = counts
        share[classes - n :] = shared + 1
        share = (share / share.sum()).reshape(side, side).T
        weights = [draw.normal(0, 0.1, shape) for shape in (
            (len(SIDES), classes + 1, HIDDEN), (HIDDEN, side), (side, HIDDEN, side))]
        arrays = (weights[0], np.zeros(HIDDEN), weights[1], np.log(share.sum(axis=1)), weights[2],
                  np.log(share / share.sum(axis=1, keepdims=True)))
        return Network(np.array(words, np.int64).view(np.uint64), np.asarray(shared, np.float64), *(x.astype(np.float32) for x in arrays))

    @property
    def groups(self) -> int:
        return len(self.group_prior)

    @property
    def classes(self) -> int:
        return self.member_prior.size

    def parameters(self) -> list[np.ndarray]:
        return [self.inside, self.bias, self.group, self.group_prior, self.member, self.member_prior]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def replaced(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parameters():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(self.known, self.shared, *out)

    def classifier(self):
        """A function from word hashes and tail hashes to classes."""
        slot = np.zeros(_SLOTS, np.int32)
        slot[_slot(self.known)] = np.arange(len(self.known))
        rare = self.classes - len(self.shared) + _shared_class(np.arange(1 << 16), len(self.shared))  # of each tail

        def classes(hashes: np.ndarray, tails: np.ndarray) -> np.ndarray:
            own = rare.take(tails.view(np.int64))
            if len(self.known):
                at = slot.take(_slot(hashes).view(np.int64))
                np.copyto(own, at, where=self.known.take(at) == hashes)
            return own

        return classes

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the groups (hidden + 1 x groups) and of the members
        (groups x hidden + 1 x members), the priors in the last row."""
        return (np.concatenate([self.group, self.group_prior[None]]),
                np.concatenate([self.member, self.member_prior[:, None]], axis=1))

    def log_probs(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target given the classes around it."""
        out, (high, low) = np.empty(len(target), np.float64), self.joined()
        # hidden values are 1 at most in size, so logits are no larger than these sums
        large = max(np.abs(high).sum(axis=0).max(), np.abs(low).sum(axis=1).max()) >= EXPONENT
        vectors, side, ones = self.inside.copy(), self.groups, np.ones(self.groups, np.float32)
        vectors[0] += self.bias
        vectors, values = vectors.reshape(-1, HIDDEN), np.ones((SCORED, HIDDEN + 1), np.float32)
        member = target // side
        group = target - member * side
        _, order = _sorted(group, len(group).bit_length(), side)
        held, first = np.empty((SCORED, side), np.float32), np.arange(SCORED) * side
        for at in range(0, len(target), SCORED):
            rows = order[at : at + SCORED]
            of, logits = group.take(rows), held[: len(rows)]
            hidden = _hidden(vectors, _cells(around.take(rows, axis=0), self.classes).ravel(), None, values)
            part = np.zeros(len(rows), np.float32)
            for level, own in enumerate((of, member.take(rows))):
                if level:
                    _members(hidden, low, _runs(of), logits)
                else:
                    hidden.dot(high, out=logits)
                if large:
                    _lower(logits)
                part += held.reshape(-1).take(first[: len(rows)] + own)
                part -= np.log(np.exp(logits, out=logits).dot(ones))
            out[rows] = part
        return out

    def learn(self, around: np.ndarray, target: np.ndarray, seen: list[np.ndarray]) -> None:
        """One Adagrad step; ``seen`` holds the squared gradients so far."""
        copy = Copy(self, seen)
        copy.learn(around, target, len(target))
        for held, now in ((self.parameters(), copy.parameters(0)), (seen, copy.parameters(1))):
            for p, q in zip(held, now, strict=True):
                p[...] = q


class Copy:
    """A network in training, in the layout its steps work on.  ``inside`` and
    ``dense``: the class vectors, and all other parameters in one array; of
    each the values, their squared gradients so far and, of the dense, the
    gradients of a step."""

    def __init__(self, net: Network, seen: list[np.ndarray] | None = None):
        self.net, side = net, net.groups
        self.values = np.ones((BATCH, HIDDEN + 1), np.float32)
        self.inside = np.zeros((2, len(SIDES) * (net.classes + 1), HIDDEN), np.float32)
        self.dense = np.zeros((3, HIDDEN + (HIDDEN + 1) * side * (side + 1)), np.float32)
        at = HIDDEN, HIDDEN + (HIDDEN + 1) * side
        self.parts = [(x[: at[0]], x[at[0] : at[1]].reshape(HIDDEN + 1, side), x[at[1] :].reshape(side, HIDDEN + 1, side)) for x in self.dense]
        for k, values in enumerate((net.parameters(), seen or [])):
            for p, q in zip(self.parameters(k), values, strict=False):
                p[...] = q

    def parameters(self, k: int) -> list[np.ndarray]:
        """Views in the order of ``Network.parameters`` of the parameters (0)
        or their squared gradients (1)."""
        bias, high, low = self.parts[k]
        return [self.inside[k].reshape(len(SIDES), -1, HIDDEN), bias, high[:HIDDEN], high[HIDDEN], low[:, :HIDDEN], low[:, HIDDEN]]

    def network(self) -> Network:
        return self.net.replaced(np.concatenate([p.ravel() for p in self.parameters(0)]))

    def learn(self, around: np.ndarray, target: np.ndarray, size: int = BATCH) -> None:
        """An Adagrad step for each ``size`` rows."""
        full = len(target) - len(target) % size
        for at in range(0, full, size * PLANNED):
            rows = slice(at, min(full, at + size * PLANNED))
            for step in _steps(around[rows], target[rows], self.net, size):
                self._step(*step)
        if full < len(target):
            self.learn(around[full:], target[full:], len(target) - full)

    def _step(self, cells: np.ndarray, runs: list[tuple[int, int, int]], own: np.ndarray, changed: np.ndarray,
              ranks: list[np.ndarray], rest: np.ndarray, head: np.ndarray) -> None:
        n = len(own) // 2
        bias, high, low = self.parts[0]
        if len(self.values) < n:
            self.values = np.ones((n, HIDDEN + 1), np.float32)
        hidden = _hidden(self.inside[0], cells, bias, self.values)
        logits = _softmax(hidden, high, low, runs, n)
        logits.reshape(-1)[own] -= np.float32(1 / n)
        error, errors = logits
        new_bias, new_high, new_low = self.parts[2]
        np.dot(hidden.T, error, out=new_high)
        if len(runs) < len(low):
            new_low[...] = 0
        back = np.empty((n, HIDDEN), np.float32)
        for g, a, b in runs:
            part = errors[a:b]
            hidden[a:b].T.dot(part, out=new_low[g])
            part.dot(low[g, :HIDDEN].T, out=back[a:b])
        back += error @ high[:HIDDEN].T
        slope = hidden[:, :HIDDEN] * hidden[:, :HIDDEN]
        back *= np.subtract(1, slope, out=slope)
        np.dot(np.ones(n, np.float32), back, out=new_bias)
        for at in range(0, self.dense.shape[1], DENSE_BLOCK):  # what stays in the processor's cache
            _adagrad(*self.dense[:, at : at + DENSE_BLOCK])
        total = back.take(ranks[0], axis=0)
        for rank in ranks[1:]:
            total[: len(rank)] += back.take(rank, axis=0)
        if len(head):
            total[: len(head)] += _sums(back.take(rest, axis=0), head)
        whole = [x.reshape(-1).view(f"V{4 * HIDDEN}") for x in self.inside]  # a vector is one item
        now = [x.take(changed).view(np.float32) for x in whole]
        _adagrad(*now, total.reshape(-1))
        for x, values in zip(whole, now, strict=True):
            x[changed] = values.view(x.dtype)


def _cells(around: np.ndarray, classes: int) -> np.ndarray:
    """Rows of the class vectors of all sides, side by side: k * (classes + 1)
    + c is class c on side k."""
    return around.swapaxes(-1, -2) + (np.arange(len(SIDES), dtype=np.int64) * (classes + 1))[:, None]


def _hidden(vectors: np.ndarray, cells: np.ndarray, bias: np.ndarray | None, out: np.ndarray) -> np.ndarray:
    """Hidden values of each row, written to ``out`` before its column of
    ones, which the priors are weights of."""
    parts = vectors.take(cells, axis=0).reshape(len(SIDES), -1, HIDDEN)
    total = parts[0]
    for part in parts[1:]:
        total += part
    if bias is not None:
        total += bias
    out = out[: len(total)]
    out[:, :HIDDEN] = np.tanh(total, out=total)
    return out


def _logits(hidden: np.ndarray, high: np.ndarray, low: np.ndarray, runs) -> np.ndarray:
    """Logits of the groups and of the members of each row's group; rows of
    one group stand together (``runs``)."""
    out = np.empty((2, len(hidden), high.shape[1]), np.float32)
    hidden.dot(high, out=out[0])
    _members(hidden, low, runs, out[1])
    return out


def _members(hidden: np.ndarray, low: np.ndarray, runs, out: np.ndarray) -> None:
    for g, a, b in runs:  # the method: a call of np.dot costs as much again
        hidden[a:b].dot(low[g], out=out[a:b])


def _softmax(hidden: np.ndarray, high: np.ndarray, low: np.ndarray, runs, n: int) -> np.ndarray:
    """Probabilities by those logits, divided by ``n``; they are shifted only
    where the sums of their exponentials leave the 32-bit range."""
    logits = _logits(hidden, high, low, runs)
    rows = logits.reshape(-1, logits.shape[2])
    ones = np.ones(rows.shape[1], np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        sums = np.exp(rows, out=rows) @ ones
    if not math.exp(-EXPONENT) < sums.min() <= sums.max() < math.exp(EXPONENT):
        rows[...] = _logits(hidden, high, low, runs).reshape(rows.shape)
        _lower(rows)
        sums = np.exp(rows, out=rows) @ ones
    sums *= n
    rows /= sums[:, None]
    return logits


def _lower(logits: np.ndarray) -> None:
    """Subtracts each row's largest value where ``exp`` could leave the 32-bit range."""
    if not -EXPONENT < logits.min() <= logits.max() < EXPONENT:
        logits -= logits.max(axis=1)[:, None]


def _sums(rows: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``head``; two columns are added
    at once, as the parts of a complex number."""
    if rows.shape[1] % 2:
        return np.add.reduceat(rows, head, axis=0)
    return np.add.reduceat(rows.view(np.complex64), head, axis=0).view(np.float32)


def _adagrad(values: np.ndarray, squares: np.ndarray, gradient: np.ndarray) -> None:
    root = gradient * gradient
    squares += root
    np.add(squares, np.float32(1e-8), out=root)
    np.sqrt(root, out=root)
    np.divide(gradient, root, out=root)
    root *= np.float32(RATE)
    values -= root


def _sorted(value: np.ndarray, shift: int, below: int) -> tuple[np.ndarray, np.ndarray]:
    """Values (less than ``below``) of each row in stable order, and their
    places in the row (less than 2 ** ``shift``); both are sorted as one number."""
    kind = np.uint32 if below << shift <= 1 << 32 else np.int64
    key = value.astype(kind) << kind(shift)
    key |= np.arange(value.shape[-1], dtype=kind) & kind((1 << shift) - 1)
    key.sort(axis=-1)
    return key >> kind(shift), key & kind((1 << shift) - 1)


def _steps(around: np.ndarray, target: np.ndarray, net: Network, size: int):
    """What ``Copy._step`` takes for each ``size`` rows, sorted for many steps
    at once: the rows' cells (see ``_cells``) and ``_runs`` in group order; the
    places of their own logits; the cells that occur, by falling number of
    rows; the row that has each cell first, second and so on up to ``RANKS``
    (each list is for the first cells); the rows beyond that, cell by cell,
    and where those of a cell begin."""
    many, shift, groups = len(target) // size, (size - 1).bit_length(), net.groups
    member = target // groups
    group, place = _sorted((target - member * groups).reshape(many, size), shift, groups)
    order = (place + np.arange(0, len(target), size)[:, None]).ravel()
    own = np.concatenate([group, member.take(order).reshape(many, size)], axis=1) + np.arange(2 * size) * groups
    cells = _cells(around.take(order, axis=0).reshape(many, size, -1), net.classes)
    kind = np.uint32 if len(SIDES) * (net.classes + 1) << shift <= 1 << 32 else np.int64
    key = (cells.astype(kind) << kind(shift) | np.arange(size, dtype=kind)).reshape(many, -1)
    key.sort(axis=1)
    cell, row = key >> kind(shift), (key & kind((1 << shift) - 1)).ravel()
    first = np.ones(cell.shape, bool)
    np.not_equal(cell[:, 1:], cell[:, :-1], out=first[:, 1:])
    start = np.flatnonzero(first)
    n = np.diff(start, append=first.size)
    at = np.append(0, np.cumsum(np.count_nonzero(first, axis=1)))
    falling = np.repeat(np.arange(many) * (RANKS + 1), np.diff(at)) + (RANKS + 1 - np.minimum(n, RANKS + 1))
    by_rows = np.argsort(falling.astype(np.uint16), kind="stable")
    start, n = start.take(by_rows), n.take(by_rows)
    changed, changed_at = cell.ravel().take(start).astype(np.int64), at.tolist()
    ranks = []
    for k in range(RANKS):
        ranks.append((row.take(start + k), at.tolist()))
        more = np.flatnonzero(n > k + 1)
        start, n, at = start.take(more), n.take(more), more.searchsorted(at)
    left = n - RANKS
    head = np.append(0, np.cumsum(left))
    rest, at = row.take(np.repeat(start + RANKS - head[:-1], left) + np.arange(head[-1])), at.tolist()
    cells = cells.reshape(many, -1)
    for k in range(many):
        lists = [rows[cuts[k] : cuts[k + 1]] for rows, cuts in ranks if cuts[k] < cuts[k + 1]]
        a, b = at[k : k + 2]
        yield (cells[k], _runs(group[k]), own[k], changed[changed_at[k] : changed_at[k + 1]], lists,
               rest[head[a] : head[b]], head[a:b] - head[a])


def _runs(group: np.ndarray) -> list[tuple[int, int, int]]:
    """``group, from, to`` of the groups that occur, of rows in group order."""
    cuts = [0, *((group[1:] != group[:-1]).nonzero()[0] + 1).tolist()]
    return list(zip(group.take(cuts).tolist(), cuts, [*cuts[1:], len(group)], strict=True))


def _laid_out(words: Words, tails: np.ndarray, offsets: np.ndarray, classes, border: int, rows=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes around each word, its own class, and each text's first word;
    texts are separated by borders.  ``rows`` gives, of the first words, the
    words to return; by default all."""
    bounds = np.searchsorted(words.start, offsets)
    own = classes(words.hash, tails)
    gap = max(SIDES)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    place = np.arange(len(own)) + gap * (text + 1)
    line = np.full(len(own) + gap * (len(offsets) + 1), border, np.int32)
    line[place] = own
    rows = slice(None) if rows is None else rows(bounds)
    return line.take(place[rows][:, None] + np.array(SIDES)), own[rows], bounds


def _rounds(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The pass in which each word is a target, by its hash and its place in its text."""
    place = np.arange(len(hashes)) - np.repeat(bounds[:-1], np.diff(bounds))
    return (mix(hashes ^ mix(place.astype(np.uint64))) % np.uint64(ROUNDS)).astype(np.int64)


def most_copies(words: int, parameters: int) -> int:
    """Copies to train on a corpus of ``words`` words."""
    return max(1, words // (ROUNDS * LEAST_TARGETS * parameters))


def _trained(docs: DataFrame, net: Network, text_col: str, round_no: int, copies: int) -> Network:
    """The average of the copies (``copies`` at most) that the tasks train on
    their documents."""
    start = net.flat()

    def run(batches):
        own = Copy(net)
        classes, steps = net.classifier(), 0
        for batch in batches:
            for _, raw, offsets in utf8_parts(batch.column(0)):
                words, tails = _words(raw)
                if not len(words.hash):
                    continue
                draw = np.random.default_rng(round_no)
                around, target, _ = _laid_out(words, tails, offsets, classes, net.classes, lambda bounds: draw.permutation(
                    np.flatnonzero(_rounds(words.hash, bounds) == round_no)))
                own.learn(around, target)
                steps += len(target)
        if steps:
            flat = own.network().flat()
            at = np.append(np.arange(0, len(flat), PARAMETER_BLOCK), len(flat))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(at) - 1), pa.int32()), pa.array(np.full(len(at) - 1, float(steps))),
                 pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat))],
                names=["block", "weight", "values"])

    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    blocks = texts.coalesce(copies).mapInArrow(run, "block int, weight double, values array<float>").repartition("block")
    rows = blocks.select("block", "weight", F.posexplode("values").alias("place", "v")).groupBy("block", "place").agg(
        (F.sum(F.col("v") * F.col("weight")) / F.sum("weight")).alias("v")).toPandas()
    if not len(rows):
        return net
    start[rows["block"].to_numpy(np.int64) * PARAMETER_BLOCK + rows["place"].to_numpy()] = rows["v"].to_numpy()
    return net.replaced(start)


@dataclass
class Model:
    """``words``: hashes, ascending, of the words of the table, ``log_n``
    beside them; ``vocabulary``: ``word`` and ``log_n`` of all others that
    occur more than once (for the rest it is 0)."""

    net: Network
    words: np.ndarray
    log_n: np.ndarray
    vocabulary: DataFrame

    @cached_property
    def starts(self) -> np.ndarray:
        """Where the words of each value of the first ``BUCKET_BITS`` bits begin."""
        first = (self.words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        return np.append(0, np.cumsum(np.bincount(first, minlength=1 << BUCKET_BITS)))

    def logs(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is in the table, and its ``log_n`` (else 0)."""
        if not len(self.words):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes))
        # hashes are spread evenly: few words begin with the same bits, and these stand together
        starts = self.starts
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        at, left = starts.take(bucket), np.arange(len(hashes))
        found, log_n = np.zeros(len(hashes), bool), np.zeros(len(hashes))
        end = starts.take(bucket + 1)
        while len(left):
            more = np.flatnonzero(at < end)
            left, at, end = left.take(more), at.take(more), end.take(more)
            hit = self.words.take(at) == hashes.take(left)
            found[left[hit]], log_n[left[hit]] = True, self.log_n[at[hit]]
            more = np.flatnonzero(~hit)
            left, at, end = left.take(more), at.take(more) + 1, end.take(more)
        return found, log_n


def train(docs: DataFrame, text_col: str = "text", table_words: int = TABLE_WORDS) -> Model:
    """Network and word counts over all documents of a corpus."""
    counts = materialise(count_words(docs, text_col), "pseudo-words")
    tails = counts.groupBy("tail").agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()  # 65,536 rows at most
    total, words = int(tails["n"].sum()), int(tails["words"].sum())
    side = max(GROUPS, math.ceil(math.sqrt(2 * math.sqrt(words))))
    n_shared = side * side // SHARED
    top = counts.orderBy(F.desc("n"), "word").limit(side * side - n_shared).toPandas()
    # of two words of a slot the more frequent one, the other is a shared word
    _, first = np.unique(_slot(top["word"].to_numpy(np.int64).view(np.uint64)), return_index=True)
    top = top.iloc[np.sort(first)]
    shared = np.zeros(n_shared)
    np.add.at(shared, _shared_class(tails["tail"].to_numpy(np.int64), n_shared), tails["n"].to_numpy(np.float64))
    np.add.at(shared, _shared_class(top["tail"].to_numpy(np.int64), n_shared), -top["n"].to_numpy(np.float64))
    net = Network.fresh(top["word"].tolist(), top["n"].tolist(), total, side, shared)
    copies = most_copies(total, len(net.flat()))
    for k in range(ROUNDS):
        net = _trained(docs, net, text_col, k, copies)
    logs = counts.where("n > 1").select("word", "n", F.log("n").alias("log_n"))
    least = least_count(logs, table_words)
    if least is None:
        return Model(net, np.zeros(0, np.uint64), np.zeros(0), logs.drop("n"))
    table = logs.where(F.col("n") >= least).select("word", "log_n").toArrow()
    words, log_n = table["word"].to_numpy().view(np.uint64), table["log_n"].to_numpy()
    order = np.argsort(words)
    return Model(net, words[order], log_n[order], logs.where(F.col("n") < least).drop("n"))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``n_words``, ``pseudo_log_likelihood``
    and ``mean_log_prob`` (null without words)."""
    net, table = model.net, replace(model, vocabulary=None)  # a data frame stays on the driver
    own = ["n_words", "pseudo_log_likelihood", "mean_log_prob"]
    keep = [c for c in docs.columns if c != text_col and c not in own]
    schema = T.StructType([docs.schema[c] for c in keep]).add("_n_", T.LongType()).add("_sum_", T.DoubleType()).add(
        "_row_", T.LongType()).add("_shared_", T.ArrayType(T.LongType()))
    source = docs.select(*[docs[c] for c in keep], docs[text_col].cast("string").alias("_text_"))

    def run(batches):
        classes, at = net.classifier(), TaskContext.get().partitionId() << 40
        first, outside = net.classes - len(net.shared), np.log(net.shared + 1)
        for batch in batches:
            for row, raw, offsets in utf8_parts(batch.column(len(keep))):
                words, tails = _words(raw)
                around, target, bounds = _laid_out(words, tails, offsets, classes, net.classes)
                logs, shared = net.log_probs(around, target), np.flatnonzero(target >= first)
                logs[shared] -= outside[target[shared] - first]
                found, log_n = table.logs(words.hash[shared])
                logs[shared] += log_n
                shared = shared[~found]
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                n = np.diff(bounds)
                lists = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(shared, bounds), pa.int32()), pa.array(words.hash[shared].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(row, len(n)) for i in range(len(keep))), pa.array(n, pa.int64()),
                     pa.array(sums[bounds[1:]] - sums[bounds[:-1]]), pa.array(at + np.arange(len(n))), lists],
                    names=[*keep, "_n_", "_sum_", "_row_", "_shared_"])
                at += len(n)

    scored = materialise(source.mapInArrow(run, schema), "pseudo-scores")
    side = sized_side(model.vocabulary.select(F.col("word").alias("_word_"), "log_n"), F.lit(16))
    inside = scored.select("_row_", F.explode("_shared_").alias("_w_")).join(side, F.col("_w_") == F.col("_word_"))
    inside = inside.groupBy(F.col("_row_").alias("_of_")).agg(F.sum("log_n").alias("_inside_"))
    total = F.col("_sum_") + F.coalesce("_inside_", F.lit(0.0))
    return scored.drop("_shared_").join(inside, F.col("_row_") == F.col("_of_"), "left").select(
        *keep, F.col("_n_").alias(own[0]), total.alias(own[1]), F.when(F.col("_n_") > 0, total / F.col("_n_")).alias(own[2]))
