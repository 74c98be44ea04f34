"""Exact n-gram Jaccard join and its classes, by set-relation skipping.

A document's set holds the 64-bit hashes of its distinct word n-grams; sets
with the same content are one class from the start.  Two sets link when
``100 * |A and B| >= percent * |A or B|``.

Block skipping.  The hashes are a global order of positions.  Each size class
cuts it into blocks, more of them than elements in which two linked sets of the
class can differ; so linked sets agree on the whole of at least one block that
is not empty, and the index keeps one list per (block, its content) in place of
one per n-gram.  A probe skips every block whose content differs, and a passage
that many documents share makes no long list unless it fills a block.  A set
with too few filled blocks is entered again under twice as many, until
it has enough: no linked pair is missed.

A set with s filled blocks agrees with a linked one on s minus that number of
elements at least, its ``need``; so of its lists the ``need - 1`` longest can be left
out: two sets that agree on ``need`` blocks meet in one of the others (lists
ordered by length, then key, for all sets alike).  Texts that share a phrase or two
meet nowhere.

Answers from similar sets.  In each list the members are compared with one
representative R only, which gives d(A) = A xor R exactly.  All else follows from
these differences: |A xor B| = |d(A)| + |d(B)| - 2 |d(A) and d(B)|, so two members
that are not both close to R link only if their differences share many
elements.  The differences to R, rarest element first, form index lists by
position; an entry at position i of d(A) is skipped against d(B) unless
``2 i <= |d(A)| - |d(B)| + most``, ``most`` being the largest |A xor B| of a linked
pair of these sizes.  Elements that edits of a common text add are rare and come
first, those that they remove are shared and come too late to be looked at.
Members that links already join are not compared at all.

So a group of near copies, however large, costs about one comparison each.  Sets
are compared by their hashes; two n-grams of equal 64-bit hash count as one.

Edge cases: null or blank text has the empty set and links with nothing; a row
with a null id links with nothing and has component null; equal ids and repeated
rows give one result row each; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parasift.session import remove_scratch

from .common import materialise, materialise_at, row_key, scratch_path, sized_side, small_batches, without_rows
from .components import components
from .hashing import mix, shingle_sets, utf8_parts

GROWTH = 1.5  # of the size classes
TAG_BITS = 12  # of a key: 64 size classes, 64 levels
PART_BYTES = 1 << 19  # of texts hashed at once: the arrays take some tens of bytes for each of text


def size_classes(largest: int) -> list[int]:
    """Lower bounds of the size classes up to ``largest`` and the one above."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, int(out[-1] * GROWTH)))
    return out


def block_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of one set (sorted hashes): see the module text."""
    return block_index(tokens, percent)[0]


def block_index(tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys of one set (sorted hashes) and, for each size class and level
    it is entered under, ``need << TAG_BITS | tag``; a key ends with its tag."""
    n, keys, needs = len(tokens), [], []
    lows = size_classes(n)
    high32 = tokens >> np.uint64(32)
    mixed = mix(tokens)
    for c in range(len(lows) - 2, -1, -1):
        top = lows[c + 1] - 1  # the smaller set of a pair has lows[c]..top elements
        if top * 100 // percent < n:
            break
        differ = min(n, top) * (100 - percent) // percent
        if not differ:
            continue  # only equal sets link, and those are one class
        blocks, level = top * (100 - percent) // percent * 23 // 20 + 2, 0
        while True:
            block = (high32 * np.uint64(blocks)) >> np.uint64(32)
            starts = np.flatnonzero(np.diff(block, prepend=np.uint64(2**63)))
            content = np.add.reduceat(mixed, starts)
            tag = c * 64 + level
            key = mix(content ^ mix(block[starts] + np.uint64(tag << 40)))
            keys.append(key >> np.uint64(TAG_BITS) << np.uint64(TAG_BITS) | np.uint64(tag))
            needs.append(max(1, len(starts) - differ) << TAG_BITS | tag)
            if len(starts) > differ:
                break
            blocks, level = min(blocks * 2, 2**32 - 1), level + 1
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64), np.array(needs, np.int64)


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``id, n, cid, keys, needs`` per row: set size, content id, index keys."""
    schema = docs.schema["_id"].simpleString().partition(":")[2]

    def run(batches):
        for batch in batches:
            ids = batch.column("_id")
            for row, raw, offsets in utf8_parts(batch.column("_text"), PART_BYTES):
                size, cid, keys, needs = [], [], [], []
                for tokens in shingle_sets(raw, offsets, words):
                    size.append(len(tokens))
                    cid.append(content_id(tokens))
                    key, need = block_index(tokens, percent) if len(tokens) else (np.zeros(0, np.int64),) * 2
                    keys.append(key)
                    needs.append(need)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, len(size)), pa.array(size, pa.int64()), pa.array(cid, pa.int64()), _lists(keys), _lists(needs)],
                    names=["id", "n", "cid", "keys", "needs"])
            pa.default_memory_pool().release_unused()  # a reused worker would hold it

    return docs.mapInArrow(run, f"id {schema}, n long, cid long, keys array<long>, needs array<long>")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    bounds = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(arrays)))


def content_id(tokens: np.ndarray) -> np.int64:
    return np.uint64(xxhash.xxh64_intdigest(tokens)).astype(np.int64)


def _tokens(docs: DataFrame, words: int) -> DataFrame:
    """``cid`` and the set as bytes of rows ``cid, _text``; a text of other
    content (ids may repeat) has no row."""

    def run(batches):
        for batch in batches:
            for row, raw, offsets in utf8_parts(batch.column("_text"), PART_BYTES):
                cids = batch.column("cid").slice(row, len(offsets) - 1).to_pylist()
                sets = [(c, t.tobytes()) for c, t in zip(cids, shingle_sets(raw, offsets, words), strict=True) if content_id(t) == c]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in sets], pa.int64()), pa.array([t for _, t in sets], pa.binary())], names=["cid", "tokens"])

    return docs.mapInArrow(run, "cid long, tokens binary")


def _differences(pairs: DataFrame, words: int) -> DataFrame:
    """``a, r, na, nr`` (set sizes) and ``far`` (the elements that one of both
    sets has) of rows ``a, _text`` (of a), ``r, tokens`` (of r); a text of
    other content than a (ids may repeat) has no row."""

    def run(batches):
        for batch in batches:
            other = batch.column("tokens")
            for row, raw, offsets in utf8_parts(batch.column("_text"), PART_BYTES):
                a = batch.column("a").slice(row, len(offsets) - 1).to_pylist()
                r = batch.column("r").slice(row, len(offsets) - 1).to_pylist()
                out = []
                for i, t in enumerate(shingle_sets(raw, offsets, words)):
                    if content_id(t) == a[i]:
                        rep = np.frombuffer(other[row + i].as_buffer(), np.uint64)
                        out.append((a[i], r[i], len(t), len(rep), np.setxor1d(t, rep, assume_unique=True).view(np.int64)))
                ends = np.cumsum([0, *(len(x[4]) for x in out)])
                far = np.concatenate([x[4] for x in out]) if out else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x[k] for x in out], pa.int64()) for k in range(4)),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(far))], names=["a", "r", "na", "nr", "far"])

    return pairs.mapInArrow(run, "a long, r long, na long, nr long, far array<long>")


class JaccardJoin:
    def __init__(self, docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, percent: int = 80):
        self.words, self.percent, self.id_col = words, percent, id_col
        self.texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
        spark = docs.sparkSession
        #: Folders of tables that go once the star is written: index keys, sets of representatives.
        self._keys_at, self._rep_sets_at = scratch_path(spark, "jaccard-keys"), scratch_path(spark, "jaccard-rep-sets")
        with small_batches(spark):
            self._keyed = materialise_at(_sets(self.texts, words, percent), self._keys_at)
        self.sets = materialise(self._keyed.select("id", "n", "cid"), "jaccard-sets")
        #: Whether some id occurs twice: then a class may have several texts.
        self.repeated = self.sets.where("id IS NOT NULL").groupBy("id").count().where("count > 1").limit(1).count() > 0
        #: One row per distinct non-empty set: its content id, size, an input id that has it.
        self.classes = materialise(
            self.sets.where("n > 0 AND id IS NOT NULL").groupBy("cid", "n").agg(F.min("id").alias("rep")), "jaccard-classes")

    def _star(self) -> DataFrame:
        """Pairs ``a, r``: a class and the representative of a list it is in."""
        by, own = W.partitionBy("key"), W.partitionBy("cid", "tag")
        # one document of each class enters the index, so copies make no long list
        one = sized_side(self.classes.select(F.col("cid").alias("_cid"), "rep"), F.lit(16))
        entered = self._keyed.where(F.size("keys") > 0).join(
            one, (F.col("cid") == F.col("_cid")) & F.col("id").eqNullSafe(F.col("rep")), "left_semi")
        lists = entered.select("cid", F.explode("keys").alias("key")).select(
            "cid", "key", F.count(F.lit(1)).over(by).alias("times"), (F.min("cid").over(by) < F.max("cid").over(by)).alias("shared"))
        lists = materialise(lists.where("shared").drop("shared"), "jaccard-lists")
        tag = lambda c: F.col(c).bitwiseAND((1 << TAG_BITS) - 1)
        needs = entered.select(F.col("cid").alias("_cid"), F.explode("needs").alias("need")).select(
            "_cid", tag("need").alias("_tag"), F.shiftright("need", TAG_BITS).alias("need"))
        ranked = lists.withColumn("tag", tag("key")).withColumn("place", F.row_number().over(own.orderBy("times", "key"))).withColumn(
            "held", F.count(F.lit(1)).over(own))
        used = ranked.hint("merge").join(needs, (F.col("cid") == F.col("_cid")) & (F.col("tag") == F.col("_tag"))).where(
            F.col("place") + F.col("need") <= F.col("held") + 1)
        return (
            used.select("cid", "key").withColumn("r", F.min("cid").over(by))
            .where("r != cid").select(F.col("cid").alias("a"), "r").distinct()
        )

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """``a, r, na, nr, far`` of pairs ``a, r``."""
        classes = self.classes
        text = self.texts.where(F.col("_text").isNotNull())
        reps = pairs.select(F.col("r").alias("cid")).distinct().join(classes.select("cid", F.col("rep").alias("_id")), "cid")
        reps = materialise(reps, "jaccard-reps")
        r_text = text.join(sized_side(reps, F.lit(16)), "_id").dropDuplicates(["cid"])
        with small_batches(text.sparkSession):
            r_sets = materialise_at(_tokens(r_text.select("cid", "_text"), self.words), self._rep_sets_at)
        members = materialise(
            pairs.join(classes.select(F.col("cid").alias("a"), F.col("rep").alias("_id")), "a"), "jaccard-members")
        a_text = text.join(sized_side(members, F.lit(24)), "_id").select("a", "r", "_text")
        # sets grow with the corpus: sorted and merged at every size
        full = a_text.join(r_sets.select(F.col("cid").alias("r"), "tokens").hint("merge"), "r")
        found = _differences(full, self.words)
        return found.dropDuplicates(["a", "r"]) if self.repeated else found

    def _near(self, far: Column, n: Column) -> Column:
        """Whether sets that differ in ``far`` elements and have ``n`` together link."""
        return (100 + self.percent) * far <= (100 - self.percent) * n

    def links(self) -> DataFrame:
        """Class links ``a, b`` that together connect what the join connects
        (called once: it removes the index keys)."""
        p, spark = self.percent, self.texts.sparkSession
        pairs = materialise(self._star(), "jaccard-star-pairs")
        remove_scratch(spark, self._keys_at)
        with small_batches(spark):
            star = materialise(self._compared(pairs), "jaccard-star")
        remove_scratch(spark, self._rep_sets_at)
        d = F.size("far").cast("long")
        known = star.select("a", "r", "na", d.alias("d"), self._near(d, F.col("na") + F.col("nr")).alias("near"))
        links = known.where("near").select("a", F.col("r").alias("b"))
        joined = components(links)
        known = known.join(joined, known["a"] == joined["node"], "left").select(
            "a", "r", "na", "d", "near", F.coalesce("component", "a").alias("c"))
        groups = known.groupBy("r").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("r")
        groups = materialise(groups, "jaccard-open")
        # elements that no other member has come first and make no list: only their number matters
        entries = star.join(sized_side(groups, F.lit(8)), "r", "left_semi").select("a", "r", F.explode("far").alias("e"))
        listed = materialise(
            entries.withColumn("times", F.count(F.lit(1)).over(W.partitionBy("r", "e"))).where("times > 1"), "jaccard-differences")
        own = W.partitionBy("a", "r")
        listed = listed.withColumn("k", F.row_number().over(own.orderBy("times", "e"))).withColumn(
            "shared", F.count(F.lit(1)).over(own))
        info = known.withColumnsRenamed({"a": "_a", "r": "_r"})
        listed = listed.join(info, (F.col("a") == F.col("_a")) & (F.col("r") == F.col("_r"))).withColumn(
            "i", F.col("d") - F.col("shared") + F.col("k") - 1)
        # a member near r has partners that are not, which ends its useful positions early
        listed = listed.where(F.when(F.col("near"), (100 + p) * F.col("i") <= 100 * F.col("d"))
                              .otherwise(p * F.col("i") <= (100 - p) * F.col("na")))
        listed = materialise(listed.select("a", "r", "na", "d", "c", "e", "i"), "jaccard-positions")
        one = listed.select("r", "e", "a", "c", "na", "d", "i")
        two = listed.select(F.col("r").alias("r2"), F.col("e").alias("e2"), F.col("a").alias("b"), F.col("c").alias("cb"),
                            F.col("na").alias("nb"), F.col("d").alias("db"), F.col("i").alias("j"))
        most = (100 - p) * (F.col("na") + F.col("nb"))
        open_pairs = materialise(one.hint("merge").join(
            two,
            (F.col("r") == F.col("r2")) & (F.col("e") == F.col("e2")) & (F.col("c") < F.col("cb"))
            & (100 * F.least("na", "nb") >= p * F.greatest("na", "nb"))
            & ((100 + p) * (2 * F.col("i") - F.col("d") + F.col("db")) <= most)
            & ((100 + p) * (2 * F.col("j") - F.col("db") + F.col("d")) <= most),
        ).groupBy("a", "b").agg(F.min("r").alias("r"), F.first("na").alias("n1"), F.first("nb").alias("n2")), "jaccard-open-pairs")
        side = lambda tag: star.select(
            F.col("a").alias(f"a{tag}"), F.col("r").alias(f"r{tag}"), F.col("far").alias(f"far{tag}"))
        derived = side(1).join(sized_side(open_pairs, F.lit(40)), (F.col("a") == F.col("a1")) & (F.col("r") == F.col("r1")))
        derived = materialise(derived.select("a", "b", "r", "n1", "n2", "far1"), "jaccard-derived")
        derived = side(2).join(
            derived.hint("merge"), (F.col("b") == F.col("a2")) & (F.col("r") == F.col("r2")))
        apart = F.size("far1") + F.size("far2") - 2 * F.size(F.array_intersect("far1", "far2"))
        more = derived.where(self._near(apart, F.col("n1") + F.col("n2"))).select("a", "b")
        return materialise(links.unionByName(more), "jaccard-links")

    def components(self) -> DataFrame:
        """One row per input row: the id, ``n_shingles``, ``component_id``."""
        joined = components(self.links())
        of = self.classes.join(joined, self.classes["cid"] == joined["node"], "left").select(
            "cid", "rep", F.coalesce("component", "cid").alias("component"))
        least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
        named = of.join(least, "component").select("cid", "component_id")
        full = self.sets.select("id", "n", "cid")
        out = full.where("n > 0 AND id IS NOT NULL").join(named.hint("merge"), "cid").select("id", "n", "component_id").unionByName(
            full.where("n = 0 OR id IS NULL").select("id", "n", F.col("id").alias("component_id")))
        return out.select(F.col("id").alias(self.id_col), F.col("n").alias("n_shingles"), "component_id")


def classes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id, ``n_shingles``, ``component_id`` (the
    smallest id that links reach, its own included)."""
    return JaccardJoin(docs, text_col, id_col, words, percent).components()


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` without near copies, all columns: of each class the
    row of smallest id stays (a null id is larger than any; ties by row hash).
    Rows without words link with nothing and stay; rows equal in all columns
    count once."""
    key = F.struct(*row_key(docs))
    rows = docs.select(key.alias("_row"), docs[id_col].alias("_id0"), docs[text_col].alias("_t"))
    named = rows.select(F.struct(F.col("_id0").isNull().alias("none"), F.col("_id0").alias("id"), "_row").alias("_id"), "_t")
    found = materialise(classes(named, "_t", "_id", words, percent), "jaccard-classes-of-rows")
    dropped = found.where(~F.col("_id").eqNullSafe(F.col("component_id"))).select("_id._row._key", "_id._row._key2")
    repeated = found.count() > found.select("_id").distinct().count()
    return without_rows(docs, dropped, repeated)
