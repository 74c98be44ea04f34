"""Merkle fixity audit of web archives (WARC), DataFrame functions only.

Records are ``(archive, offset, record)``: the bytes of one WARC record and
where it starts in its archive file.  ``digests`` hashes them; ``tree`` builds,
per archive, a tree over ordered offset ranges: a leaf covers ``range_bytes``
bytes of the file and hashes the (offset, length, digest) lines of the records
that start in it; each higher node covers ``fanout`` neighbours and hashes
their hashes in order, up to one root.  ``audit`` compares the roots of two
replicas and goes down only below nodes that differ, to the damaged records.

A node has at most ``fanout`` children and a leaf at most as many records as
fit in its range, so no group grows with the corpus, however large one archive
is.  The number of levels follows from the largest offset.

Edge cases: a null record counts as empty, a null archive is an archive called
null, a null offset counts as -1 (in the first range); repeated rows are hashed
as often as they occur; an empty replica lacks every archive of the other;
extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, text_or_empty

RANGE_BYTES, FANOUT = 1 << 16, 16
CRLF = "\r\n"


def warc_record(uri: Column, body: Column, record_id: Column) -> Column:
    """Bytes of a WARC/1.0 ``resource`` record with a block digest."""
    block = text_or_empty(body).cast("binary")
    head = F.concat(
        F.lit(f"WARC/1.0{CRLF}WARC-Type: resource{CRLF}WARC-Target-URI: "), text_or_empty(uri),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:page:"), text_or_empty(record_id),
        F.lit(f">{CRLF}WARC-Block-Digest: sha256:"), F.sha2(block, 256),
        F.lit(f"{CRLF}Content-Type: text/html{CRLF}Content-Length: "), F.octet_length(block).cast("string"),
        F.lit(CRLF + CRLF),
    )
    return F.concat(head.cast("binary"), block, F.lit(CRLF + CRLF).cast("binary"))


def record_bytes(record: Column) -> Column:
    return F.coalesce(record.cast("binary"), F.lit(b""))


def record_digest(record: Column) -> Column:
    return F.unhex(F.sha2(record_bytes(record), 256))


def record_length(record: Column) -> Column:
    return F.octet_length(record_bytes(record)).cast("long")


def lay_out(hashed: DataFrame, archive: Column, order: list[Column]) -> DataFrame:
    """Give hashed records (with a ``length``) their archive and offset, one
    after the other by ``order``; only lengths and digests cross the shuffle.
    An archive is a file's worth of records (about 1 GB), never a host."""
    w = W.partitionBy("archive").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return hashed.withColumn("archive", archive).withColumn("offset", F.sum("length").over(w) - F.col("length"))


def digests(records: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """``archive, offset, length, digest`` (SHA-256) and the ``extra`` columns of
    records ``(archive, offset, record)`` as read from archive files."""
    return records.select(
        "archive", F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"),
        record_length(F.col("record")).alias("length"), record_digest(F.col("record")).alias("digest"),
        *(extra or []),
    )


@dataclass
class Tree:
    """``levels[0]`` holds the leaves, the last one the roots; rows are
    ``(archive, node, hash, records)``."""

    records: DataFrame
    levels: list[DataFrame]
    range_bytes: int
    fanout: int


def _node(df: DataFrame, parent: Column, line: Column, order: Column, count: Column) -> DataFrame:
    return df.groupBy("archive", parent.alias("node")).agg(
        F.sort_array(F.collect_list(F.struct(order.alias("o"), line.alias("l")))).alias("c"),
        F.sum(count).alias("records"),
    ).select(
        "archive", "node",
        F.unhex(F.sha2(F.array_join(F.transform("c", lambda x: x["l"]), "\n").cast("binary"), 256)).alias("hash"),
        "records",
    )


def depth(records: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> int:
    """Levels above the leaves that cover the largest offset (one small job)."""
    last = records.agg(F.max("offset")).first()[0] or 0
    span, levels = range_bytes, 0
    while span <= last:
        span, levels = span * fanout, levels + 1
    return levels


def tree(records: DataFrame, levels: int, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> Tree:
    """Merkle tree of every archive in ``records`` (a result of ``digests``)."""
    line = F.concat_ws(" ", F.col("offset").cast("string"), F.col("length").cast("string"), F.hex("digest"))
    rows = [_node(records, _range(range_bytes), line, F.col("offset"), F.lit(1))]
    rows[0] = materialise(rows[0], "fixity-leaves")
    for _ in range(levels):
        below = rows[-1]
        line = F.concat_ws(" ", F.col("node").cast("string"), F.hex("hash"))
        rows.append(_node(below, F.floor(F.col("node") / fanout), line, F.col("node"), F.col("records")))
    return Tree(records, rows, range_bytes, fanout)


def _range(range_bytes: int) -> Column:
    return F.floor(F.greatest(F.col("offset"), F.lit(0)) / range_bytes)


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Nodes whose hashes differ or that one side lacks."""
    one = a.select(F.col("archive").alias("a1"), F.col("node").alias("n1"), F.col("hash").alias("h1"))
    two = b.select(F.col("archive").alias("a2"), F.col("node").alias("n2"), F.col("hash").alias("h2"))
    both = one.join(two, F.col("a1").eqNullSafe(F.col("a2")) & (F.col("n1") == F.col("n2")), "full")
    return both.where(~F.col("h1").eqNullSafe(F.col("h2"))).select(
        F.when(F.col("n1").isNull(), F.col("a2")).otherwise(F.col("a1")).alias("archive"),
        F.coalesce("n1", "n2").alias("node"),
    )


def _below(level: DataFrame, nodes: DataFrame, key: Column) -> DataFrame:
    """Rows of ``level`` whose ``key`` is one of ``nodes``."""
    bad = nodes.select(F.col("archive").alias("_a"), F.col("node").alias("_n"))
    return level.join(bad, F.col("archive").eqNullSafe(F.col("_a")) & (key == F.col("_n")), "left_semi")


def audit(good: Tree, copy: Tree) -> DataFrame:
    """Damaged records of ``copy`` against ``good``: ``archive, offset``,
    ``leaf`` (offset range), ``problem`` (``changed``, ``missing``, ``extra``),
    both lengths and both digests (null where a side has no record there)."""
    nodes = _differing(good.levels[-1], copy.levels[-1])
    for one, two in zip(good.levels[-2::-1], copy.levels[-2::-1], strict=True):
        up = F.floor(F.col("node") / good.fanout)
        nodes = _differing(_below(one, nodes, up), _below(two, nodes, up))

    def found(t: Tree, tag: str) -> DataFrame:
        bad = _below(t.records, nodes, _range(t.range_bytes))
        return bad.groupBy("archive", "offset", "length", "digest").agg(F.count(F.lit(1)).alias("times")).select(
            F.col("archive").alias(f"archive_{tag}"), F.col("offset").alias(f"offset_{tag}"),
            F.col("length").alias(f"length_{tag}"), F.col("digest").alias(f"digest_{tag}"),
            F.col("times").alias(f"times_{tag}"),
        )

    same = F.col("archive_a").eqNullSafe(F.col("archive_b")) & (F.col("offset_a") == F.col("offset_b"))
    exact = same & (F.col("digest_a") == F.col("digest_b")) & (F.col("length_a") == F.col("length_b")) & (
        F.col("times_a") == F.col("times_b"))
    one, two = found(good, "a"), found(copy, "b")
    one, two = one.join(two, exact, "left_anti"), two.join(one, exact, "left_anti")
    both = one.join(two, same, "full")
    offset = F.coalesce("offset_a", "offset_b")
    return both.select(
        F.when(F.col("offset_a").isNull(), F.col("archive_b")).otherwise(F.col("archive_a")).alias("archive"),
        offset.alias("offset"), F.floor(F.greatest(offset, F.lit(0)) / good.range_bytes).alias("leaf"),
        F.when(F.col("offset_b").isNull(), "missing").when(F.col("offset_a").isNull(), "extra")
        .otherwise("changed").alias("problem"),
        F.col("length_a").alias("length_good"), F.col("length_b").alias("length_copy"),
        F.lower(F.hex("digest_a")).alias("digest_good"), F.lower(F.hex("digest_b")).alias("digest_copy"),
    )
