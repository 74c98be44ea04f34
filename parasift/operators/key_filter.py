"""Rows whose key may be in a set, before any shuffle.

The keys are hashed to the bits of a bitmap of fixed size, held in rows of
4 KB that are broadcast: the size follows the ``rows`` asked for, never the
number of keys.  No row whose key is in the set is lost; of the others about
the share of bits set pass, so an exact join must follow.  With far more keys
than bits the filter lets everything pass and costs one look-up a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROW_BITS = 4096 * 8
#: 4 MB of bitmap, 33.5 million bits.
FILTER_ROWS = 1024


def _place(cols, rows: int) -> tuple[Column, Column]:
    h = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(rows * ROW_BITS))
    return F.floor(h / ROW_BITS).cast("int"), h % ROW_BITS


def key_bitmap(keys: DataFrame, cols, rows: int = FILTER_ROWS) -> DataFrame:
    """``_filter_row, _filter_bits``: at most ``rows`` rows of 4 KB.  Bit numbers, not bitmaps,
    are shuffled."""
    row, bit = _place(cols, rows)
    bits = keys.select(row.alias("_filter_row"), bit.alias("_filter_bit")).repartition("_filter_row")
    return bits.groupBy("_filter_row").agg(F.bitmap_construct_agg("_filter_bit").alias("_filter_bits"))


def may_hold(df: DataFrame, bitmap: DataFrame, cols, rows: int = FILTER_ROWS) -> DataFrame:
    """Rows of ``df`` whose key has its bit set (``rows`` as for the bitmap)."""
    row, bit = _place(cols, rows)
    found = df.withColumn("_filter_row", row).join(F.broadcast(bitmap), "_filter_row")  # at most rows x 4 KB
    byte = F.conv(F.hex(F.substring("_filter_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    mask = F.pow(F.lit(2), bit % 8).cast("int")
    return found.filter(byte.bitwiseAND(mask) != 0).select(*df.columns)
