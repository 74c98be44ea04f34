"""Chat formatting into budgeted training windows, DataFrame functions only.

Input rows are turns ``(conv_id, turn, role, text)``.  A turn costs
``ceil(bytes / bytes_per_token)`` tokens of its formatted form.  Prefix sums of
these costs cut a conversation into turn-aligned spans; each window holds

* the system turn (a first turn of role ``system``), repeated in every window,
* limited history: the last turns of the preceding span that fit in
  ``history`` tokens, repeated with their loss masked out,
* the turns of its own span; their assistant texts carry the loss.

Spans: with stride ``S = (budget - history - system) / 2`` a turn of at most S
tokens belongs to span ``floor((prefix_sum - 1) / S)``, so a span holds at most
2 S tokens; a longer turn is a span of its own and is kept whole, the only case
in which a window exceeds the budget.

Template: ``<turn ROLE>TEXT</turn>\\n``.  Inside roles and texts ``\\``, ``<``
and ``>`` are written ``\\s``, ``\\l`` and ``\\g``; no marker can occur in a text
and the escape is undone by three plain replacements.

Prefix sums run in two levels (blocks of a conversation, then rows of a block),
so a conversation with a large share of all rows is not one window partition.

Edge cases: null text or role counts as empty; a null conversation id is a
conversation; rows are ordered by (turn, role, text), nulls first, and equal
rows are kept as separate turns; an empty table gives no windows; extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_or_empty

BUDGET, HISTORY, BYTES_PER_TOKEN, BLOCK = 2048, 256, 4, 64
TURN_END = "</turn>\n"


def escape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\"), F.lit("\\s"))
    c = F.replace(c, F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    c = F.replace(c, F.lit("\\l"), F.lit("<"))
    c = F.replace(c, F.lit("\\g"), F.lit(">"))
    return F.replace(c, F.lit("\\s"), F.lit("\\"))


def _numbered(turns: DataFrame, bytes_per_token: int) -> DataFrame:
    """Turns with their cost, position and inclusive prefix sum."""
    head = F.concat(F.lit("<turn "), escape(F.col("role")), F.lit(">"))
    body = escape(F.col("text"))
    rows = turns.select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("turn"),
        text_or_empty(F.col("role")).alias("role"), text_or_empty(F.col("text")).alias("text"),
    ).select(
        "conv", "turn", "role", "text",
        F.floor(F.coalesce(F.col("turn").cast("long"), F.lit(-1)) / BLOCK).alias("block"),
        head.alias("head"), body.alias("body"),
    ).withColumn(
        "cost",
        F.ceil((F.octet_length("head") + F.octet_length("body") + len(TURN_END)) / bytes_per_token).cast("long"),
    )
    by_block = W.partitionBy("conv").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = rows.groupBy("conv", "block").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").alias("c"),
    ).select(
        "conv", "block",
        F.coalesce(F.sum("n").over(by_block), F.lit(0)).alias("n0"),
        F.coalesce(F.sum("c").over(by_block), F.lit(0)).alias("c0"),
    )
    inside = W.partitionBy("conv", "block").orderBy("turn", "role", "text")
    placed = rows.withColumn("i", F.row_number().over(inside)).withColumn(
        "c", F.sum("cost").over(inside.rowsBetween(W.unboundedPreceding, 0))
    )
    return placed.join(
        blocks.withColumnsRenamed({"conv": "_conv", "block": "_block"}),
        F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")),
    ).select(
        "conv", "role", "head", "body", "cost",
        (F.col("n0") + F.col("i")).alias("pos"), (F.col("c0") + F.col("c")).alias("upto"),
    )


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY,
            bytes_per_token: int = BYTES_PER_TOKEN) -> DataFrame:
    """One row per window: ``conv_id``, ``window`` (ordered, with gaps),
    ``formatted``, ``n_context`` (leading system and history turns),
    ``loss_spans`` (array of ``start``, ``length`` in code points of
    ``formatted``, start from 0), ``tokens``."""
    rows = _numbered(turns, bytes_per_token)
    system = rows.where((F.col("pos") == 1) & (F.col("role") == "system")).select(
        F.col("conv").alias("sys_conv"), F.col("head").alias("sys_head"), F.col("body").alias("sys_body"),
        F.col("cost").alias("sys_cost"),
    )
    rows = rows.join(system, F.col("conv").eqNullSafe(F.col("sys_conv")), "left")
    stride = F.greatest(
        F.lit(1).cast("long"),
        F.floor((F.lit(budget - history) - F.coalesce("sys_cost", F.lit(0))) / 2).cast("long"),
    )
    rows = rows.withColumn("stride", stride).withColumn(
        "win",
        2 * F.floor((F.col("upto") - 1) / F.col("stride")).cast("long")
        + F.when(F.col("cost") > F.col("stride"), 0).otherwise(1),
    )
    spans = rows.groupBy("conv", "win").agg(F.max("upto").alias("end"), F.min("pos").alias("from_pos"))
    spans = spans.withColumn("next_win", F.lead("win").over(W.partitionBy("conv").orderBy("win"))).select(
        F.col("conv").alias("_conv"), F.col("win").alias("_win"), "end", "from_pos", "next_win"
    )
    rows = rows.join(spans, F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("win") == F.col("_win")))
    is_system = F.col("sys_cost").isNotNull() & (F.col("pos") == 1)
    before_end = F.col("end") - F.col("upto") + F.col("cost")
    piece = lambda win, kind: F.struct(win.alias("win"), F.lit(kind).alias("kind"))
    uses = F.array(
        piece(F.col("win"), 2),
        F.when(F.col("next_win").isNotNull() & (before_end <= history) & ~is_system, piece(F.col("next_win"), 1)),
        F.when((F.col("pos") == F.col("from_pos")) & F.col("sys_cost").isNotNull() & (F.col("pos") > 1),
               piece(F.col("win"), 0)),
    )
    used = rows.select("conv", "pos", "role", "head", "body", "cost", "sys_head", "sys_body", "sys_cost",
                       F.explode(F.filter(uses, lambda x: x.isNotNull())).alias("use"))
    is_sys = F.col("use.kind") == 0
    pieces = used.select(
        "conv", F.col("use.win").alias("win"), F.col("use.kind").alias("kind"),
        F.when(is_sys, F.lit(0)).otherwise(F.col("pos")).alias("pos"),
        F.when(is_sys, F.col("sys_head")).otherwise(F.col("head")).alias("head"),
        F.when(is_sys, F.col("sys_body")).otherwise(F.col("body")).alias("body"),
        F.when(is_sys, F.col("sys_cost")).otherwise(F.col("cost")).alias("cost"),
        ((F.col("use.kind") == 2) & (F.col("role") == "assistant")).alias("loss"),
    )
    length = F.char_length("head") + F.char_length("body") + len(TURN_END)
    order = W.partitionBy("conv", "win").orderBy("kind", "pos")
    pieces = pieces.withColumn("start", F.sum(length).over(order) - F.char_length("body") - len(TURN_END))
    return pieces.groupBy("conv", "win").agg(
        F.sort_array(F.collect_list(F.struct(
            "kind", "pos", F.concat("head", "body", F.lit(TURN_END)).alias("s"), "loss", "start",
            F.char_length("body").cast("long").alias("length"),
        ))).alias("p"),
        F.sum("cost").alias("tokens"),
    ).select(
        F.col("conv").alias("conv_id"), F.col("win").alias("window"),
        F.array_join(F.transform("p", lambda x: x["s"]), "").alias("formatted"),
        F.size(F.filter("p", lambda x: x["kind"] < 2)).alias("n_context"),
        F.transform(
            F.filter("p", lambda x: x["loss"]),
            lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length")),
        ).alias("loss_spans"),
        "tokens",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Windows parsed again: ``new_turns`` (array of ``role``, ``text``) without
    the repeated context, and ``loss_texts`` under the loss mask, unescaped."""
    parts = F.split(F.col("formatted"), TURN_END)
    own = F.slice(parts, F.col("n_context") + 1, F.size(parts) - 1 - F.col("n_context"))

    def turn(s):
        head = F.substring_index(s, ">", 1)
        return F.struct(
            unescape(F.substring(head, F.lit(7), F.char_length(head))).alias("role"),
            unescape(F.substring(s, F.char_length(head) + 2, F.char_length(s))).alias("text"),
        )

    text = F.col("formatted")
    return formatted.select(
        "conv_id", "window", "tokens", F.char_length("formatted").cast("long").alias("formatted_chars"),
        F.transform(own, turn).alias("new_turns"),
        F.transform(
            "loss_spans",
            lambda x: unescape(F.substring(text, (x["start"] + 1).cast("int"), x["length"].cast("int"))),
        ).alias("loss_texts"),
    )
