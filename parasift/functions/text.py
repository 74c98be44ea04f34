"""String column functions (all JVM-side built-ins, no Python per row).

Byte lengths use ``octet_length`` and code-point lengths use ``length``; the
reference measures some thresholds in UTF-8 bytes and its token estimate in
code points, and the two must not be mixed up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode White_Space as one regex class (Java and RE2 syntax alike).
WS = r"[\p{Z}\s\x0B\x{85}]"
# The same set as code points, for the set-based (non-regex) trim.
WS_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
WS_CHARS = "".join(chr(c) for c in WS_CODEPOINTS)

# The six entity replacements of the text cleaner, applied in
# this order (so "&amp;lt;" ends up as "<").
CLEAN_TEXT_ENTITIES = [
    ("&nbsp;", " "),
    ("&amp;", "&"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def utrim(col) -> Column:
    """Trim Unicode White_Space on both ends (plain ``trim`` strips spaces only).

    Uses the set form of ``trim`` (codegen'd, no regex)."""
    return F.trim(_c(col), F.lit(WS_CHARS))


def is_blank(col) -> Column:
    return utrim(col) == F.lit("")


def lines(col) -> Column:
    """Split on ``\\n`` and drop one trailing ``\\r`` per line."""
    return F.transform(F.split(_c(col), "\n", -1), lambda x: F.regexp_replace(x, "\r$", ""))


def collapse_ws(col) -> Column:
    """Split on whitespace runs and join the words with one space."""
    return utrim(F.regexp_replace(_c(col), rf"{WS}+", " "))


def clean_text(col) -> Column:
    """Entity replacement in fixed order, then whitespace collapse and trim."""
    out = _c(col)
    for src, dst in CLEAN_TEXT_ENTITIES:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return collapse_ws(out)


def words(col) -> Column:
    """Whitespace-separated words (no empty strings)."""
    return F.filter(F.split(utrim(_c(col)), rf"{WS}+", -1), lambda w: w != F.lit(""))


def wrap_text(col, width: int = 80) -> Column:
    """Greedy word wrap; the width is counted in UTF-8 bytes.

    A word is appended to the current line unless the line is non-empty and
    ``bytes(line) + bytes(word) + 1 > width``; an over-long word sits alone.
    """
    # Words are wrapped in blocks; the text so far is copied once a block, not
    # once a line.
    block = 256

    def line_step(acc, w):
        cur = acc["cur"]
        brk = (cur != F.lit("")) & (F.octet_length(cur) + F.octet_length(w) + F.lit(1) > F.lit(width))
        done = F.when(brk, F.concat(acc["done"], cur, F.lit("\n"))).otherwise(acc["done"])
        base = F.when(brk, F.lit("")).otherwise(cur)
        new_cur = F.when(base == F.lit(""), w).otherwise(F.concat(base, F.lit(" "), w))
        return F.struct(done.alias("done"), new_cur.alias("cur"))

    def block_step(acc, part):
        init = F.struct(F.lit("").alias("done"), acc["cur"].alias("cur"))
        return F.transform(
            F.array(F.aggregate(part, init, line_step)),
            lambda s: F.struct(F.concat(acc["out"], s["done"]).alias("out"), s["cur"].alias("cur")),
        )[0]

    def wrapped(w):
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(block))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda s: F.slice(w, s, F.lit(block)))
        init = F.struct(F.lit("").alias("out"), F.lit("").alias("cur"))
        whole = F.aggregate(parts, init, block_step, lambda acc: F.concat(acc["out"], acc["cur"]))
        return F.when(w.isNotNull(), whole)

    return F.transform(F.array(words(col)), wrapped)[0]


def estimate_tokens(col) -> Column:
    """Rough token count: code points divided by four, rounded down."""
    return F.floor(F.length(_c(col)) / F.lit(4)).cast("long")


def utf8_prefix(col, max_bytes, bound: int | None = None) -> Column:
    """Longest prefix of ``col`` whose UTF-8 encoding fits in ``max_bytes`` bytes.

    Cuts on a character boundary (never inside a multi-byte character).  The
    prefix length in code points is found by binary search (byte length is
    monotone in it); ``bound`` is an upper bound of ``max_bytes`` when that is
    a column (default 2^31), which fixes the number of search steps.
    """
    c = _c(col)
    if isinstance(max_bytes, Column):
        mb = max_bytes
        top = bound if bound is not None else (1 << 31)
    else:
        mb = F.lit(int(max_bytes))
        top = int(max_bytes)
    steps = max(1, int(top).bit_length() + 1)
    hi0 = F.least(F.length(c), F.greatest(mb, F.lit(0)))
    init = F.struct(F.lit(0).alias("lo"), hi0.alias("hi"))

    def step(s, _x):
        lo, hi = s["lo"], s["hi"]
        mid = ((lo + hi + F.lit(1)) / F.lit(2)).cast("int")
        fits = F.octet_length(F.substring(c, F.lit(1), mid)) <= mb
        return F.when(lo >= hi, s).when(
            fits, F.struct(mid.alias("lo"), hi.alias("hi"))
        ).otherwise(F.struct(lo.alias("lo"), (mid - F.lit(1)).alias("hi")))

    found = F.aggregate(F.array_repeat(F.lit(0), steps), init, step)
    return F.substring(c, F.lit(1), found["lo"])
