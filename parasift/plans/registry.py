"""Registry of named queries and their DuckDB oracle SQL.

Each registered query takes ``(spark, sf_dir)`` and returns a DataFrame over
the whole input tables; the oracle (when one exists) is ANSI-ish SQL that
DuckDB runs on the same parquet tables registered as views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def _positive_zero_rounds(sql: str) -> str:
    """Wrap every ``round(...)`` call as ``(round(...) + 0.0)``.

    DuckDB rounds a tiny negative number to ``-0.0`` where Spark gives
    ``0.0``; adding ``+0.0`` turns a negative zero into a positive one and
    leaves every other value unchanged.  String literals are left alone.
    """
    out, i, n, quote = [], 0, len(sql), False
    while i < n:
        c = sql[i]
        if c == "'":
            quote = not quote
        starts = (not quote and sql.startswith("round(", i)
                  and (i == 0 or not (sql[i - 1].isalnum() or sql[i - 1] == "_")))
        if not starts:
            out.append(c)
            i += 1
            continue
        depth, k, q = 0, i + 5, False
        while k < n:
            ch = sql[k]
            if ch == "'":
                q = not q
            elif not q and ch == "(":
                depth += 1
            elif not q and ch == ")":
                depth -= 1
                if depth == 0:
                    break
            k += 1
        out.append("(round(" + _positive_zero_rounds(sql[i + 6:k]) + ") + 0.0)")
        i = k + 1
    return "".join(out)


def register(name: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = _positive_zero_rounds(oracle.strip())
        return fn

    return deco
