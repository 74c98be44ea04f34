"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import math
from collections import Counter

import duckdb
import pytest

from parasift.plans import load_all
from parasift.sources.tables import TABLES, table_path

QUERIES, ORACLES = load_all()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con(sf0001):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf0001, t)}')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name, sf0001):
    df = QUERIES[name](spark, sf0001)
    cols = df.columns
    got = Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    res = con.sql(ORACLES[name])
    ocols = res.columns
    assert sorted(cols) == sorted(ocols)
    idx = [ocols.index(c) for c in cols]
    exp = Counter(tuple(_norm(r[i]) for i in idx) for r in res.fetchall())
    assert got == exp


def test_round_wrapper_keeps_literals_and_nests():
    from parasift.plans.registry import _positive_zero_rounds as f

    got = f("SELECT round(x, 6) AS a, '(round(' AS c, around(y), round(round(z, 2) + 1, 6) FROM t")
    assert got == ("SELECT (round(x, 6) + 0.0) AS a, '(round(' AS c, around(y), "
                   "(round((round(z, 2) + 0.0) + 1, 6) + 0.0) FROM t")


def test_oracle_rounding_gives_positive_zero(con):
    from parasift.plans.registry import _positive_zero_rounds as f

    assert str(con.sql(f("SELECT round(-1e-9, 6) AS z")).fetchall()[0][0]) == "0.0"
