"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tools/check_oracle.py [sf_dir] [name ...]
Compares row counts, column names and the multiset of rows (values
normalised: floats rounded to 6 digits).
"""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from parasift.plans import load_all  # noqa: E402
from parasift.session import local_session  # noqa: E402
from parasift.sources.tables import TABLES, table_path  # noqa: E402


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if hasattr(v, "tolist"):
        return norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    return v


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and os.path.isdir(sys.argv[1]) else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not os.path.isdir(a)]
    queries, oracles = load_all()
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf_dir, t)}')")
    bad = 0
    for name, fn in queries.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            cols = df.columns
            rows = [tuple(norm(r[c]) for c in cols) for r in df.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:800]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in oracles:
            print(f"ROWS {name}: {len(rows)} rows ({ts:.1f}s), no oracle")
            continue
        try:
            res = con.sql(oracles[name])
            ocols = res.columns
            orows = [tuple(norm(x) for x in r) for r in res.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {type(e).__name__}: {str(e)[:800]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL {name}: columns {cols} vs {ocols}")
            bad += 1
            continue
        idx = [ocols.index(c) for c in cols]
        orows = [tuple(r[i] for i in idx) for r in orows]
        a, b = Counter(rows), Counter(orows)
        if a == b:
            print(f"OK   {name}: {len(rows)} rows ({ts:.1f}s)")
        else:
            bad += 1
            only_s = list((a - b).elements())[:3]
            only_o = list((b - a).elements())[:3]
            print(f"FAIL {name}: {len(rows)} vs {len(orows)} rows; spark-only {only_s}; oracle-only {only_o}")
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
