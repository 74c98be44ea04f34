"""Compare column types of each registered query (Spark) and its oracle (DuckDB)."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from parasift.plans import load_all  # noqa: E402
from parasift.session import local_session  # noqa: E402
from parasift.sources.tables import TABLES, table_path  # noqa: E402

MAP = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
       "BooleanType": "BOOLEAN", "FloatType": "FLOAT"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    q, o = load_all()
    spark = local_session()
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{table_path(sf, t)}')")
    bad = 0
    for name in sorted(q):
        sch = {f.name: MAP.get(type(f.dataType).__name__, str(f.dataType)) for f in q[name](spark, sf).schema.fields}
        rel = con.sql(o[name])
        dtypes = {c: str(t) for c, t in zip(rel.columns, rel.types)}
        diff = {c: (sch.get(c), dtypes.get(c)) for c in set(sch) | set(dtypes) if sch.get(c) != dtypes.get(c)}
        if diff:
            bad += 1
            print(name, diff)
    print("type mismatches:", bad)


if __name__ == "__main__":
    main()
