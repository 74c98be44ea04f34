"""Print the formatted physical plan of registered queries.

Usage: python tools/explain_plans.py [sf_dir] [name ...]
Summarises per query: number of shuffles (Exchange), broadcasts, Python
steps, and the ReadSchema of every scan, then prints the formatted plan.
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

from parasift.plans import load_all  # noqa: E402
from parasift.session import local_session  # noqa: E402


def main() -> None:
    args = sys.argv[1:]
    sf_dir = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    queries, _ = load_all()
    spark = local_session()
    for name in names or sorted(queries):
        df = queries[name](spark, sf_dir)
        plan = df._jdf.queryExecution().executedPlan().toString()
        shuffles = len(re.findall(r"Exchange hashpartitioning|Exchange RoundRobin|Exchange SinglePartition|Exchange rangepartitioning", plan))
        bcast = plan.count("BroadcastExchange")
        py = len(re.findall(r"MapInArrow|FlatMapGroupsInArrow|FlatMapGroupsInPandas|ArrowEvalPython|BatchEvalPython", plan))
        schemas = sorted(set(re.findall(r"ReadSchema: (struct<[^ ]*>)", plan)))
        print(f"== {name}: shuffles={shuffles} broadcasts={bcast} python_steps={py} scans={schemas}")
        if names:
            df.explain("formatted")
    spark.stop()


if __name__ == "__main__":
    main()
