"""Print, per registered query, the operators of its physical plan that matter at scale:
shuffles, broadcasts, join strategies, windows, and anything that must not appear (cartesian /
nested-loop joins, Python UDF evaluation).

usage: python tools/plan_audit.py [sf_dir] [name ...]
"""

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from wattlens import catalog  # noqa: E402
from wattlens.session import build_session  # noqa: E402

WATCH = ["Exchange hashpartitioning", "Exchange SinglePartition", "BroadcastExchange", "SortMergeJoin",
         "BroadcastHashJoin", "ShuffledHashJoin", "Window", "Expand", "Generate",
         "CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"]
BAD = {"CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "Exchange SinglePartition"}


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)] or list(catalog.QUERIES)
    spark = build_session("local[8]", 8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # static plan: what the planner commits to
    for name in names:
        plan = catalog.run(spark, name, sf)._jdf.queryExecution().executedPlan().toString()
        counts = {w: len(re.findall(re.escape(w), plan)) for w in WATCH}
        bad = [w for w in BAD if counts[w]]
        summary = ", ".join(f"{k.split()[-1] if k.startswith('Exchange') else k}={v}" for k, v in counts.items() if v)
        print(f"{'BAD ' if bad else 'ok  '}{name:28s} {summary}")
    spark.stop()


if __name__ == "__main__":
    main()
