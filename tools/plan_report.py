"""Summarise the physical plan of every registered query into PLANS.md.

usage: python tools/plan_report.py [sf_dir] > PLANS.md
Counts the operators that matter at scale and lists each scan's read schema.
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from tracefuse.plans.queries import QUERIES  # noqa: E402
from tracefuse.session import get_session  # noqa: E402

# wide fits: minutes of training for a plan of one scoring projection
SKIP = {"lr_scores", "rf_scores", "model_sweep", "feature_importance", "overfit_gap"}
OPS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition",
       "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "BroadcastNestedLoopJoin",
       "CartesianProduct", "HashAggregate", "SortAggregate", "ObjectHashAggregate", "Window",
       "WindowGroupLimit", "MapInPandas", "MapInArrow", "BatchEvalPython", "ArrowEvalPython", "Generate"]


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = get_session("local[8]", 8)
    print("# Physical plans of the registered queries\n")
    print(f"Generated by `tools/plan_report.py` at `{sf}` (before AQE re-planning; "
          "checkpointed inputs of exact-rank operators appear as scans of the checkpoint).\n")
    print("| query | " + " | ".join(o.replace("Exchange ", "X-") for o in OPS) + " |")
    print("| --- |" + " --- |" * len(OPS))
    schemas = {}
    for name, fn in QUERIES.items():
        if name in SKIP:
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = [str(len(re.findall(re.escape(o) + r"\b", plan))) for o in OPS]
        print(f"| {name} | " + " | ".join(counts) + " |")
        schemas[name] = sorted(set(re.findall(r"FileScan parquet \[[^\]]*\].*?Location: [^\[]*\[([^\]]*)\].*?"
                                              r"ReadSchema: (struct<[^>]*>?)", plan)))
    print("\n## Scans (file, read schema)\n")
    for name, scans in schemas.items():
        for loc, rs in scans:
            print(f"* `{name}`: `{loc.rsplit('/', 1)[-1]}` -> `{rs}`")


if __name__ == "__main__":
    main()
