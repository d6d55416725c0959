"""Summarise the physical plan of every registered query as a Markdown table.

usage: python scripts/plan_report.py [sf_dir] > PLANS.md

Per key: shuffles (Exchange hashpartitioning / rangepartitioning / single),
broadcasts, join strategies, partial aggregates, windows with a partial
group limit, top-k nodes, Python nodes, and the columns each scan reads.
The plan is the AQE initial plan (before runtime re-optimisation).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dinelens.plans.registry import REGISTRY  # noqa: E402
from dinelens.plans.warehouse import Warehouse  # noqa: E402
from dinelens.session import local_session  # noqa: E402


def summarise(plan: str) -> dict[str, str]:
    scans = {}
    for m in re.finditer(r"FileScan parquet \[([^\]]*)\].*?Location: InMemoryFileIndex\(1 paths\)\[([^\]]*)\]", plan):
        table = os.path.basename(m.group(2)).removesuffix(".parquet")
        scans.setdefault(table, set()).update(c.split("#")[0] for c in m.group(1).split(","))
    joins = re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)[^\n]*?(Inner|LeftOuter|LeftAnti|LeftSemi|RightOuter|FullOuter)", plan)
    return {
        "hash_shuffles": str(len(re.findall(r"Exchange hashpartitioning", plan))),
        "range_shuffles": str(len(re.findall(r"Exchange rangepartitioning", plan))),
        "broadcasts": str(len(re.findall(r"BroadcastExchange", plan))),
        "joins": ", ".join(f"{a.replace('HashJoin', 'HJ').replace('SortMergeJoin', 'SMJ')} {b}" for a, b in joins) or "-",
        "partial_agg": str(len(re.findall(r"functions=\[partial_", plan))),
        "topk": "yes" if "TakeOrderedAndProject" in plan else "-",
        "group_limit": "partial" if re.search(r"WindowGroupLimit.*Partial", plan) else "-",
        "python": "yes" if re.search(r"MapInPandas|ArrowEvalPython|BatchEvalPython", plan) else "-",
        "scans": "; ".join(f"{t}({len(c)})" for t, c in sorted(scans.items())),
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    w = Warehouse.shared(spark, sf_dir)
    cols = ["hash_shuffles", "range_shuffles", "broadcasts", "joins", "partial_agg", "topk", "group_limit", "python", "scans"]
    print(f"# Physical plans of the registered queries ({os.path.basename(sf_dir)}, AQE initial plans)\n")
    print("Generated by `scripts/plan_report.py`. `scans` lists each base table with the number of columns read.\n")
    print("| key | " + " | ".join(cols) + " |")
    print("|---|" + "---|" * len(cols))
    for key, fn in REGISTRY.items():
        df = fn(w)
        plan = df._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"| {key} | " + " | ".join(s[c] for c in cols) + " |")


if __name__ == "__main__":
    main()
