"""Write PLANS.md: scans, exchanges, windows and Python steps of every
registered query's initial plan, and some plans in full.

    python scripts/plans.py [sf_dir]
"""
from __future__ import annotations

import re
import sys

ROOT = __file__.rsplit("/scripts/", 1)[0]
sys.path.insert(0, ROOT)

FULL = ["f09_features", "j08_baseline_backoff", "r12_eprv_rvaa", "r10_heuristic_candidates", "a25_decision_quality"]
SLOW = {"m03_gbt_metrics", "m06_feature_importance", "m06_gbt_shift_importance", "m09_rolling_validation", "r06_recommend_with_model"}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    from moundflow.plans.queries import REGISTRY
    from moundflow.session import local_session
    spark = local_session()
    lines = ["# Plans", "", f"Initial physical plans at `{sf.rsplit('/', 1)[-1]}` (adaptive execution may reuse or broadcast at run time); tables that a",
             "query writes once are read as Parquet in its plan.  Made by `scripts/plans.py`; queries that fit trees are left out.", "",
             "| query | scans | exchanges | broadcasts | windows | joins | Python |", "|---|---|---|---|---|---|---|"]
    full = []
    for name, q in REGISTRY.items():
        if name in SLOW:
            continue
        text = q.spark(spark, sf)._jdf.queryExecution().executedPlan().toString()
        text = re.sub(r"#\d+L?", "", text).split("== Initial Plan ==")[-1]

        def count(*words):
            return sum(len(re.findall(rf"\b{w}\b", text)) for w in words)
        lines.append(f"| `{name}` | {count('FileScan', 'Scan ExistingRDD')} | {count('Exchange')} | {count('BroadcastExchange')} | {count('Window')} | "
                     f"{count('SortMergeJoin', 'BroadcastHashJoin', 'ShuffledHashJoin', 'BroadcastNestedLoopJoin')} | "
                     f"{count('MapInArrow', 'MapInPandas', 'ArrowEvalPython')} |")
        if name in FULL:
            body = "\n".join(x[:160] for x in text.splitlines() if x.strip())
            full += ["", f"## {name}", "", "```", body, "```"]
    with open(f"{ROOT}/PLANS.md", "w") as f:
        f.write("\n".join(lines + full) + "\n")


if __name__ == "__main__":
    main()
