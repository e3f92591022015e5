"""Summarise the physical plan of every query: scans, shuffles, join
strategies, windows and Python stages.  Writes a Markdown table to stdout.

Usage: python tools/plan_summary.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

EAGER = {"csv_roundtrip", "annotation_export_manifest", "annotation_read", "xml_scan", "multilabel_train_predict", "token_tagger"}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    only = sys.argv[2:]
    from casepipe.plans.catalog import QUERIES
    from casepipe.session import local_session

    spark = local_session()
    print("| query | scans | exchanges | broadcast joins | sort-merge joins | windows | python stages |")
    print("|---|---|---|---|---|---|---|")
    for name, fn in QUERIES.items():
        if (only and name not in only) or (not only and name in EAGER):
            continue
        plan = fn(spark, sf)._jdf.queryExecution().executedPlan().toString()
        c = {
            "scans": plan.count("Scan parquet") + plan.count("Scan binaryFile") + plan.count("Scan ExistingRDD"),
            "ex": plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange RoundRobin") + plan.count("Exchange SinglePartition"),
            "bhj": plan.count("BroadcastHashJoin") + plan.count("BroadcastNestedLoopJoin"),
            "smj": plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin"),
            "win": plan.count("Window ["),
            "py": plan.count("MapInPandas") + plan.count("PythonMapInArrow"),
        }
        print(f"| {name} | {c['scans']} | {c['ex']} | {c['bhj']} | {c['smj']} | {c['win']} | {c['py']} |", flush=True)


if __name__ == "__main__":
    main()
