"""Bench: wall seconds per query at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced with the ``noop`` sink (full execution, no collect),
after one warm-up query; median of ``$BENCH_REPS`` (3) runs per query.
Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from casepipe.session import local_session  # noqa: E402

HEADLINE = [
    "case_summary",
    "numbered_paragraphs",
    "consolidate_labels",
    "group_split",
    "cover_fill",
    "main_paragraphs",
    "akn_main_paragraphs",
    "akn_segments",
    "iob_documents",
    "ner_metrics",
    "multilabel_metrics",
    "batch_label",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or (HEADLINE if os.environ.get("BENCH_ALL") != "1" else None)
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    from casepipe.plans.adapters import SPREAD
    from casepipe.plans.catalog import QUERIES

    spark.conf.set(SPREAD, str(spark.sparkContext.defaultParallelism))  # the tables are single row groups

    names = names or list(QUERIES)
    QUERIES["case_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    times: dict[str, float] = {}
    reps = int(os.environ.get("BENCH_REPS", "3"))
    for n in names:
        runs = []
        for _ in range(reps):
            t0 = time.perf_counter()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[n] = round(statistics.median(runs), 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
