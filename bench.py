"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is executed in full with the ``noop`` sink (no collect to the
driver); ``value`` is the sum of the per-query wall times (planning
included). One small untimed job first warms up the JVM and Python workers.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "analyze_logs",              # E1 funnel over documents + pages (no decode)
    "funnel_documents_decoded",  # E1 clusters with the full decode chain
    "ioc_all",                   # X1 all 11 indicator types over seclog lines
    "ioc_reference_decode",      # X1 + X6-X8 over seclog lines
    "extract_iocs_documents",    # E2 over whole documents
    "run_summary",               # A9 with verdicts (J4) over seclog logs
    "enrich_events",             # J6 threat-event enrichment
    "kb_upsert",                 # E4 KB indexing: dedup, 500/50 chunks, upsert
    "kb_topk",                   # J3 exact cosine top-k over embeddings
]


def main() -> None:
    from seclog.plans.queries import queries
    from seclog.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="seclog-bench")
    qs = queries()
    names = sys.argv[1:] or HEADLINE
    # untimed warm-up: JVM start-up, JIT and the Python worker pool are not query cost
    spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("count(*)", "max(ts)").collect()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total_sec",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(m.group(1)) if m else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
