"""Time the headline queries: one JSON line on stdout."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from snagline.plans import QUERIES  # noqa: E402
from snagline.session import build_session  # noqa: E402

HEADLINE = [
    "fold_open", "fold_resolved", "open_by_severity", "triage_order", "ledger_profile",
    "scrub_documents", "pii_report", "quarantine_split", "reconcile_by_id", "validate_records",
    "session_counts", "anchor_events", "compact_stage1", "compact_stage2", "sweep_plan",
    "compact", "compact_stage3", "greedy_budget", "tracked_index", "enrich_clusters", "closer_evidence", "file_plan", "stream_open_set",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("OFF")
    # One small run first, so that the first query does not pay for the start.
    QUERIES["fold_open"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timed = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timed[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total", "value": round(sum(timed.values()), 3),
                "unit": "sec", "queries": timed, "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
