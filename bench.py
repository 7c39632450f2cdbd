"""Time the headline queries. Prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query is written to the no-op
sink, so all its rows and columns are computed; the best of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rillflow import build_session  # noqa: E402
from rillflow.catalog import catalog  # noqa: E402

HEADLINE = (
    "ingest_and_report", "stable_identity", "canonical_fingerprint", "classify_mutations",
    "classify_documents", "upsert_documents", "upsert_mutations", "enqueue_documents",
    "delivery_fold", "delivery_outcomes", "ready_deliveries", "sink_snapshot", "run_outcomes",
    "source_health", "request_verdicts", "rate_limit_headers", "search_page", "search_totals",
    "html_text", "jsonfeed_signals", "rss_signals", "atom_signals", "mapped_signals",
    "issue_signals", "listing_posts", "story_signals", "skip_seen", "take_until_known", "take_new",
    "merge_seen", "merge_seen_continued", "drain_runs", "page_quarantine", "table_integrity",
    "metrics_lines",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = catalog()
    names = sys.argv[1:] or list(HEADLINE)
    times: dict[str, float] = {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            known[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
