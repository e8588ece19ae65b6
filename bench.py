"""Times the registered queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 2, best counts),
BENCH_QUERIES (comma-separated names or prefixes, default all headline queries).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfspark.session import local_session  # noqa: E402
from shelfspark.workload import load  # noqa: E402

HEADLINE = (
    "a2_price_summary a5_histogram a6_box_stats a7_source_comparison a9_source_shares a11_keyword_performance "
    "a17_run_rollup a20_keyword_outcomes b1_blocked_pages b3_challenge_score b4_challenge_verdict d3_mark_duplicates "
    "d6_moving_average f1_clean_text_documents f2_extract_price g2_recommendations h1_price_changes k3_k4_priority_order "
    "r1_analysis_scan r2_r4_listing_files s1_stream_ingest s4_stream_price_changes t1_iqr_outliers_by_source t2_z_outliers "
    "t3_daily_trend t5_weekly_trend v1_validate v2_clean_frame v6_v7_v8_data_quality w1_j1_upsert w2_price_history_append "
    "w12_statistics_document x1_amazon_cards x4_generic_cards x7_rendered_ebay_cards x12_page_links"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = os.environ.get("BENCH_QUERIES")
    queries, _ = load()
    names = HEADLINE if not wanted else [q for q in queries if any(q.startswith(w) for w in wanted.split(","))]
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    for name in names:
        best = None
        for _ in range(runs):
            started = time.perf_counter()
            # The noop sink computes every column of every row without collecting anything.
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - started
            best = seconds if best is None else min(best, seconds)
        timings[name] = round(best, 3)
        print(f"{name}: {best:.3f}", file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "total_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
