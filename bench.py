"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query is built and run to the end (all rows produced, nothing kept) once to warm up, then
BENCH_RUNS times (default 3); the median counts.
"""

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = [
    "repo_snapshot", "sample_walk_order", "directory_tree", "language_stats", "code_metrics", "secret_scan_summary",
    "secret_findings", "entropy_findings", "search_context", "bounded_read", "batch_read_status", "manifest_dependencies",
    "dependency_inventory", "commit_summary", "churn_top20", "release_readiness", "risk_score", "write_plan", "bulk_replace",
    "rollback_apply", "three_way_conflicts", "promote_forced", "audit_build", "audit_verify", "rate_limit", "idle_sessions",
    "session_cap", "plugin_preflight", "portfolio_scorecard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="codequarry-bench-")).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from catalog import QUERIES

    seconds = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
