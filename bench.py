"""Headline queries, timed one after the other; prints one JSON line."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from deltascope.queries import catalog
from deltascope.session import local_session

HEADLINES = [
    "version_pairs", "file_drift", "pair_state", "review_score", "findings", "feature_table", "baseline_rules", "scorer_metrics",
    "chronological_split", "priority_queue", "code_lines", "document_endpoints", "network_drift", "page_pair_summary", "intake_rules",
    "dataset_distributions", "repeated_package_members", "split_leakage", "record_validation", "manifest_projection", "agreement_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = local_session("bench", cores, partitions=max(int(cores), 1))
    spark.sparkContext.setLogLevel("ERROR")
    # One pass over a small folder loads classes and starts the Python workers; it is not timed.
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").count().write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINES:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
