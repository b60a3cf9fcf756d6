"""Wall seconds of the headline queries, warm, at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES  # noqa: E402

HEADLINE = (
    "report_orders_vs_lines",
    "report_three_sources",
    "report_fallback_key",
    "report_refresh",
    "dashboard_orders",
    "collection_processed",
    "upsert_orders",
    "profile_lineitem",
    "dq_report",
    "dq_violations",
    "formula_chain",
    "chain_levels",
    "duplicate_events",
    "parsed_dates",
    "load_settlements",
    "streamed_upsert",
)


def run(query, spark, folder) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tallybook-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        query = QUERIES[name]
        run(query, spark, folder)  # warm-up
        seconds[name] = round(min(run(query, spark, folder) for _ in range(2)), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps({
            "metric": "total wall time of the headline queries, warm",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": seconds,
            "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            "cpus": int(cpus),
        })
    )


if __name__ == "__main__":
    main()
