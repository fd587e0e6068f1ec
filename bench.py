"""Time the headline queries and print one JSON line.

Each query is run to a ``noop`` sink, so every row and column is computed.  One
run warms the JVM up; the value of a query is the median of the next runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark  # noqa: E402

from catalog import entries  # noqa: E402
from vendaflux.plans.session import build_session  # noqa: E402

HEADLINE = (
    "sales_base", "sales_cohort_base", "sales_discount_base",
    "cohort_retention", "cohort_summary", "retention_matrix", "lifecycle_counts", "lifecycle_status",
    "abc_classify", "abc_client_report", "abc_summary", "abc_by_channel", "abc_migration", "gini",
    "product_delta", "product_month", "discount_correlation",
    "gap_monthly", "gap_detail", "gap_grouping_sets", "decompose_gap", "decompose_mix",
    "dq_sales", "insights_gap",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench",
                          extra={"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    todo, times, cold = entries(), {}, {}
    for name in names:
        took = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            todo[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        cold[name] = round(took[0], 3)
        times[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({
        "metric": "total_seconds_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "first_run": cold, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cpus, "spark": pyspark.__version__,
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
    }))


if __name__ == "__main__":
    main()
