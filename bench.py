"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints ONE JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is timed end to end (plan construction, including any bounded
scalar sub-jobs, plus a full execution into Spark's ``noop`` sink).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "B4_pareto_revenue_by_nation",
    "A12_histogram_extendedprice_20bins",
    "A13_box_summary_price_by_returnflag",
    "Q1_col_stats_lineitem",
    "Q3_column_profile_orders",
    "H2_dagostino_k2_lineitem",
    "C1_spearman_lineitem",
    "C5_pearson_matrix_lineitem",
    "H9_kruskal_satisfaction_by_dept",
    "W1_monthly_mean_order_price",
    "W6_row_half_trend_events",
    "B1_benchmark_lineitem",
    "B5_segment_health_by_category",
    "N20_gross_margin_finance",
    "N65_rep_ranking_sales",
    "K0_auto_clean_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    from tessera.session import build_session
    from tessera.plans import catalog

    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                          extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g")})
    catalog.load_all()
    # warm-up (JVM, session, Python workers) so the first timed query is not charged for start-up
    spark.read.parquet(os.path.join(sf_dir, "region.parquet")).count()
    names = only.split(",") if only else HEADLINE
    times = {}
    for name in names:
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
