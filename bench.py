"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print ONE JSON line.

Each query is executed to completion with the ``noop`` sink (every row computed, nothing collected)
after one warm-up pass over the stand-in scans; the reported value is the sum of per-query seconds.
``--all`` times every registered query instead of the headline set.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "ag67_venue_report", "ag66_bet_kpis", "ag72_top_players", "ag11_platform_profit", "ag17_month_over_month",
    "ag30_channel_hierarchy", "ag39_monthly_retention", "ag87_arbitrage_flags", "ag42_slot_anomaly",
    "ag78_high_frequency", "ag96_staff_ranking", "ag101_prepare_newreg", "ag106_agent_quality_board",
    "ag119_withdraw_kpis", "ag126_market_compare_agents", "io12_replace_by_dates", "io13_merge_snapshot",
    "cl06_drop_all_zero_rows", "cl25_blocks_to_records", "tx04_issue_label", "tx06_keyword_heat",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from tallyframe.plans.catalog import spark_queries
    from tallyframe.session import get_spark
    spark = get_spark(f"local[{cpus}]", max(cpus * 2, 8), app="tallyframe-bench",
                      extra={"spark.driver.memory": "16g"})
    qs = spark_queries()
    names = sorted(qs) if "--all" in sys.argv else [n for n in HEADLINE if n in qs]
    # warm-up: JVM, codegen and the OS file cache for the base tables
    for t in ("lineitem", "orders", "customer", "events", "conversations"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        t0 = time.perf_counter()
        qs[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))


if __name__ == "__main__":
    main()
