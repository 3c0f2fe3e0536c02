"""Time the headline queries; prints one JSON line.

Every query is built and run in full: all rows of the result are computed and
dropped (``noop`` sink). The session is warmed up by one untimed pass over the
same queries; a figure is the median of the timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bankrec.plans import registry  # noqa: E402
from bankrec.session import build_session  # noqa: E402

HEADLINE = [
    "reconcile_summary", "reconcile_status", "audit_before", "plan_after_match", "ambiguous_cases",
    "daily_summary", "month_to_date", "balances_latest", "balances_asof", "cashflow_series",
    "forecast_linear", "backtest_simple", "forecast_cashflow", "backtest_all", "anomaly_flags",
    "similar_cases", "script_status", "log_errors", "transcripts", "import_plan",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", 8, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:
        run(name)
    seconds = {name: round(statistics.median(run(name) for _ in range(RUNS)), 3) for name in names}
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                      "cpus": int(cpus), "runs": RUNS}))
    spark.stop()


if __name__ == "__main__":
    main()
