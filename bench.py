"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickloom.catalog import load  # noqa: E402
from tickloom.session import local_session  # noqa: E402

HEADLINE = (
    "t01_resample_dense_1h", "t03_multi_interval", "t08_merge_key", "w11_rolling_slope", "r01_ema_daily", "r03_macd",
    "f01_ema_trend", "f07_volatility", "f08_volume_daily", "f12_learning_set", "g03_macd_bb", "g09_triple_ema",
    "j01_asof", "j08_band", "a02_report", "a05_screener_24", "a08_regression", "b02_barrier", "b04_summary", "b08_sweep",
    "l06_vwap", "l13_quotes", "p01_fill_ledger", "p03_decision", "qj_correlation", "qa_cointegration", "qe_lead_lag",
    "f04_series_peaks", "g11_xgrid", "r08_supertrend", "m04_forest_report", "qk_clusters_at_height",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus))
    registry = load()
    # start-up of the JVM's and Python's workers is not a query's time
    registry["u03_row_function"].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if name not in registry:
            continue
        start = time.time()
        registry[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
