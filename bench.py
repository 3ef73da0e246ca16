"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder with the tables, BENCH_CPUS the local cores. Every
query is run once to the end into a sink that discards the rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidegrid.plans.features import feature_table, model_table  # noqa: E402
from tidegrid.queries import QUERIES  # noqa: E402
from tidegrid.queries.base import SPLIT_DATE  # noqa: E402
from tidegrid.session import local_session  # noqa: E402
from tidegrid.sources.adapters import HOURLY, hourly_events  # noqa: E402

# the registered forms of these two round every column for the comparison with SQL
TABLES = {
    "feature_table": lambda spark, folder: feature_table(hourly_events(spark, folder), HOURLY),
    "model_table": lambda spark, folder: model_table(hourly_events(spark, folder), HOURLY, SPLIT_DATE),
}
HEADLINE = [
    *TABLES, "features_for_range", "f01_demand_lags", "f03_rolling_mean", "f04_rolling_std",
    "f07_lookback", "f10_filter_bank", "c01_chronological", "c09_stratified_split", "c10_tail_validation",
    "g01_missing_counts", "g08_describe", "g09_correlation_wide", "g12_scaler_fit", "g13_scale_and_back",
    "g17_residual_histogram", "h04_mape_skip_zero", "h10_gap_verdict", "b08_predictions_wide", "j01_column_bind",
    "i08_mixup_pairs", "i09_mixup_batches",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    run(QUERIES["c02_target_copy"](spark, folder))  # start the JVM's compilers
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        run(TABLES.get(name, QUERIES[name])(spark, folder))
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
