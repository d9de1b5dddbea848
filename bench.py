"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line with seconds per query, the median of the runs."""

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from sparkrisk.plans import queries as engine  # noqa: E402

QUERIES = [
    "velocity_rules", "deviation_features", "novelty_features", "fanout_features", "hot_features", "rule_outcomes", "account_edges", "clustering_coefficient",
    "point_in_time_join", "deduplicated_scores", "alerts_by_hour", "feature_profile", "average_precision", "operating_point", "live_offline_parity", "pricing_summary", "orders_by_nation",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rows = {}, {}
    for name in QUERIES:
        runs = []
        for _ in range(int(os.environ.get("BENCH_RUNS", "3"))):
            begin = time.perf_counter()
            # all columns of all rows are made; nothing is written
            engine.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - begin)
        seconds[name] = round(statistics.median(runs), 3)
    events = spark.read.parquet(f"{folder}/events.parquet").count()
    rows["hot_features_rows_per_second"] = round(events / seconds["hot_features"])
    spark.stop()
    print(json.dumps({"metric": "total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), **rows}))


if __name__ == "__main__":
    main()
