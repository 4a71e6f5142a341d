"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8). Every query is computed in full into a sink that
throws the rows away; the reported time is the faster of two runs.
"""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from tidemark import plans  # noqa: E402

HEADLINE = [
    "at09_mart_attribution", "at11_direct_effect", "w06_flatten_events", "w10_dim_product", "v01_metric_vector", "d08_anomaly_summary", "g01_segment_features", "l03_chronological_split",
    "f04_pooled_lift", "c02_measured_signals", "r03_best_reply", "k06_gap_verdicts", "u03_usage_daily", "p04_find_pii", "p06_find_claims", "e02_rule_score", "o01_best_run_per_day",
]


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    queries = plans.queries()
    wanted = sys.argv[1:] or HEADLINE
    sink = lambda name: queries[name](spark, folder).write.format("noop").mode("overwrite").save()
    sink(wanted[0])
    times = {}
    for name in wanted:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            sink(name)
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
