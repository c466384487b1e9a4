"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line with the best of the runs of each."""

import json
import os
import time

from pyspark.sql import SparkSession

from lumenq import catalogue

QUERIES = ["flagship", "scan_full", "filter_and", "filter_like", "arith_float", "agg_sum_float", "agg_avg", "agg_expr", "group_many", "having", "join_inner", "join_chain", "join_agg", "join_left", "in_subquery", "scalar_subquery", "sort_multi", "topk", "insert_select", "update_where", "delete_where", "index_range_lookup"]
RUNS = 2


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", "file:///tmp/lumenq-bench")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    made, took = catalogue.queries(), {}
    for name in QUERIES:
        for _ in range(RUNS):
            start = time.time()
            made[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = min(took.get(name, 1e9), time.time() - start)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in took.items()}, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
