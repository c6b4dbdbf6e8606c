"""Times the headline queries: python bench.py prints one JSON line.

BENCH_SF_DIR: folder of the tables; BENCH_CPUS: local threads; BENCH_RUNS: runs of each
query after a warm one, of which the median counts. Each run reads its files anew and
evaluates all rows of the result. The tables have no partsupp, so it is made of lineitem and
stored in a folder beside links to them, before anything is timed.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession

from millrace.queries import QUERIES, partsupp

HEADLINES = ["join3_sum", "join2_sum", "filter_cnf_or_band", "filter_partsupp", "join3_point", "distinct_join", "group_shipping", "filter_cnf_or", "group_sum", "join5", "sorted_lookup"]


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "5"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    tables = tempfile.TemporaryDirectory()
    for name in os.listdir(sf_dir):
        os.symlink(os.path.abspath(f"{sf_dir}/{name}"), f"{tables.name}/{name}")
    partsupp(spark.read.parquet(f"{sf_dir}/lineitem.parquet")).coalesce(1).write.parquet(f"{tables.name}/partsupp.parquet")
    for name in HEADLINES:
        times = []
        for _ in range(runs + 1):
            began = time.perf_counter()
            QUERIES[name](spark, tables.name).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 3)
        print(name, took[name], file=sys.stderr)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total of median query times", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else sf_dir}))
    spark.stop()
    tables.cleanup()


if __name__ == "__main__":
    main()
