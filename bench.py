"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one line of JSON."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import tessera as ts  # noqa: E402
from tessera import queries as q  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 2


def stats(spark, d):
    line = q.read(spark, d, "lineitem")
    return spark.createDataFrame([(s.name, s.unique) for s in ts.profile(line, approximate=True, distributions=False)], "name string, n bigint")


def headline():
    names = [
        "stratified_sample_lineitem", "random_sample_lineitem", "auto_sample_orders", "narrow_sample_part", "auto_strata_lineitem", "profile_lineitem_exact", "histogram_extendedprice", "topk_p_brand",
        "hist_source_vs_sample", "strat_report_table", "seq_id_mktsegment", "jitter_integer_qty", "dt_jitter_orderdate", "hex_custname", "names_custname", "pca2_scores", "sample_anonymize_reduce",
    ]
    return {**{n: q.QUERIES[n] for n in names}, "stats_lineitem": stats}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, run in headline().items():
        best = float("inf")
        for _ in range(RUNS):
            spark.catalog.clearCache()  # samples are kept once drawn; a second run shall draw again
            began = time.perf_counter()
            run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "total of headline queries, best of two runs each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(scale[1]) if scale else None}))
    spark.stop()


if __name__ == "__main__":
    main()
