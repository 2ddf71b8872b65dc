"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.session import configure, staging  # noqa: E402
from scenarios import all_queries  # noqa: E402

HEADLINE = (
    "v13_table_counts",
    "v10_valid_lineitem",
    "v11_rejected_rows",
    "v05_conflict_pairs",
    "v09_self_reference",
    "o11_insert_text",
    "o08_text_literals",
    "p12_profile_imports",
    "p02_text_lengths",
    "m08_candidates",
    "m17_one_to_one",
    "c07_load_order",
    "g13_clean_rows",
    "s01_csv_grid",
    "t02_gap_free_numbers",
    "a03_merged_sources",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("millrace-bench")
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    builder = builder.config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
    spark = configure(builder, int(cpus)).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()

    known = all_queries()
    # Untimed pass over the smallest tables, so that JVM start-up is not what is measured.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = os.path.isdir(small) and os.environ.get("BENCH_WARMUP", "1") == "1"
    for name in wanted if warm else ():
        with staging(spark):
            known[name](spark, small).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        with staging(spark):
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_headline_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "warmup": warm,
    }))


if __name__ == "__main__":
    main()
