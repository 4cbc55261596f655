"""Headline queries, one JSON line: seconds each and in all."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "q_genotype_profile", "q_reject_funnel", "q_range_join_windows", "q_core_length_bins", "q_mode_consensus", "q_expected_stutter", "q_phantom_suppress", "q_flag_census", "q_tidy",
    "q_cohort_margins", "q_concordance_rollup", "q_stutter_fit", "q_catalog_best_hit", "q_cluster_full", "q_run_loci",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tandemframe.plans.queries import queries

    known, took = queries(), {}
    known["q_parameters"](spark, folder).count()  # the JVM and a session are up
    for name in sys.argv[1:] or HEADLINE:
        began = time.time()
        known[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    out = {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2]}
    if "q_genotype_profile" in took:
        loci = spark.read.parquet(f"{folder}/lineitem.parquet").selectExpr("l_suppkey", "l_partkey % 5").distinct().count()
        out |= {"loci": loci, "loci_per_min": round(60 * loci / took["q_genotype_profile"])}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
