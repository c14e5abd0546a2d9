"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tidemill.plans.catalog import QUERIES

HEADLINE = ["seasonal_naive_eval", "b12_regularize", "d3_fill_linear", "d10_fill_seasonal", "g1_standard_scale", "h2_naive", "i7_crps", "j6_leaderboard", "j9_win_rate", "h1_forecast", "i8_window_metrics", "d3_blocks_linear", "d8_joint", "h1_covariates", "k9_training_table"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
