"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from sequela.plans.queries import QUERIES

HEADLINE = (
    "e7_min_gap",
    "v8_first_incident",
    "r6_expected_events",
    "r11_oe_table",
    "m2_sample_controls",
    "x4_hospital_status",
    "l2_clogit_product",
    "l5_nested_models",
    "k4_sccs_rates",
    "k5_sccs_fit",
    "k10_label_sccs",
    "p8_level_rates",
    "p10_pd_model_joint",
    "f6_hospital_summary",
    "l6_screen_covariates",
    "l7_extra_models",
    "l10_its_poisson",
    "k11_sccs_models",
    "p11_rr_table",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's and the Python workers' code before timing
    spark.range(8).mapInPandas(lambda it: it, "id long").count()
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    spark.stop()
    result = {
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
