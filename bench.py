"""Headline queries timed on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "clean_trials",
    "cell_key",
    "row_ordinal",
    "subject_dense_id",
    "hpdi_by_cell",
    "median_by_cell",
    "kde_mode",
    "pooled_summary",
    "decode_7block",
    "decode_group_v3",
    "effect_ms_k4",
    "rope_share_by_effect",
    "q1_cohort_description",
    "q2_condition_curve",
    "q3_transfer_slowdown",
    "q4_dependency_vs_baseline",
    "q7_fixed_effects",
    "q8_cohort_effects_table",
    "q10_group_effects_v3",
    "q12_effect_sizes_v1",
    "q12_effect_sizes_v2",
    "q12_effect_sizes_v3",
    "q14_age_dependency_v3",
    "q16_hit_rates",
    "q17_sdt_table",
    "contrast_regression",
    "partial_pooling",
    "sdt_dprime",
    "rhat",
    "predictive_bars",
]


def main() -> None:
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("latencylab-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from latencylab.operators.contrasts import design
    from latencylab.plans.queries import QUERIES
    from latencylab.sources import warehouse

    def timed(run) -> float:
        start = time.perf_counter()
        run()
        return round(time.perf_counter() - start, 3)

    def consume(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    spark.range(1_000).selectExpr("sum(id)").collect()  # start the JVM side before the clock
    seconds = {}
    # stored draw tables are inputs of the reports; what it takes to derive them is timed by itself
    seconds["store_cell_draws"] = timed(lambda: warehouse.cell_draws(spark, SF_DIR))
    seconds["store_parameter_draws"] = timed(
        lambda: [warehouse.seven_block_draws(spark, SF_DIR)]
        + [warehouse.group_draws(spark, SF_DIR, design(f"group_{v}")) for v in ("v1", "v2", "v3")]
    )
    for name in HEADLINE:
        seconds[name] = timed(lambda: consume(QUERIES[name](spark, SF_DIR)))
    total = round(sum(seconds.values()), 3)
    spark.stop()
    scale = os.path.basename(os.path.normpath(SF_DIR)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
