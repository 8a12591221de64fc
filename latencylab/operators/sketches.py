"""Quantiles from stored sketches that are merged without the rows.

A load (a day, a file, a block) is reduced once to one KLL sketch per group.  Sketches are small (a few kilobytes),
are kept in a table partitioned by load, and are merged for any set of loads; a refresh reads the new load's rows only.
The estimate of a quantile has a rank within ``rank_error(k)`` of the wanted one with 99 % confidence, whatever the
number of rows or merges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SIZE = 400  # k of the sketch


def rank_error(k: int = SIZE) -> float:
    """Normalised rank error of one quantile at 99 % confidence, as published for this sketch."""
    return 2.296 / k**0.9723


def load_sketches(rows: DataFrame, by: list[str], load: str, value: str, k: int = SIZE) -> DataFrame:
    """``by, load, n, low, high, sketch``: one row a group and load; nulls and NaNs don't count."""
    known = rows.where(f"`{value}` is not null and not isnan(`{value}`)").withColumn(value, F.col(value).cast("double"))
    return known.groupBy(*by, F.col(load).alias("load")).agg(
        F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch")
    )


def add_loads(sketches: DataFrame, path: str) -> None:
    """Store sketches by load; loads written again replace their earlier sketches, others stay."""
    spark = sketches.sparkSession
    setting = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "dynamic")
    try:
        sketches.write.mode("overwrite").partitionBy("load").parquet(path)
    finally:
        spark.conf.set(setting, before)


def stored_sketches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def quantiles(sketches: DataFrame, by: list[str], probabilities: list[float], k: int = SIZE) -> DataFrame:
    """``by, n, p, estimate, rank_error`` from merged sketches; rows are not read.  A group without values has no row."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"))
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    found = merged.withColumn("e", F.kll_sketch_get_quantile_double("sketch", wanted)).withColumn("p", wanted)
    found = found.select(*by, "n", "low", "high", F.explode(F.arrays_zip("p", "e")).alias("x"))
    # the ends are known exactly
    estimate = F.when(F.col("x.p") == 0, F.col("low")).when(F.col("x.p") == 1, F.col("high")).otherwise(F.col("x.e"))
    return found.select(*by, "n", F.col("x.p").alias("p"), estimate.alias("estimate"), F.lit(rank_error(k)).alias("rank_error"))
