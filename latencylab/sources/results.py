"""Stored results that are refreshed partition by partition.

A result is a folder with a ``data`` table, partitioned by version and by the partition columns, and a ``manifest``: for
each version one small file that lists every partition with the fingerprint of its input and the version that holds
it.  A refresh fingerprints the input (count, exclusive or and sum of row hashes: one aggregate, combined before the
shuffle), rebuilds only partitions whose fingerprint is new, writes them as a new version, and publishes by adding
the new manifest file, which appears as a whole or not at all.  Readers go by the newest manifest, so they see the old
result until then, and a refresh that fails changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

VERSION = "_version"


def fingerprints(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, rows, mix, total``: the same for any order of the rows, different for other rows."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"`{c}`").isNull() for c in rows.columns])
    hashed = rows.select(*by, h.alias("h"))
    return hashed.groupBy(*by).agg(F.count("*").alias("rows"), F.bit_xor("h").alias("mix"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("total"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def input_stamp(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of the files of a table: changes when the table does; no data are read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest manifest: ``by..., rows, mix, total, _version`` and ``published``; None before the first refresh."""
    if not _exists(spark, f"{path}/manifest"):
        return None
    every = spark.read.parquet(f"{path}/manifest")
    newest = every.agg(F.max("published")).first()[0]
    return every.where(F.col("published") == newest)


def refresh(path: str, rows: DataFrame, by: list[str], build: Callable[[DataFrame], DataFrame]) -> int:
    """Bring the result at ``path`` up to date with its input; returns the number of partitions rebuilt.

    ``build`` makes the result of some partitions from their rows alone and keeps the columns ``by``, which must have no
    nulls.  Partitions whose input is gone leave the result; without any change nothing is written.
    """
    spark = rows.sparkSession
    now = fingerprints(rows, by)
    last = manifest(spark, path)
    if last is None:
        version, state = 1, now.withColumn(VERSION, F.lit(1).cast(LongType()))
    else:
        version = last.agg(F.max("published")).first()[0] + 1
        old = last.select(*by, "rows", "mix", "total", F.col(VERSION).alias("held"))
        state = now.join(old, [*by, "rows", "mix", "total"], "left").select(*now.columns, F.coalesce("held", F.lit(version)).cast(LongType()).alias(VERSION))
    state = spark.createDataFrame(state.collect(), state.schema)  # a row for each partition
    changed = state.where(F.col(VERSION) == version).select(*by)
    n_changed, n_now = changed.count(), state.count()
    if last is not None and not n_changed and n_now == last.count():
        return 0
    if n_changed:
        made = build(rows.join(F.broadcast(changed), by, "left_semi"))
        made.withColumn(VERSION, F.lit(version).cast(LongType())).write.mode("append").partitionBy(VERSION, *by).parquet(f"{path}/data")
    state.withColumn("published", F.lit(version).cast(LongType())).coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return n_changed


def read(spark: SparkSession, path: str, by: list[str], versions: bool = False) -> DataFrame:
    """The published result; partitions of other versions are not read.  ``versions`` adds ``_version``."""
    current = manifest(spark, path)
    if current is None:
        raise ValueError(f"nothing has been published at {path}")
    found = spark.read.parquet(f"{path}/data")
    kinds = {f.name: f.dataType for f in found.schema.fields}
    current = current.select(*[F.col(b).cast(kinds[b]).alias(b) for b in by], VERSION)
    found = found.join(F.broadcast(current), [*by, VERSION], "left_semi")
    return found if versions else found.drop(VERSION)
