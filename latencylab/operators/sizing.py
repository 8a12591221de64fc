"""Broadcasting only what has a proven or checked size."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

BROADCAST_GROUPS = 512
BROADCAST_ROWS = 50_000


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when the table has at most ``limit`` rows.

    The rows fetched for the check are reused as a local table, so a small aggregate is computed once.
    A larger table is returned untouched and joins by shuffle, where AQE splits skewed partitions.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def few_groups(keys: DataFrame, groups: int | None, limit: int = BROADCAST_GROUPS) -> bool:
    """True if there are at most ``limit`` groups: from the caller's bound, else by counting them."""
    if groups is not None:
        return groups <= limit
    return keys.distinct().limit(limit + 1).count() <= limit


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where its folder is not on their path already."""
    root, name = os.path.split(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    sc = spark.sparkContext
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in on_path or root == os.getcwd() or getattr(sc, "_package_shipped", False):
        return
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", root, name))
    sc._package_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    A session on one machine that names none gets a scratch folder; on a cluster that is an error, since
    executors on other machines could not read what is written there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="latencylab-checkpoint-"))
        current = sc.getCheckpointDir()
    return current


def run_folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder."""
    return f"{checkpoint_dir(spark)}/{spark.sparkContext.applicationId}"


def clear_run(spark: SparkSession) -> bool:
    """Remove what this application has stored; tables that still read from it can't be used afterwards."""
    path = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate to the checkpoint folder and read it from there.

    Several branches then read the stored rows instead of recomputing them, and plans stay short.
    """
    path = f"{run_folder(df.sparkSession)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle(df: DataFrame, limit: int) -> DataFrame:
    """A per-group aggregate as a local table if it has at most ``limit`` rows, else stored."""
    return settle_rows(df, limit)[0]


def settle_rows(df: DataFrame, limit: int) -> tuple[DataFrame, list[Row] | None]:
    """As ``settle``, with the fetched rows if there were few enough."""
    rows = df.limit(limit + 1).collect()
    if len(rows) <= limit:
        return df.sparkSession.createDataFrame(rows, df.schema), rows
    return cut_lineage(df), None
