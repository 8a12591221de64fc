"""Helpers shared by the text operators: shared storage, Arrow batches, row keys."""

from __future__ import annotations

import ctypes
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SLICE_ROWS = 256  # texts turned into Python strings at a time


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where its folder is not on their path already."""
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root, name = os.path.split(package)
    sc = spark.sparkContext
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root in on_path or root == os.getcwd() or getattr(sc, "_llm_package_shipped", False):
        return
    sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), name), "zip", root, name))
    sc._llm_package_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine may go without the setting; it gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="llm-shared-"))
    return spark.conf.get("spark.checkpoint.dir")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it: short lineage that survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def open_store(uri: str) -> tuple[arrow_fs.FileSystem, str]:
    """File system and path of a URI or absolute path; for files that need range reads."""
    if "://" not in uri and not uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    return arrow_fs.FileSystem.from_uri(uri)


_HELD: dict[tuple, object] = {}


def held(key: tuple, make: Callable):
    """What an operator keeps in a Python worker between tasks, such as a tokenizer and its memo.

    Workers outlive tasks and stages; only what was asked for last is kept, so the memos of several operators
    never add up.
    """
    if key not in _HELD:
        if _HELD:
            _HELD.clear()
            give_back()
        _HELD[key] = make()
    return _HELD[key]


def give_back() -> None:
    """Return freed memory of this process to the system, where its allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not every C library has it
        pass


def per_batch(
    df: DataFrame, schema: str, work: Callable[[dict[str, list]], dict[str, list] | None], rows: int = SLICE_ROWS
) -> DataFrame:
    """Map slices of a table, as lists by column, to lists of output columns; nothing is carried over."""
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                made = work(batch.slice(start, rows).to_pydict())
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return map_arrow(df, run, schema)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under internal names, so extra columns with clashing names cannot interfere."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def hex64(value: Column) -> Column:
    """16 lower-case hex digits of a long."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
