"""A corpus pipeline of five stages; each takes the rows that its predecessor kept.

Every stage is a function ``(spark, docs, sf_dir) -> DataFrame``; all but the last return the columns of
``documents``.  No stage can be written in DuckDB's SQL as a whole (character models, 64-bit hash bits and token
merges), so ``ORACLE_SQL`` is None and the stages are tested against brute-force versions.
"""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from latencylab.llm import byte_bpe, decontaminate, langid, simhash, unit_dedup
from latencylab.llm.shared import stored

ORACLE_SQL = None
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BATCH_ROWS = 2_000  # rows handed to Python at a time: texts are long, and five operators share the executors' memory


def small_batches(stage):
    """The stage with batches of ``BATCH_ROWS`` rows between the JVM and Python, from then on in its session."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts without a letter and texts that no language model accepts."""
    return langid.accepted_rows(docs, langid.fit(docs))


@small_batches
def keep_first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group keep the document of smallest id.

    A document is told by its id and a checksum of its text: other texts under an id that goes are judged by
    themselves.  Documents without an id come after the others; of equal ids the smallest checksum stays; a row listed
    again is kept once (of rows that differ in other columns, the one with the smallest of these).
    """
    tag = F.xxhash64("text")
    rows = docs.select(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), tag.alias("tag")).alias("key"), "text")
    found = simhash.near_duplicates(rows, id_col="key")
    found = found.groupBy("id").agg(F.first("component_id").alias("first"), F.count("*").alias("n"))
    judged = stored(found.where("id != first or n > 1").selectExpr("id.id as gone_id", "id.tag as gone_tag", "id = first as stays"), "near-duplicates")

    def joined(part: DataFrame, how: str) -> DataFrame:
        on = F.col("row.doc_id").eqNullSafe(F.col("gone_id")) & (tag_of_row == F.col("gone_tag"))
        return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(part, on, how)

    tag_of_row = F.xxhash64("row.text")
    once = joined(judged, "left_anti").select("row")
    again = joined(judged.where("stays"), "inner").groupBy("gone_id", "gone_tag").agg(F.min("row").alias("row")).select("row")
    return once.union(again).select(*[F.col("row")[c].alias(c) for c in docs.columns])


@small_batches
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that an earlier document has; ``n_chars`` follows the text."""
    rows = docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    cut = unit_dedup.dedup(rows)
    now = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return cut.select(*[now.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


@small_batches
def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@small_batches
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of what is left."""
    path = public_tokenizers.path(VOCABULARY)
    return byte_bpe.digests(docs, path, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language", keep_languages),
    ("near_duplicates", keep_first_of_group),
    ("repeated_passages", cut_repeats),
    ("benchmark", drop_benchmark),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
