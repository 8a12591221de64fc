"""Poisson bootstrap of cell means: thousands of replicates from one pass over the rows.

Every row falls into one of ``SLOTS`` slots by a digest of its key.  One aggregate, combined before the shuffle,
leaves count, sum and sum of squares for each slot and cell: at most slots x cells rows, whatever the table.  A
replicate gives each slot a Poisson(1) weight; a cell's draw is its weighted sum over its weighted count.  Rows of a
slot share their weight, so as long as cells have fewer rows than slots this is the row-wise Poisson bootstrap, and
beyond that a bootstrap of ``SLOTS`` groups dealt at random: its spread is the standard error of the mean to within
about ``1 / sqrt(2 * SLOTS)`` (1.1 %; in a cell of a hundred rows, two of them far out in one slot can make it 8 %).  Cells of a replicate share the weights; as rows are dealt at random, draws of
different cells are uncorrelated.

Weights come from digests of slot and replicate, eight replicates a digest, so draws can be repeated in any SQL
engine.  The slot table is bounded by its two parameters and is broadcast; tasks share out the replicates, and
nothing is shuffled after the one pass.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latencylab.operators.sizing import ship_package

REPLICATES = 12_000  # draws kept from three chains of 4,000
SLOT_DIGITS = 3  # hex digits of a slot's name
SLOTS = 16**SLOT_DIGITS
PER_DIGEST = 8  # weights from a digest, 16 bits each
BLOCK = 32  # digests a slot worked on at a time


def poisson_cuts(levels: int = 1 << 16) -> list[int]:
    """Cuts of a 16-bit number; the weight is how many cuts it reaches.  The mean weight is exactly 1."""
    cuts, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        cut = round(total * levels)
        if cut >= levels:
            return cuts
        cuts.append(cut)
        k += 1


def slot_of(key: str) -> str:
    """SQL for the slot of a row with a key text."""
    return f"substring(md5({key}), 1, {SLOT_DIGITS})"


def slot_sums(rows: DataFrame, slot: str = "slot", cell: str = "cell", value: str = "value") -> DataFrame:
    """``slot, cell, n, s, q``: rows, sum and sum of squares; null and NaN values don't count."""
    known = rows.where(f"`{value}` is not null and not isnan(`{value}`) and `{cell}` is not null")
    return known.groupBy(F.col(f"`{slot}`").alias("slot"), F.col(f"`{cell}`").alias("cell")).agg(
        F.count("*").alias("n"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q")
    )


def weights(slots: list[str], digest: int) -> np.ndarray:
    """Weights of the slots in the eight replicates of a digest number, one row a slot."""
    data = b"".join([hashlib.md5(f"{s}_{digest}".encode()).digest() for s in slots])
    return _LEVELS[np.frombuffer(data, ">u2")].reshape(len(slots), PER_DIGEST)


_LEVELS = np.searchsorted(np.array(poisson_cuts()), np.arange(1 << 16), side="right").astype(np.int8)


def cell_means(sums: DataFrame, cells: list[str], pools: dict[str, list[str]], replicates: int = REPLICATES) -> DataFrame:
    """One row a replicate: ``draw``, a column for each cell's mean, and ``sigma_<pool>`` for each pool of cells.

    A pool's sigma is the residual standard deviation within its cells under the same weights.  A cell without
    rows is an error; one without weight in a replicate (its rows all got 0) is null there.
    """
    if replicates % PER_DIGEST:
        raise ValueError(f"replicates must be a multiple of {PER_DIGEST}")
    found = sums.where(F.col("cell").isin(cells)).toArrow().to_pandas()  # at most slots x cells rows
    if missing := sorted(set(cells) - set(found["cell"])):
        raise ValueError(f"cells without rows: {', '.join(missing)}")
    slots = sorted(set(found["slot"]))
    place, column = {s: i for i, s in enumerate(slots)}, {c: i for i, c in enumerate(cells)}
    table = np.zeros((3, len(slots), len(cells)))
    at = found["slot"].map(place).to_numpy(), found["cell"].map(column).to_numpy()
    for k, name in enumerate(("n", "s", "q")):
        table[k][at] = found[name].to_numpy()
    members = {p: [column[c] for c in cs] for p, cs in pools.items()}
    squares = np.stack([table[2][:, m].sum(axis=1) for m in members.values()], axis=1) if pools else np.zeros((len(slots), 0))
    shipped = sums.sparkSession.sparkContext.broadcast((slots, np.hstack([table[0], table[1], squares]), members))
    names = [*cells, *[f"sigma_{p}" for p in pools]]
    out = pa.schema([("draw", pa.int64()), *[(n, pa.float64()) for n in names]])

    def run(batches):
        slots, fold, members = shipped.value
        k = len(column)
        for batch in batches:
            numbers = batch.column(0).to_pylist()
            for start in range(0, len(numbers), BLOCK):
                part = numbers[start:start + BLOCK]
                w = np.hstack([weights(slots, d) for d in part]).astype(float)
                got = w.T @ fold  # replicates x sums
                n, s, q = got[:, :k], got[:, k:2 * k], got[:, 2 * k:]
                with np.errstate(invalid="ignore", divide="ignore"):
                    means = s / n
                    sigma = [
                        np.sqrt((q[:, i] - np.nansum(s[:, m] * means[:, m], axis=1)) / (n[:, m].sum(axis=1) - (n[:, m] > 0).sum(axis=1)))
                        for i, m in enumerate(members.values())
                    ]
                draws = np.concatenate([np.arange(d * PER_DIGEST, (d + 1) * PER_DIGEST) for d in part])
                columns = [pa.array(draws), *[pa.array(c, from_pandas=True) for c in (*means.T, *sigma)]]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    digests = replicates // PER_DIGEST
    spark = sums.sparkSession
    ship_package(spark)
    numbers = spark.range(0, digests, 1, max(1, min(digests // BLOCK, 2 * spark.sparkContext.defaultParallelism)))
    return numbers.mapInArrow(run, "draw bigint, " + ", ".join(f"`{n}` double" for n in names))
