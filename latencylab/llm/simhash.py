"""SimHash near-duplicates: generalised pigeonhole search over distinct 64-bit fingerprints.

1.  A fingerprint per text from its word shingles, in one pass without a shuffle.  Equal fingerprints are one
    node from here on, so exact copies, however many, cost one row.
2.  Bits that go together are grouped into partitions.  Of the partitionings with 2, 3 or 4 parts the one is
    taken whose thresholds cost least: thresholds t_i >= -1 with sum(t_i + 1) = distance + 1, by dynamic
    programming over estimated candidate counts.  Two fingerprints within the distance then agree within t_i
    on some part i, whatever the choice, so the choice changes cost and never the result.
3.  Each fingerprint is indexed under its value in every part with t_i >= 0 and probes all values within t_i.
    Candidates are verified by the full distance.
4.  A bucket of more than ``BUCKET`` fingerprints is not paired.  Every fingerprint that sits in one or probes
    one emits its 65 neighbours within one bit instead: two fingerprints at distance 2 or less share such a
    neighbour, and all that share one are at distance 2 or less, so a star per neighbour links exactly the
    right ones, with a number of rows in proportion to the bucket.
5.  Components of the links; the smallest id of each is its ``component_id``.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from latencylab.llm.components import components
from latencylab.llm.shared import hex64, map_arrow, only, per_batch, stored

BITS = 64
SHINGLE_WORDS = 3
DISTANCE = 2
SEED = 42
BUCKET = 48  # fingerprints of a bucket that are paired; larger buckets are linked through shared neighbours
SHINGLES_AT_ONCE = 1 << 17
# Ones of each byte value, most significant bit first.
BIT_TABLE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
BYTE_OFFSET = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash: bit set where over half of the shingle hashes have it; 0 without a word."""
    tokens = (text or "").encode().lower().split()  # on bytes both touch ASCII only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = np.concatenate(([0], ends + 1))
    ends = np.append(ends, len(joined))
    if len(starts) > words:
        starts, ends = starts[: len(starts) - words + 1], ends[words - 1:]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones, view, digest = np.zeros(BITS, np.int64), memoryview(joined), xxhash.xxh64_intdigest
    for at in range(0, len(starts), SHINGLES_AT_ONCE):
        spans = zip(starts[at:at + SHINGLES_AT_ONCE].tolist(), ends[at:at + SHINGLES_AT_ONCE].tolist())
        hashes = np.array([digest(view[s:e], SEED) for s, e in spans], ">u8")
        flat = hashes.view(np.uint8).reshape(-1, 8) + BYTE_OFFSET
        ones += (np.bincount(flat.ravel(), minlength=2048).reshape(8, 256) @ BIT_TABLE).ravel()
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``id, fp`` for every row; ``fp`` as a signed long with the bits of the fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(rows):
        fps = np.array([fingerprint(t, words) for t in rows["text"]], np.uint64).view(np.int64)
        return {"id": rows["id"], "fp": fps}

    return per_batch(only(docs, id=id_col, text=text_col), f"id {kind}, fp bigint", work)


def bit_agreement(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and, for each two bits, how many have both set; 4,096 sums over all rows."""

    def counts(batches):
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fps = np.asarray(batch.column(0)).astype(">i8")
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += bits.T @ bits
            n += len(fps)
        if n:
            flat = np.append(total.ravel(), n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["k", "c"])

    summed = map_arrow(nodes.select("fp"), counts, "k bigint, c bigint").groupBy("k").agg(F.sum("c").alias("c"))
    found = np.zeros(BITS * BITS + 1)
    for row in summed.collect():
        found[row["k"]] = row["c"]
    return int(found[-1]), found[:-1].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Split the bits (0 = most significant) into groups of like size, strongly correlated bits together."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    tie = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    left, groups = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        seed = max(sorted(left), key=lambda b: tie[b, sorted(left)].max(initial=0))
        group = [seed]
        left.discard(seed)
        while len(group) < size:
            best = max(sorted(left), key=lambda b: tie[b, group].mean())
            group.append(best)
            left.discard(best)
        groups.append(sorted(group))
    return groups


def as_mask(bits: list[int]) -> int:
    """Signed long with the given bits set."""
    value = sum(1 << (BITS - 1 - b) for b in bits)
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def ball(bits: list[int], radius: int) -> list[int]:
    """Masks of all changes of up to ``radius`` of these bits."""
    return [as_mask(list(c)) for r in range(radius + 1) for c in combinations(bits, r)]


def allocate(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = distance + 1 at least total cost; ``costs[i][t]`` for t >= 0."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (total, chosen) in best.items():
            for t in range(-1, distance + 1 - spent):
                option = (total + (cost[t] if t >= 0 else 0.0), [*chosen, t])
                if spent + t + 1 not in step or option[0] < step[spent + t + 1][0]:
                    step[spent + t + 1] = option
        best = step
    return best[distance + 1]


def plan(nodes: DataFrame, distance: int = DISTANCE, part_counts=(2, 3, 4)) -> list[tuple[list[int], int]]:
    """The cheapest partitioning found, as (bits, threshold) for each part with a threshold of 0 or more.

    Pairs that agree in a part are counted over all fingerprints; the numbers that differ there in one or two
    bits are estimated from this count and each bit's odds of differing.
    """
    n, both = bit_agreement(nodes)
    layouts = [group_bits(n, both, k) for k in part_counts]
    flat = [(k, i, bits) for k, groups in enumerate(layouts) for i, bits in enumerate(groups)]
    values = F.explode(F.array(*[
        F.struct(F.lit(j).alias("part"), F.col("fp").bitwiseAND(F.lit(as_mask(bits))).alias("value"))
        for j, (_, _, bits) in enumerate(flat)
    ]))
    sizes = nodes.select(values.alias("x")).groupBy("x.part", "x.value").count()
    agreeing = {r["part"]: r["pairs"] for r in sizes.groupBy("part").agg(F.sum(F.col("count") * F.col("count")).alias("pairs")).collect()}
    p = np.diag(both) / max(n, 1)
    same = np.maximum(p * p + (1 - p) * (1 - p), 1e-9)
    odds = (1 - same) / same
    found = []
    for k, groups in enumerate(layouts):
        costs = []
        for j, (layout, _, bits) in enumerate(flat):
            if layout == k:
                one = odds[bits].sum()
                two = (one * one - (odds[bits] ** 2).sum()) / 2
                pairs = np.cumsum([agreeing.get(j, 0) * x for x in (1.0, one, two)])
                costs.append([n * len(ball(bits, t)) + pairs[t] for t in range(min(distance, 2) + 1)])
        found.append((*allocate(costs, distance), groups))
    _, thresholds, groups = min(found, key=lambda x: x[0])
    return [(bits, t) for bits, t in zip(groups, thresholds) if t >= 0]


def _keys(nodes: DataFrame, masks: list[list[int]], parts: list[tuple[list[int], int]]) -> DataFrame:
    """``part, value, fp`` with one row per part and change of the part's bits."""
    rows = [
        F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(as_mask(bits))).bitwiseXOR(F.lit(m)).alias("value"))
        for i, (bits, _) in enumerate(parts) for m in masks[i]
    ]
    return nodes.select("fp", F.explode(F.array(*rows)).alias("x")).select("x.part", "x.value", "fp")


def links(nodes: DataFrame, distance: int = DISTANCE, bucket: int = BUCKET) -> DataFrame:
    """Links ``a > b`` between distinct fingerprints whose components are those of all pairs within the distance."""
    if distance != 2:
        raise ValueError("large buckets are linked through neighbours within one bit, which needs a distance of 2")
    parts = plan(nodes, distance)
    index = _keys(nodes, [[0]] * len(parts), parts)
    probes = _keys(nodes, [ball(bits, t) for bits, t in parts], parts)
    large = stored(index.groupBy("part", "value").count().where(F.col("count") > bucket).select("part", "value"), "large-buckets")
    crowded = stored(probes.join(large, ["part", "value"]).select("fp").distinct(), "crowded")
    paired = probes.join(large, ["part", "value"], "left_anti").select("part", "value", F.col("fp").alias("a"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = paired.join(index.withColumnRenamed("fp", "b"), ["part", "value"]).where((F.col("a") > F.col("b")) & near)
    flips = F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in ball(list(range(BITS)), 1)]))
    shared = crowded.select("fp", flips.alias("key")).groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("near"))
    # at most 65 fingerprints are within one bit of a key
    stars = shared.where(F.size("near") > 1).select(F.col("near")[0].alias("b"), F.explode(F.slice("near", 2, BITS + 1)).alias("a"))
    return pairs.select("a", "b").union(stars.select("a", "b")).distinct()


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", words: int = SHINGLE_WORDS) -> DataFrame:
    """``id, fp, component_id`` for every row: its fingerprint and the smallest id reachable over links.

    Null, empty and wordless texts have fingerprint 0 and link like any other.  A null id takes part but is
    never the smallest unless a component has no other id.  Repeated rows give repeated rows; extra columns
    are ignored; an empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = stored(rooted, "rooted")
    smallest = stored(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "smallest")
    named = stored(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("id", "fp", "component_id")


def with_hex(found: DataFrame) -> DataFrame:
    return found.select("id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
