"""Merkle manifest of a dataset, kept as concatenated-level strings.

A row's leaf is the hash of its fields.  Leaves of a group stand in the order of the sort key, and every eight
consecutive nodes become their hash, level by level, down to one node per group; the groups' roots do the same
among themselves.  ``BLOCK`` consecutive nodes (three levels) are one row of the block table: each of its levels is
one string of 64 hex digits a node.  A parent is the hash of a fixed-width substring of 512 digits, the siblings of
a node are the two substrings that flank it in its run, and the tops of the blocks are the nodes of the next round,
so the rounds grow with the logarithm of the largest group and no task holds more than a block.

Positions come from a range shuffle of the leaves (never of the texts): rows are numbered inside their range and
shifted by the sizes of the ranges before.  Rows that are alike in every way are spread by a stored number, so a
row listed millions of times doesn't fill one range.

Every table that a later step reads is stored in the shared folder; all work is SQL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from latencylab.llm.shared import stored

ARITY = 8
DIGITS = 64  # hex digits of a node
RUN = ARITY * DIGITS
BLOCK_LEVELS = 3
BLOCK = ARITY**BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field_text(value: Column) -> Column:
    """A field as it is hashed: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value), F.lit(":"), value), F.lit("-"))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field_text, values)), 256)


def group_key(value: Column) -> Column:
    """A name that is never null and sorts as the group does: null first, then by UTF-8 bytes."""
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit(""))


def leaves(docs: DataFrame, fields=FIELDS, id_col="doc_id", group_col="lang", tampered: dict[str, Column] | None = None) -> DataFrame:
    """Stored ``g, id, leaf, tampered, salt`` of every row.

    ``tampered`` maps fields to their tampered values; where the leaf then stays the same, the column is null.
    """
    values = {f: F.col(f"`{f}`") for f in fields}
    leaf = leaf_hash(list(values.values()))
    other = leaf_hash(list((values | tampered).values())) if tampered else F.lit(None).cast("string")
    rows = docs.select(group_key(F.col(f"`{group_col}`")).alias("g"), F.col(f"`{id_col}`").alias("id"), leaf.alias("leaf"), other.alias("tampered"))
    rows = rows.withColumn("tampered", F.when(F.col("tampered") != F.col("leaf"), F.col("tampered")))
    return stored(rows.withColumn("salt", F.monotonically_increasing_id()), "merkle-leaves")


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``pos`` (from 0) and ``n``: the place of a row in its group ``g``, nulls first, and the group's size."""
    ranged = stored(rows.repartitionByRange("g", *order).withColumn("part", F.spark_partition_id()), "merkle-ranges")
    sizes = ranged.groupBy("g", "part").agg(F.count("*").alias("size"))  # a row for each range, and one more for each group
    group = Window.partitionBy("g")
    before = F.sum("size").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("g", "part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("size").over(group).alias("n"))
    inside = F.row_number().over(Window.partitionBy("g", "part").orderBy(*order))
    numbered = ranged.withColumn("k", inside).join(sizes, ["g", "part"])
    return numbered.withColumn("pos", F.col("before") + F.col("k") - 1).drop("part", "k", "before")


def _parents(level: str) -> str:
    """The level above a level string: the hash of each run of ``RUN`` digits."""
    run = f"substring({level}, i * {RUN} + 1, {RUN})"
    return f"cast(array_join(transform(sequence(0, (octet_length({level}) - 1) div {RUN}), i -> sha2({run}, 256)), '') as binary)"


def blocks(nodes: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """Stored block table ``g, block, n, items, height, l0..l3, top`` of ``g, pos, n, node`` and a payload.

    ``height`` is the number of levels hashed: three, or as many as a group of fewer nodes needs.  ``l0`` to ``l3``
    are level strings (null above the height), ``top`` is the block's last one.
    """
    item = F.struct("pos", "node", *payload)
    grouped = nodes.groupBy("g", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.first("n").alias("n"), F.sort_array(F.collect_list(item)).alias("items")  # at most BLOCK
    )
    height = "case when n <= 1 then 0 " + "".join(f"when n <= {ARITY**k} then {k} " for k in range(1, BLOCK_LEVELS)) + f"else {BLOCK_LEVELS} end"
    made = grouped.selectExpr("*", f"{height} as height", "cast(array_join(transform(items, x -> x.node), '') as binary) as l0")
    for k in range(1, BLOCK_LEVELS + 1):
        made = made.withColumn(f"l{k}", F.expr(f"if(height >= {k}, {_parents(f'l{k - 1}')}, null)"))
    tops = ", ".join(f"l{k}" for k in range(BLOCK_LEVELS, -1, -1))
    return stored(made.selectExpr("*", f"cast(coalesce({tops}) as string) as top"), "merkle-blocks")


def _flanks(place: str) -> str:
    """SQL for the siblings of the node at a place of a block, one struct ``l, r`` a level."""
    levels = []
    for k in range(BLOCK_LEVELS):
        j = f"({place} div {ARITY**k})"
        start, own = f"({j} div {ARITY}) * {RUN}", f"({j} % {ARITY}) * {DIGITS}"
        left = f"substring(l{k}, cast({start} + 1 as int), cast({own} as int))"
        right = f"substring(l{k}, cast({start} + {own} + {DIGITS + 1} as int), cast({RUN - DIGITS} - {own} as int))"
        levels.append(f"struct({left} as l, {right} as r)")
    return f"slice(array({', '.join(levels)}), 1, height)"


NO_PATH = "cast(array() as array<struct<l:binary,r:binary>>)"


def tree(nodes: DataFrame, payload: tuple[str, ...] = ()) -> tuple[list[DataFrame], DataFrame]:
    """Block tables of all rounds, and the roots ``g, root``."""
    size = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [blocks(nodes, payload)]
    while size > BLOCK:
        above = rounds[-1].selectExpr("g", "block as pos", f"(n + {BLOCK - 1}) div {BLOCK} as n", "top as node")
        rounds.append(blocks(above))
        size = -(-size // BLOCK)
    return rounds, rounds[-1].selectExpr("g", "top as root")


def _upper_paths(rounds: list[DataFrame]) -> DataFrame:
    """``g, block, path``: the siblings of each block of the first round, up to the group's root."""
    paths = rounds[-1].selectExpr("g", "block", f"{NO_PATH} as path")
    for level in reversed(rounds[1:]):
        own = level.join(paths, ["g", "block"])
        each = f"transform(items, (x, i) -> struct(x.pos as pos, concat({_flanks('i')}, path) as path))"
        paths = own.selectExpr("g", f"inline({each})").withColumnRenamed("pos", "block")
    return paths


@dataclass
class Manifest:
    """Block tables of the groups and of the groups' roots; ``groups`` has ``g, subroot, root, path`` of each group."""

    rounds: list[DataFrame]
    group_rounds: list[DataFrame]
    groups: DataFrame


def manifest(leaf_rows: DataFrame) -> Manifest:
    """Build the tree over ``leaves``.

    Null groups are a group of their own, before the others; null ids come first in their group; rows of equal id
    are ordered by leaf, so any order of the input gives the same tree.  An empty table has no group and no root.
    """
    placed = positions(leaf_rows, ["id", "leaf", "salt"]).withColumnRenamed("leaf", "node")
    rounds, subroots = tree(placed, ("id", "tampered"))
    subroots = stored(subroots, "merkle-subroots")
    one = subroots.select(F.lit("").alias("g"), F.col("g").alias("id"), F.col("root").alias("node"))
    group_rounds, top = tree(positions(one, ["id"]), ("id",))
    upper = _upper_paths(group_rounds)
    each = f"transform(items, (x, i) -> struct(x.id as name, x.node as subroot, concat({_flanks('i')}, path) as path))"
    groups = group_rounds[0].join(upper, ["g", "block"]).selectExpr("g", f"inline({each})").join(top, "g")
    return Manifest(rounds, group_rounds, stored(groups.selectExpr("name as g", "subroot", "root", "path"), "merkle-groups"))


def fold(node: str, path: str) -> str:
    """SQL for the root that a node and its siblings lead to."""
    return f"aggregate({path}, {node}, (a, s) -> sha2(concat(s.l, cast(a as binary), s.r), 256))"


def siblings_hash(path: str) -> str:
    """SQL for the hash of all siblings of a path, level by level, left to right."""
    return f"sha2(aggregate({path}, cast('' as binary), (a, s) -> concat(a, s.l, s.r)), 256)"


def proofs(m: Manifest) -> DataFrame:
    """``id, leaf, tampered, subroot, root, path`` of every row: the siblings from the leaf to the root."""
    upper = _upper_paths(m.rounds).withColumnRenamed("path", "above")
    groups = m.groups.withColumnRenamed("path", "last")
    own = m.rounds[0].join(upper, ["g", "block"]).join(groups, "g")
    item = f"struct(x.id as id, x.node as leaf, x.tampered as tampered, concat({_flanks('i')}, above, last) as path)"
    return own.selectExpr("subroot", "root", f"inline(transform(items, (x, i) -> {item}))")


def verified(docs: DataFrame, fields=FIELDS, id_col="doc_id", group_col="lang", tampered: dict[str, Column] | None = None) -> DataFrame:
    """Per row ``id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Each row is checked against the root with its tampered leaf, if it has one, and the siblings of the untampered
    tree.  Nulls in any column are hashed as such; repeated rows are leaves of their own; other columns are ignored.
    """
    rows = proofs(manifest(leaves(docs, fields, id_col, group_col, tampered)))
    rows = rows.selectExpr(
        "id", "leaf", "subroot", "root", f"{siblings_hash('path')} as proof_sha256",
        f"{fold('coalesce(tampered, leaf)', 'path')} as folded_root",
    )
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def lower_cased(name: str, where: Column) -> Column:
    """The column with A-Z in lower case where a condition holds."""
    value = F.col(f"`{name}`")
    return F.when(where, F.translate(value, UPPER, LOWER)).otherwise(value)
