"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of first turns; the conversations that start with it are its members.  Conversations
are first merged into one row per distinct whole sequence.  Then the trie is peeled from its greatest depth: at each
depth, rows that end there are merged with the nodes that survived from below, the last turn is stripped, and rows of
the same remaining prefix are regrouped.  A node's members, children, leaves and saved tokens are complete as soon as
its depth is peeled, so nodes are found and aggregated in the same pass.

A row carries its prefix chain: for each turn a 16-byte digest of the sequence up to it and the length of its text.
Texts never move: only chains do.

Depths are peeled in bands.  All rows that share the prefix at the upper end of a band can be peeled together
in a task, depth after depth, if there are few of them: the band reaches as far up as no such group has more than
``GROUP_ROWS`` rows.  Where even the next depth has a larger group, that depth is one aggregate, combined before the
shuffle, so a first turn that a third of all conversations share is a row per task.  The number of bands grows with
the logarithm of the depth, plus the depths whose prefixes are shared by many different conversations.  Each band is
a table in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from latencylab.llm.shared import arrow_schema, map_arrow, stored

DIGEST = 16
STEP = DIGEST + 4  # bytes of a chain per turn: digest and length
GROUP_ROWS = 256  # distinct rows peeled together
CHUNK_BITS = 8  # ids of a sequence are put together in ranges of 256
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "key binary, parent binary, depth int, n bigint, low bigint, kids bigint, leaves bigint, saved bigint, ends string, chain binary"


def conversations(turns: DataFrame, id_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """``id, turns``: per conversation the digest and text length of its turns in order.

    Null roles and texts count as empty; a null turn number comes first; equal numbers are ordered by digest.  Rows of
    a null id belong to no conversation.  A conversation must fit a task's memory, at 24 bytes a turn.
    """
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, DIGEST)
    rows = turns.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.struct(F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), F.char_length(text).alias("size")).alias("t"),
    )
    ordered = F.sort_array(F.collect_list("t"))
    return rows.groupBy("id").agg(F.transform(ordered, lambda t: F.struct(t["digest"], t["size"])).alias("turns"))


def chains(convs: DataFrame) -> DataFrame:
    """``id, chain`` of ``id, turns``."""
    schema = "id bigint, chain binary"
    out = arrow_schema(schema)

    def work(turns: list[dict]) -> bytes:
        last, parts = b"", []
        for t in turns:
            last = hashlib.blake2b(last + t["digest"], digest_size=DIGEST).digest()
            parts += (last, t["size"].to_bytes(4, "big"))
        return b"".join(parts)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                made = [work(t or ()) for t in part.column("turns").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made, pa.binary())], schema=out)

    return map_arrow(convs.select("id", "turns"), run, schema)


def sequences(chained: DataFrame) -> DataFrame:
    """Stored rows of the trie's ends: one for each distinct sequence, with the hash of its conversations' ids.

    A hash over all ids in order is sequential by nature; ids are joined in ranges of 256 first, and the task that
    has a sequence streams its ranges in order, so it holds one at a time.
    """
    key = F.expr(f"substring(chain, octet_length(chain) - {STEP - 1}, {DIGEST})")
    chunk = F.shiftright("id", CHUNK_BITS)
    joined = chained.select(key.alias("key"), chunk.alias("chunk"), "id", "chain").groupBy("key", "chunk").agg(
        F.first("chain").alias("chain"), F.count("*").alias("n"), F.min("id").alias("low"),
        F.array_join(F.sort_array(F.collect_list("id")).cast("array<string>"), ",").alias("ids"),
    )
    out = arrow_schema(NODE)

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]):
        now, rows = None, []

        def close():
            key, chain, n, low, ends = now
            rows.append((key, None, len(chain) // STEP, n, low, 0, 0, 0, ends.hexdigest(), chain))

        for batch in batches:
            for row in batch.to_pylist():
                if now and now[0] == row["key"]:
                    now[2] += row["n"]
                    now[3] = min(now[3], row["low"])
                    now[4].update(b"," + row["ids"].encode())
                    continue
                if now:
                    close()
                now = [row["key"], row["chain"], row["n"], row["low"], hashlib.sha256(row["ids"].encode())]
            if len(rows) >= 4096:
                yield emit(rows)
                rows.clear()
        if now:
            close()
        if rows:
            yield emit(rows)

    ordered = joined.repartition("key").sortWithinPartitions("key", "chunk")
    return stored(map_arrow(ordered, run, NODE), "trie-ends")


def prefix_key(depth: int) -> str:
    """SQL for the digest of the first ``depth`` turns of a chain; empty for the root."""
    return f"substring(chain, {STEP * (depth - 1) + 1}, {DIGEST})" if depth else "cast('' as binary)"


def peel_rows(rows: list[tuple], low: int) -> list[tuple]:
    """Nodes of a band from rows ``(depth, n, low, kids, leaves, saved, ends, chain, done)``.

    ``done`` marks nodes that survived from below; the others end at their depth.  Nodes at depth ``low`` keep
    their chain: they are the next band's survivors.
    """
    waiting: dict[int, list] = {}
    for row in rows:
        waiting.setdefault(row[0], []).append(row)
    found, above, depth = [], [], max(waiting)
    survivors = [r for r in waiting.get(depth, ()) if r[8]]
    if survivors:
        above, waiting[depth] = [(r[7], r[1], r[2], r[4], r[5]) for r in survivors], []
        depth -= 1
    while depth >= low:
        nodes: dict[bytes, list] = {}
        cut = slice(STEP * (depth - 1), STEP * (depth - 1) + DIGEST) if depth else slice(0, 0)
        for _, n, least, _, _, _, ends, chain, _ in waiting.get(depth, ()):
            nodes[chain[cut]] = [n, least, 0, 0, 0, ends, chain]
        for chain, n, least, leaves, saved in above:
            node = nodes.get(chain[cut])
            if node is None:
                nodes[chain[cut]] = [n, least, 1, leaves, saved, None, chain]
            else:
                node[0] += n
                node[1] = min(node[1], least)
                node[2] += 1
                node[3] += leaves
                node[4] += saved
        above = []
        for key, (n, least, kids, leaves, saved, ends, chain) in nodes.items():
            if depth:
                saved += (n - 1) * int.from_bytes(chain[STEP * depth - 4:STEP * depth], "big")
            leaves = leaves or 1
            parent = chain[STEP * (depth - 2):STEP * (depth - 2) + DIGEST] if depth > 1 else b"" if depth else None
            kept = chain[:STEP * depth] if depth == low else None
            found.append((key, parent, depth, n, least, kids, leaves, saved, ends, kept))
            above.append((chain, n, least, leaves, saved))
        depth -= 1
    return found


def _peel_in_tasks(rows: DataFrame, low: int) -> DataFrame:
    """Peel groups that share the prefix at depth ``low``, many of them at a time."""
    out = arrow_schema(NODE)

    def run(batches: Iterator[pa.RecordBatch]):
        group, held = None, []
        for batch in batches:
            part = batch.to_pydict()
            keys = part.pop("g")
            rows = list(zip(*part.values()))
            last = len(keys)
            while last and keys[last - 1] == keys[-1]:  # the last group may go on in the next batch
                last -= 1
            if last or (held and group != keys[0]):
                whole = held + rows[:last]
                yield from emit(whole)
                held = rows[last:]
            else:
                held += rows
            group = keys[-1]
        yield from emit(held)

    def emit(rows):
        if rows:
            made = peel_rows(rows, low)
            for at in range(0, len(made), 8192):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made[at:at + 8192]), out)], schema=out)

    keyed = rows.selectExpr(f"{prefix_key(low)} as g", "depth", "n", "low", "kids", "leaves", "saved", "ends", "chain", "done")
    return map_arrow(keyed.repartition("g").sortWithinPartitions("g"), run, NODE)


def _peel_one(rows: DataFrame, depth: int) -> DataFrame:
    """Peel one depth as an aggregate that is combined before the shuffle."""
    size = f"cast(conv(hex(substring(chain, {STEP * depth - 3}, 4)), 16, 10) as bigint)" if depth else "0L"
    nodes = rows.selectExpr(
        f"{prefix_key(depth)} as key", "n", "low", "cast(done as bigint) as kid", "leaves", "saved", "if(done, null, ends) as ends",
        f"substring(chain, 1, {STEP * depth}) as chain",
    ).groupBy("key").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.sum("kid").alias("kids"), F.sum("leaves").alias("leaves"),
        F.sum("saved").alias("saved"), F.max("ends").alias("ends"), F.first("chain").alias("chain"),
    )
    parent = "cast(null as binary)" if not depth else prefix_key(depth - 1)
    return nodes.selectExpr(
        "key", f"{parent} as parent", f"{depth} as depth", "n", "low", "kids", "greatest(leaves, 1L) as leaves",
        f"saved + (n - 1) * {size} as saved", "ends", "chain",
    )


def _band(rows: DataFrame, high: int, group_rows: int) -> int:
    """The least depth to peel to from ``high``: no group there has more than ``group_rows`` rows."""
    tried, step = [], high
    while step >= 1:
        tried.append(high - step)
        step = min(step - 1, -(-step // 2))
    keys = ", ".join(f"if(depth >= {d}, named_struct('d', {d}, 'g', {prefix_key(d)}), null)" for d in tried)
    sizes = rows.selectExpr(f"inline(array_compact(array({keys})))").groupBy("d", "g").count()
    most = {r["d"]: r["most"] for r in sizes.groupBy("d").agg(F.max("count").alias("most")).collect()}
    return next((d for d in tried if most.get(d, 0) <= group_rows), high - 1)


def peel(ends: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """All nodes of the trie over the distinct sequences ``ends``."""
    deepest = ends.agg(F.max("depth")).first()[0]
    if deepest is None:
        return ends
    high, nodes, survivors = deepest + 1, None, ends.limit(0)
    fields = ["depth", "n", "low", "kids", "leaves", "saved", "ends", "chain"]
    while high > 0:
        rows = survivors.select(*fields, F.lit(True).alias("done")).union(
            ends.where(F.col("depth") < high).select(*fields, F.lit(False).alias("done"))
        )
        low = _band(rows, high, group_rows)
        rows = rows.where(F.col("depth") >= low)
        made = _peel_one(rows, low) if low == high - 1 else _peel_in_tasks(rows, low)
        made = stored(made, f"trie-from-{low}")
        nodes = made if nodes is None else nodes.union(made)
        survivors, high = made.where(F.col("depth") == low), low
    return nodes


def trie(convs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Nodes of the trie over ``id, turns`` (see ``conversations``).

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (of the parent; null for the root), ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes below or at it), ``saved_tokens`` (code points that storing each node
    of its subtree once saves) and ``ends_sha256`` (hash of the ids of the conversations that end there).  A
    conversation without turns ends at the root; without conversations there is no node.  Ids must be distinct.
    """
    nodes = peel(sequences(chains(convs)), group_rows)
    # all nodes of depth 1 have one parent, which needs no join
    root = nodes.where("depth = 0").select("low").first()
    parents = nodes.select(F.col("key").alias("parent"), F.col("low").alias("parent_low"))
    joined = nodes.drop("chain").where("depth > 1").join(parents.where(F.col("parent") != F.lit(b"")), "parent")
    flat = nodes.drop("chain").where("depth <= 1")
    flat = flat.withColumn("parent_low", F.when(F.col("depth") == 1, F.lit(root["low"] if root else None)).cast("bigint"))
    both = joined.select(*flat.columns).union(flat)
    return both.select(
        F.col("low").alias("conv_id"), F.col("depth").cast("bigint").alias("depth"), F.col("parent_low").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256"),
    )


SHARED_TURNS = 5


def rebuilt(convs: DataFrame) -> DataFrame:
    """Conversations that share openings: conversation c starts with the first h turns of c - c % 100 and goes on
    with its own turns after its first h, where h = crc32 of c in decimal, modulo 6."""
    heads = convs.where("id % 100 = 0").selectExpr("id as base", f"slice(turns, 1, {SHARED_TURNS}) as head")
    rows = convs.selectExpr("id", "id - id % 100 as base", f"cast(crc32(cast(id as string)) % {SHARED_TURNS + 1} as int) as h", "turns")
    joined = rows.join(heads, "base", "left")
    none = "cast(array() as array<struct<digest:binary,size:int>>)"
    return joined.selectExpr(
        "id", f"concat(if(head is null, {none}, slice(head, 1, h)), slice(turns, h + 1, greatest(size(turns), 1))) as turns"
    )
