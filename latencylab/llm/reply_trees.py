"""Chat formatting of reply trees.

Messages point to the message they answer.  Iterative self-joins double the length of the known ancestor chain
each round, so a tree of depth d takes log2(d) rounds: they give every message its root, its depth and the sum of
scores above it.  Leaves are ranked by the mean score of their path, and the chosen paths are enumerated by running
the rounds backwards: a path's marked messages mark the ones 2^k above them, from the longest jumps down.

Each chosen path is formatted as one conversation: one text, in one row unless it is longer than ``CHUNK`` characters;
longer ones are cut there, wherever that falls.  Turns are marked by control strings; control strings inside texts
are escaped reversibly.  Readers know nothing but this text: they find turns by their marks, across cuts, and the
loss mask covers what stands in assistant turns.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from latencylab.llm.shared import arrow_schema, map_arrow, stored

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
MAX_DOUBLINGS = 40
CHUNK = 1 << 20  # characters of a formatted conversation in one row


def escaped(text: Column) -> Column:
    """One more backslash between each "<" and "|": no control string is left in a text."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    """A role on one line: backslashes and line ends as two characters, control strings as in texts."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    """Inverse of ``escaped``: one backslash less between each "<" and "|"."""
    import re

    return re.sub(r"<\\(\\*)\|", r"<\1|", text) if "<\\" in text else text


def unescape_role(role: str) -> str:
    import re

    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def as_chains(turns: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """Messages of plain conversations, each answering the one before it.

    ``conv_id, node, parent, role, text``; nodes number the rows of a conversation in the order of turn, role and
    text (null turns first).  Rows are ordered by a range shuffle over all of these, so a conversation may spread
    over many tasks, and numbered by place in the task plus the rows of the conversation in earlier tasks.
    """
    rows = turns.select(
        F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"),
        F.coalesce(F.col(f"`{role_col}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )
    keys = ["conv_id", "turn", "role", "text"]
    ordered = rows.repartitionByRange(*[F.col(k) for k in keys[:3]]).sortWithinPartitions(*keys)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"conv_id {kinds['conv_id']}, part int, place bigint, role string, text string"
    out = arrow_schema(schema)

    def run(batches):
        from pyspark import TaskContext

        part, conv, place = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for c in batch.column("conv_id").to_pylist():
                place = place + 1 if c == conv else 0
                conv = c
                places.append(place)
            columns = [batch.column("conv_id"), pa.array([part] * len(places)), pa.array(places), batch.column("role"), batch.column("text")]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    placed = stored(map_arrow(ordered, run, schema), "placed-turns")
    sizes = placed.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # only a conversation cut by a range border has rows in several tasks
    sizes = stored(sizes.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).where("base > 0"), "turn-bases")
    sizes = sizes.select(F.col("conv_id").alias("base_conv"), F.col("part").alias("base_part"), "base")
    on = F.col("conv_id").eqNullSafe(F.col("base_conv")) & (F.col("part") == F.col("base_part"))
    node = F.col("place") + F.coalesce("base", F.lit(0))
    numbered = placed.join(sizes, on, "left").select("conv_id", node.alias("node"), "role", "text")
    return numbered.withColumn("parent", F.when(F.col("node") > 0, F.col("node") - 1))


def _same(left: list[str], right: list[str]) -> Column:
    on = F.lit(True)
    for a, b in zip(left, right):
        on &= F.col(a).eqNullSafe(F.col(b))
    return on


def ancestors(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depth and path score of each node, and per round the jumps of 2^k messages.

    ``nodes``: ``conv_id, node, parent, score``.  A parent that is not a node of the conversation counts as none.
    A conversation whose messages have all reached their root leaves the rounds, so later ones touch only the
    longer conversations.  A cycle has no root and raises.
    """
    known = nodes.select(F.col("conv_id").alias("p_conv"), F.col("node").alias("p_node"), F.col("score").alias("p_score"))
    jump = nodes.join(known, _same(["conv_id"], ["p_conv"]) & (F.col("parent") == F.col("p_node")), "left")
    # to: the message 2^k above, if the path is that long; depth and total: of the messages passed
    jump = jump.select("conv_id", "node", F.col("p_node").alias("to"), F.lit(1).cast("bigint").alias("depth"), F.col("score").alias("total"))
    jump, levels, left = stored(jump, "jumps-0"), [], []
    for k in range(MAX_DOUBLINGS):
        rising, there = jump.where("to is not null"), jump.where("to is null")
        if rising.isEmpty():
            depths = there
            for done in left:
                depths = depths.union(done)
            return stored(depths.select("conv_id", "node", "depth", "total"), "depths"), levels
        levels.append(rising.select("conv_id", "node", "to"))
        live = stored(rising.select(F.col("conv_id").alias("l_conv")).distinct(), "live")
        left.append(there.join(live, _same(["conv_id"], ["l_conv"]), "left_anti"))
        above = jump.select(
            F.col("conv_id").alias("a_conv"), F.col("node").alias("a_node"), F.col("to").alias("a_to"),
            F.col("depth").alias("a_depth"), F.col("total").alias("a_total"),
        )
        step = rising.join(above, _same(["conv_id"], ["a_conv"]) & (F.col("to") == F.col("a_node")), "left")
        step = step.select(
            "conv_id", "node", F.col("a_to").alias("to"),
            (F.col("depth") + F.coalesce("a_depth", F.lit(0))).alias("depth"),
            (F.col("total") + F.coalesce("a_total", F.lit(0.0))).alias("total"),
        )
        jump = stored(step.union(there.join(live, _same(["conv_id"], ["l_conv"]), "left_semi")), f"jumps-{k + 1}")
    raise ValueError("a reply tree has a cycle")


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """The ``best`` highest-scored root-to-leaf paths of each tree: ``conv_id, leaf, rank, position, node, role, text``.

    ``messages``: ``conv_id, node, parent, role, text`` and, optionally, ``score`` (0 where absent or null); nodes
    are unique within a conversation.  A path's score is the mean of its messages' scores; equal scores rank by
    leaf.  ``best`` bounds the leaves ranked in one group, before the shuffle as well as behind it.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(0.0)) if "score" in messages.columns else F.lit(0.0)
    nodes = stored(messages.select("conv_id", "node", "parent", score.alias("score")), "messages")  # texts stay where they are
    depths, levels = ancestors(nodes)
    inner = nodes.where("parent is not null").select(F.col("conv_id").alias("i_conv"), F.col("parent").alias("i_node")).distinct()
    leaves = depths.join(inner, _same(["conv_id", "node"], ["i_conv", "i_node"]), "left_anti")
    order = Window.partitionBy("conv_id").orderBy(F.desc(F.col("total") / F.col("depth")), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    marked = stored(chosen.select("conv_id", F.col("node").alias("leaf"), "rank", "node"), "chosen-leaves")
    for jumps in reversed(levels):
        jumps = jumps.select(F.col("conv_id").alias("j_conv"), F.col("node").alias("j_node"), "to")
        up = marked.join(jumps, _same(["conv_id", "node"], ["j_conv", "j_node"]))
        marked = stored(marked.union(up.select("conv_id", "leaf", "rank", F.col("to").alias("node"))), "path-nodes")
    names = messages.select(F.col("conv_id").alias("n_conv"), F.col("node").alias("n_node"), "role", "text")
    deep = depths.select(F.col("conv_id").alias("d_conv"), F.col("node").alias("d_node"), (F.col("depth") - 1).alias("position"))
    found = marked.join(deep, _same(["conv_id", "node"], ["d_conv", "d_node"]))
    found = found.join(names, _same(["conv_id", "node"], ["n_conv", "n_node"]))
    return found.select("conv_id", "leaf", "rank", "position", "node", "role", "text")


def formatted(chosen: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``conv_id, rank, part, text``: each chosen path as one formatted conversation, in parts of ``chunk`` characters."""
    head = F.concat(F.lit(TURN_START), escaped_role(F.col("role")), F.lit("\n"))
    turns = chosen.select("conv_id", "rank", "position", F.concat(head, escaped(F.col("text")), F.lit(TURN_END + "\n")).alias("turn"))
    kinds = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    schema = f"conv_id {kinds['conv_id']}, rank int, part bigint, text string"
    out = arrow_schema(schema)

    def run(batches):
        key, held, size, part, rows = None, [], 0, 0, []

        def cut(last: bool):
            """Hand on full parts, and at the end of a conversation what is left."""
            nonlocal held, size, part
            text = "".join(held)
            at = 0
            while len(text) - at >= chunk or last and (at < len(text) or not part):
                rows.append((*key, part, text[at:at + chunk]))
                at, part = at + chunk, part + 1
            held, size = [text[at:]], max(0, len(text) - at)

        for batch in batches:
            for conv, rank, turn in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "rank", "turn")]):
                if key != (conv, rank):
                    if key is not None:
                        cut(True)
                    key, held, size, part = (conv, rank), [], 0, 0
                held.append(turn)
                size += len(turn)
                if size >= chunk:
                    cut(False)
                if sum(len(r[3]) for r in rows[-8:]) >= chunk or len(rows) >= 1024:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)
                    rows.clear()
        if key is not None:
            cut(True)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    ordered = turns.repartition("conv_id", "rank").sortWithinPartitions("conv_id", "rank", "position")
    return map_arrow(ordered.select("conv_id", "rank", "turn"), run, schema)


def format_trees(messages: DataFrame, best: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Formatted conversations of the best paths of each tree, as a stored table."""
    return stored(formatted(paths(messages, best), chunk), "formatted")


class TurnReader:
    """Finds turns in the text of one conversation, given in parts that may be cut anywhere; holds one turn."""

    def __init__(self):
        self.open = ""

    def feed(self, part: str):
        """Role and text, as they were before formatting, of each turn that ends in this part."""
        end = TURN_END + "\n"
        text, at, start = self.open + part, 0, max(0, len(self.open) - len(end))
        while (stop := text.find(end, start)) >= 0:
            if not text.startswith(TURN_START, at):
                raise ValueError("a formatted conversation has text between its turns")
            role, line, body = text[at + len(TURN_START):stop].partition("\n")
            if not line:
                raise ValueError("a turn has no line for its role")
            yield unescape_role(role), unescape(body)
            at = start = stop + len(end)
        self.open = text[at:]

    def close(self):
        if self.open:
            raise ValueError("a formatted conversation ends inside a turn")


def read_back(conversations: DataFrame) -> DataFrame:
    """Per formatted conversation: ``conv_id, rank, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``.

    Parts stream through in order, turns are found by their marks and hashed as they come; a conversation is never
    held whole.  The digests are sequential by nature, so a conversation is read by one task, in memory that does
    not grow with it.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    ordered = conversations.repartition("conv_id", "rank").sortWithinPartitions("conv_id", "rank", "part")
    schema = f"conv_id {kind}, rank int, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    out = arrow_schema(schema)

    def run(batches):
        key, state, reader = None, None, None

        def done():
            reader.close()
            turns, loss, n, loss_chars, chars = state
            return (*key, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

        for batch in batches:
            finished = []
            for conv, rank, part in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "rank", "text")]):
                if reader is None or key != (conv, rank):
                    if reader is not None:
                        finished.append(done())
                    key, state, reader = (conv, rank), [hashlib.sha256(), hashlib.sha256(), 0, 0, 0], TurnReader()
                for role, text in reader.feed(part):
                    state[0].update(f"{role}\n{text}\n".encode())
                    if role == TRAINED_ROLE:
                        state[1].update(text.encode())
                        state[3] += len(text)
                    state[2] += 1
                state[4] += len(part)
            if finished:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*finished), out)], schema=out)
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(done(), out)], schema=out)

    return map_arrow(ordered, run, schema)


def round_trip(turns: DataFrame, **columns: str) -> DataFrame:
    """Format plain conversations (a tree with one path each) and read them back.

    Null texts and roles count as empty; null conversation ids form one conversation; repeated rows are turns of
    their own; equal turns are ordered by role and text; an empty table gives no rows; extra columns are ignored.
    """
    return read_back(format_trees(as_chains(turns, **columns))).drop("rank")
