"""Document fingerprints by one-permutation MinHash with optimal densification and packed low bits.

The shingles of a text are hashed once.  The top bits of a hash choose one of ``BINS`` bins, each bin keeps its
least hash, and an empty bin takes the value of the first filled bin on its own pseudo-random walk (the walk
depends on the bin and the attempt only, so equal bins of two texts walk alike).  The low ``KEPT_BITS`` bits of
each bin are stored.  Likeness is the share of equal bins, corrected for those that agree by chance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from latencylab.llm.shared import SLICE_ROWS, arrow_schema, held, map_arrow, only, per_batch, stored

SHINGLE_WORDS = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
KEPT_BITS = 4  # two bins a byte
WALK = 4096  # attempts; then the next filled bin in cyclic order
WORDS = 500_000  # word hashes a worker remembers
EMPTY = b""  # fingerprint of a text without a word
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


DONORS = (_mixed(np.arange(1, WALK * BINS + 1, dtype=np.uint64)) >> np.uint64(64 - BIN_BITS)).astype(np.uint8).reshape(WALK, BINS)
BIN_SALT = np.arange(BINS, dtype=np.uint64) * STEP
BOUNDS = np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BIN_BITS)


class _Words(dict):
    def __missing__(self, word):
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_hashes(text: str, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the shingles of lower-cased, space-delimited words; a shorter text is one shingle."""
    known = held(("word-hashes",), _Words)
    if len(known) > WORDS:
        known.clear()
    tokens = text.lower().split()
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(h))
    if not size:
        return h
    total = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        total = total * STEP + h[k:k + len(total)]
    return _mixed(total)


def sketch(hashes: np.ndarray) -> np.ndarray | None:
    """Least hash of each bin, densified; None without a hash."""
    if not len(hashes):
        return None
    ordered = np.sort(hashes)
    first = np.searchsorted(ordered, BOUNDS)
    least = ordered[np.minimum(first, len(ordered) - 1)]
    filled = (first < len(ordered)) & (least >> np.uint64(64 - BIN_BITS) == np.arange(BINS, dtype=np.uint64))
    out, empty, at = least.copy(), np.flatnonzero(~filled), 0
    for block in (8, 56, 448, WALK - 512):
        if not len(empty):
            return out
        donors = DONORS[at:at + block, empty]
        hit = filled[donors]
        found = hit.any(axis=0)
        out[empty[found]] = least[donors[hit.argmax(axis=0)[found], np.flatnonzero(found)]]
        empty, at = empty[~found], at + block
    for i in empty:  # practically never
        out[i] = least[next(j for k in range(1, BINS) if filled[j := (i + k) % BINS])]
    return out


def fingerprint(text: str | None) -> bytes:
    """Packed low bits of the sketch; ``EMPTY`` for a text without a word."""
    least = sketch(shingle_hashes(text or ""))
    if least is None:
        return EMPTY
    # mixed with the bin's number, so that a value copied to many bins agrees by chance in each alone
    low = (_mixed(least + BIN_SALT) & np.uint64((1 << KEPT_BITS) - 1)).astype(np.uint8)
    return (low[0::2] << KEPT_BITS | low[1::2]).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Estimated Jaccard similarity (0 to 1): equal bins less the share expected by chance; 1 if both are empty."""
    if not a or not b:
        return float(a == b)
    differ = np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)
    equal = np.count_nonzero(differ >> KEPT_BITS == 0) + np.count_nonzero(differ & ((1 << KEPT_BITS) - 1) == 0)
    chance = 0.5 ** KEPT_BITS
    return float(min(1.0, max(0.0, (equal / BINS - chance) / (1 - chance))))


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``id, fingerprint (binary)`` of every row; null, empty and wordless texts have an empty fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(rows):
        return {"id": rows["id"], "fingerprint": [fingerprint(t) for t in rows["text"]]}

    return per_batch(only(docs, id=id_col, text=text_col), f"id {kind}, fingerprint binary", work)


def edited(text: str, following: str) -> str:
    """The second half of a text replaced by as much of the beginning of another."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


RESULT = "n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(text: str, own: bytes, following: str, other: bytes) -> tuple:
    changed = edited(text, following)
    print_of = fingerprint(changed)
    return len(text), hashlib.sha256(changed.encode()).hexdigest(), own, print_of, likeness(own, print_of), likeness(own, other)


def against_next(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """Each text, in descending id order, against its edited form and the next text (after the last, the first).

    Columns ``id`` and those of ``RESULT``.  One range shuffle puts neighbours together; a task completes every
    row but the last of its range, whose successor opens the next range, and these few rows, one a task, are
    completed by a join of range numbers.  Null texts count as empty, null ids come last, rows of equal id follow
    in the order of their texts, a single row is its own successor, and an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = only(docs, id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    keys = [F.col("id").desc_nulls_last(), F.crc32("text")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, "text")
    schema = f"part int, role string, id {kind}, text string, {RESULT}"
    out = arrow_schema(schema)
    blank = (None,) * (len(out) - 4)

    def run(batches):
        part, last = TaskContext.get().partitionId(), None
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece, made = batch.slice(at, SLICE_ROWS), []
                for name, text in zip(piece.column("id").to_pylist(), piece.column("text").to_pylist()):
                    own = fingerprint(text)
                    if last is None:
                        made.append((part, "first", name, text, *blank))
                    else:
                        made.append((part, "done", last[0], None, *_compared(last[1], last[2], text, own)))
                    last = name, text, own
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)
        if last is not None:
            row = (part, "last", last[0], last[1], *blank)
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, out)], schema=out)

    made = stored(map_arrow(ordered, run, schema), "neighbours")
    lasts = made.where("role = 'last'").select("part", "id", "text")
    parts = lasts.select("part")  # one number for each range
    around = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part")))
    follow = stored(parts.select("part", around.alias("next_part")), "ranges")
    firsts = made.where("role = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))
    open_rows = lasts.join(follow, "part").join(firsts, "next_part").select("id", "text", "following")

    def complete(rows):
        found = [_compared(t, fingerprint(t), n, fingerprint(n)) for t, n in zip(rows["text"], rows["following"])]
        return {"id": rows["id"], **dict(zip(out.names[4:], map(list, zip(*found))))}

    closed = per_batch(open_rows, f"id {kind}, {RESULT}", complete)
    return made.where("role = 'done'").select(closed.columns).unionByName(closed)


def as_text(found: DataFrame) -> DataFrame:
    """Fingerprints as lower-case hex digits."""
    names = ("fingerprint", "edited_fingerprint")
    return found.withColumns({n: F.lower(F.hex(n)) for n in names})
