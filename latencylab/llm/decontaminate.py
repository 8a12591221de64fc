"""Benchmark decontamination by template canonicalisation.

Tokens of a text are canonicalised: numbers, names (a capital inside a sentence) and units of measure (behind a
number) become typed placeholders.  Windows of ``WINDOW`` tokens are hashed twice, as they stand and as
templates, and hash-joined with the windows of the benchmark items.  Joined windows lie on a diagonal (offset of
the text against the item); a diagonal whose slots are not filled consistently (one value of the item always
replaced by the same value) does not count as a re-parameterised copy.  A text holds an item if the windows that
remain cover at least ``COVERAGE`` of the item's tokens.

Items of equal text, and items that differ in their slots' values alone, are classes: one item stands for the class, so
a text is joined with a class once, however many items share a template; ``item_classes`` has the members.

Of the corpus only windows that pass a Bloom filter of the benchmark's windows leave their task, so the shuffle
carries the passages found, not the corpus.  The filter has a fixed size whatever the benchmark's; the join
behind it is exact.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from latencylab.llm.shared import SLICE_ROWS, arrow_schema, held, map_arrow, only, stored

WINDOW = 8
COVERAGE = 0.5  # share of an item's tokens that must be found
LITERALS = 5  # tokens of a template window that are not placeholders
SHORTEST_ITEM = 5  # tokens; shorter items are no evidence and match nothing
FILTER_BITS = 26  # the Bloom filter has two to this power bits: 8 MB
VOCABULARY = 250_000  # tokens a worker remembers

# Units of measure that may follow a number.
UNITS = """
mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce
ounces ml l liter liters litre litres gallon gallons second seconds minute minutes hour hours day days week
weeks month months year years percent degree degrees dollar dollars cent cents euro euros hz khz mhz kb mb gb
watt watts volt volts joule joules meter meters metre metres kilometer kilometers kilometre kilometres
""".split()

TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
LITERAL, NUMBER, UNIT, NAME, STOP = 0, 1, 2, 3, 4
PLACEHOLDER = np.array([0, *(xxhash.xxh64_intdigest(f"<{k}>") for k in ("number", "unit", "name"))], np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary(dict):
    """Token to number; numbers index arrays of hashes, kinds and capitals."""

    def __init__(self):
        super().__init__()
        self.reset()

    def reset(self):
        self.clear()
        self.hashes, self.kinds, self.capital = array("Q"), array("b"), array("b")

    def __missing__(self, token):
        lower = token.lower()
        self.hashes.append(xxhash.xxh64_intdigest(lower))
        self.kinds.append(STOP if token in ".!?\n" else NUMBER if token[0].isdigit() else UNIT if lower in _UNITS else LITERAL)
        self.capital.append(token[0].isupper())
        self[token] = len(self)
        return len(self) - 1

    def arrays(self):
        return np.array(self.hashes, np.uint64), np.array(self.kinds, np.int8), np.array(self.capital, bool)  # copies


_UNITS = frozenset(UNITS)


def canonical(texts: list[str]) -> list[tuple[list[str], np.ndarray, np.ndarray]]:
    """For each text: its tokens, their hashes, and the kind of each (0 literal, or a placeholder's number)."""
    words = held(("template-words",), Vocabulary)
    if len(words) > VOCABULARY:
        words.reset()
    found = [TOKEN.findall(t) for t in texts]
    numbered = [np.fromiter(map(words.__getitem__, tokens), np.int64, len(tokens)) for tokens in found]
    hashes, kinds, capital = words.arrays()
    out = []
    for tokens, ids in zip(found, numbered):
        kind = kinds[ids]
        stop = kind == STOP
        first = np.append(True, stop)[:-1]  # a sentence starts here
        behind_number = np.append(False, kind == NUMBER)[:-1]
        slot = np.where(kind == NUMBER, NUMBER, 0)
        slot[(kind == UNIT) & behind_number] = UNIT
        slot[capital[ids] & ~first & (kind != NUMBER)] = NAME
        kept = ~stop
        out.append(([t for t, k in zip(tokens, kept) if k] if stop.any() else tokens, hashes[ids][kept], slot[kept]))
    return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def window_hashes(hashes: np.ndarray, size: int, salt: int) -> np.ndarray:
    """One hash for each window of ``size`` tokens."""
    n = len(hashes) - size + 1
    total = np.full(max(n, 0), np.uint64(salt * 1_000 + size))
    if n > 0:
        for k in range(size):
            total = total * STEP + _mixed(hashes[k:k + n])
    return _mixed(total)


def windows_of(hashes: np.ndarray, slots: np.ndarray, size: int):
    """Window hashes as they stand, as templates, which templates count (with a slot and enough literals), and which
    windows have no slot."""
    literal = window_hashes(hashes, size, 1)
    n = len(literal)
    is_slot = np.concatenate(([0], np.cumsum(slots > 0)))
    filled = is_slot[size:] - is_slot[:-size] if n > 0 else np.zeros(0, int)
    usable = (filled > 0) & (size - filled >= min(LITERALS, size - 1))
    if not usable.any():
        return literal, np.zeros(n, np.uint64), usable, filled == 0
    return literal, window_hashes(np.where(slots > 0, PLACEHOLDER[slots], hashes), size, 2), usable, filled == 0


WINDOW_COLUMNS = "hash bigint, at int, size int, template boolean, slots array<string>"


def forms_of(tokens: list[str], hashes: np.ndarray, slots: np.ndarray) -> tuple[str, str]:
    """Digests of a text as it stands, and as a template with the pattern of equal values among its slots."""
    numbers: dict[str, int] = {}
    pattern = [numbers.setdefault(t.lower(), len(numbers)) for t, k in zip(tokens, slots) if k > 0]
    template = np.where(slots > 0, PLACEHOLDER[slots], hashes).tobytes() + repr(pattern).encode()
    return xxhash.xxh3_128_hexdigest(hashes.tobytes()), xxhash.xxh3_128_hexdigest(template)


def _window_rows(ids, texts, tags, sizes_of, passes, with_forms):
    """Columns of the windows of some texts that pass a filter."""
    cols = {k: [] for k in ("id", "tag", "hash", "at", "size", "template", "slots", "tokens", "form")}
    for row, (tokens, hashes, slots) in enumerate(canonical(texts)):
        forms = None
        for size in sizes_of(len(tokens)):
            literal, template, usable, free = windows_of(hashes, slots, size)
            for is_template, values, hit in ((False, literal, passes(literal)), (True, template, usable & passes(template))):
                for at in np.flatnonzero(hit).tolist():
                    if with_forms:
                        forms = forms or forms_of(tokens, hashes, slots)
                    cols["form"].append(forms and forms[bool(is_template or free[at])])
                    cols["id"].append(ids[row])
                    cols["tag"].append(tags[row])
                    cols["hash"].append(int(values[at:at + 1].view(np.int64)[0]))
                    cols["at"].append(at)
                    cols["size"].append(size)
                    cols["template"].append(is_template)
                    span = range(at, at + size)
                    cols["slots"].append([tokens[k].lower() for k in span if slots[k] > 0] if is_template else [])
                    cols["tokens"].append(len(tokens))
    return cols


def _mapped(df: DataFrame, schema: str, sizes_of, passes) -> DataFrame:
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = [t or "" for t in part.column("text").to_pylist()]
                tags = [zlib.crc32(t.encode()) for t in texts]
                cols = _window_rows(part.column("id").to_pylist(), texts, tags, sizes_of, passes, "form" in out.names)
                if cols["at"]:
                    yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in out], schema=out)

    return map_arrow(df, run, schema)


def item_windows(items: DataFrame) -> DataFrame:
    """Windows of the benchmark items (``id, text``); an item shorter than a window has one of its own length.

    ``form`` is a digest of the whole item: as it stands for windows with a slot's value, else as a template.
    """
    kind = items.schema["id"].dataType.simpleString()

    def sizes_of(n):
        return [] if n < SHORTEST_ITEM else [min(WINDOW, n)]

    return _mapped(items, f"id {kind}, tokens int, form string, {WINDOW_COLUMNS}", sizes_of, lambda h: np.ones(len(h), bool))


def bloom_filter(windows: DataFrame, bits: int = FILTER_BITS) -> np.ndarray:
    """A filter of fixed size as 64-bit words; two bits a window, combined on the executors."""
    size = 1 << bits
    place = F.explode(F.array(F.col("hash").bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned("hash", 32).bitwiseAND(F.lit(size - 1))))
    words = windows.select(place.alias("p")).select(
        F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("bit")
    ).groupBy("w").agg(F.bit_or("bit").alias("bits"))
    found = np.zeros(size // 64, np.uint64)
    for row in words.toLocalIterator():
        found[row["w"]] = np.uint64(row["bits"] & (2**64 - 1))
    return found


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    mask = np.uint64(len(words) * 64 - 1)
    hit = np.ones(len(hashes), bool)
    for p in (hashes & mask, (hashes >> np.uint64(32)) & mask):
        hit &= (words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _classes(windows: DataFrame) -> DataFrame:
    """``template, form, first, n_items``: the smallest item of each class and the number of its items."""
    items = windows.select("template", "form", "id").distinct()
    return items.groupBy("template", "form").agg(F.min("id").alias("first"), F.count("*").alias("n_items"))


def _of_representatives(windows: DataFrame) -> DataFrame:
    """The windows of the items that stand for their class, with ``n_items``."""
    joined = windows.join(_classes(windows), ["template", "form"]).where(F.col("id").eqNullSafe(F.col("first")))
    return joined.drop("first", "form").distinct()


def item_classes(benchmark: DataFrame, item_col="item_id", item_text_col="text") -> DataFrame:
    """``item_id, first``: the items that stand for an item, by equal text or by equal template."""
    windows = item_windows(only(benchmark, id=item_col, text=item_text_col)).select("template", "form", "id").distinct()
    return windows.join(_classes(windows), ["template", "form"]).select(F.col("id").alias("item_id"), "first").distinct()


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text",
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per document and class of items it holds: ``id, tag, item_id, item_tokens, found_tokens, literal, n_items``.

    ``item_id`` is the smallest of the class, ``n_items`` its size: items of equal text for windows with a slot's value,
    items of equal template for the other ones.  ``tag`` is the CRC-32 of the text, which tells texts of equal id apart; ``literal`` is false if only template
    windows matched.  Null and empty texts hold nothing; items under ``SHORTEST_ITEM`` tokens match nothing;
    repeated rows of a table count once; an empty table on either side gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    windows = stored(item_windows(only(benchmark, id=item_col, text=item_text_col)).distinct(), "item-windows")
    windows = stored(_of_representatives(windows), "class-windows")
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]  # WINDOW and shorter: a few
    words = spark.sparkContext.broadcast(bloom_filter(windows))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, tag bigint, {WINDOW_COLUMNS}"
    found = _mapped(
        only(docs, id=id_col, text=text_col), schema, lambda n: [s for s in sizes if s <= n],
        lambda h: in_filter(words.value, h),
    )
    found = found.withColumnsRenamed({"at": "doc_at", "slots": "doc_slots"})
    windows = windows.withColumnsRenamed({"id": "item_id", "tokens": "item_tokens"})
    aligned = found.join(windows, ["hash", "size", "template"]).withColumn("diagonal", F.col("doc_at") - F.col("at"))
    aligned = stored(aligned.where(F.size("slots") == F.size("doc_slots")), "aligned")

    line = ["id", "tag", "item_id", "diagonal"]
    filled = aligned.where("template").select(*line, F.explode(F.arrays_zip("slots", "doc_slots")).alias("pair"))
    filled = filled.select(*line, F.col("pair.slots").alias("was"), F.col("pair.doc_slots").alias("is")).distinct()
    clash = filled.groupBy(*line, "was").count().where("count > 1").select(*[F.col(c).alias(f"clash_{c}") for c in line]).distinct()
    same = F.lit(True)
    for c in line:
        same &= F.col(c).eqNullSafe(F.col(f"clash_{c}"))
    plain, template = aligned.where(~F.col("template")), aligned.where("template").join(clash, same, "left_anti")
    kept = plain.unionByName(template)
    spots = F.explode(F.sequence("at", F.col("at") + F.col("size") - 1)).alias("spot")
    cover = kept.select("id", "tag", "item_id", "item_tokens", "template", "n_items", spots).groupBy("id", "tag", "item_id", "item_tokens").agg(
        F.countDistinct("spot").alias("found_tokens"), F.min("template").alias("only_template"), F.max("n_items").alias("n_items")
    )
    return cover.where(F.col("found_tokens") >= F.lit(coverage) * F.col("item_tokens")).select(
        "id", "tag", "item_id", "item_tokens", F.col("found_tokens").cast("int").alias("found_tokens"),
        (~F.col("only_template")).alias("literal"), "n_items",
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """The rows of the table, all columns, whose text holds no benchmark item."""
    bad = leaks(docs, benchmark, id_col, text_col, **options).select(F.col("id").alias("bad_id"), F.col("tag").alias("bad_tag")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text, key = F.col("row")[text_col], F.col("row")[id_col]
    on = key.eqNullSafe(F.col("bad_id")) & (F.crc32(F.coalesce(text, F.lit(""))) == F.col("bad_tag"))
    return rows.join(bad, on, "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])
