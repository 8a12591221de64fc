"""Substring dedup by hashing normalised units of lines.

A unit is a stretch of a line between sentence ends, line ends and words with a capital, so a passage pasted
into the middle of a line still falls into the same units as its other copies.  Units are normalised and hashed
to 128 bits; digests are grouped over the whole corpus, the occurrence of lowest rank (id, then position)
stays, and later ones are marked.  Marked units are removed where neighbours that are all marked add up to
``MIN_WORDS`` words: a short sentence that two texts share by chance stays.

Two shuffles carry 32 bytes a unit: one to find the first occurrence of digests that occur twice or more
(combined before the shuffle, so a line in every document costs a row per task), one to mark the others (a
plain join that adaptive execution splits at hot digests).  Texts are shuffled once, by id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from latencylab.llm.shared import SLICE_ROWS, arrow_schema, map_arrow, only, per_batch, stored

MIN_WORDS = 20
COUNTED_WORDS = 4  # units shorter than this do not count towards MIN_WORDS
OUTER = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum()) + "…«»“”„‘’–—"
CUT = regex.compile(r"[^\S\n]*\n\s*|(?<=[.!?…])\s+|\s+(?=\p{Lu}(?!\p{Lu}))")


def cut_units(text: str) -> tuple[list[int], list[int]]:
    """Starts and ends of the units of a text, in code points; white space between units belongs to none."""
    starts, ends, at = [], [], 0
    for m in CUT.finditer(text):
        a, b = m.span()
        if a > at:
            starts.append(at)
            ends.append(a)
        at = b
    if len(text) > at:
        starts.append(at)
        ends.append(len(text))
    return starts, ends


def normal_form(unit: str) -> str:
    """Lower case, single spaces, no punctuation at either end; empty if nothing but punctuation is left."""
    return " ".join(unit.lower().split()).strip(OUTER + " ")


def text_tag(text: str) -> int:
    return zlib.crc32(text.encode())


def units(docs: DataFrame) -> DataFrame:
    """``hi, lo, id, place`` for each unit of each text; ``place`` orders the units of an id.

    ``place`` is the CRC-32 of the text in the upper and the unit's number in the lower half, so that texts
    sharing an id keep their units apart.
    """
    schema = f"hi bigint, lo bigint, id {docs.schema['id'].dataType.simpleString()}, place bigint"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                digests, rows, places = [], [], []
                for row, text in enumerate(part.column("text").to_pylist()):
                    if not text:
                        continue
                    base = text_tag(text) << 32
                    for seq, (s, e) in enumerate(zip(*cut_units(text))):
                        plain = normal_form(text[s:e])
                        if plain:
                            digests.append(xxhash.xxh3_128_digest(plain))
                            rows.append(row)
                            places.append(base + seq)
                if digests:
                    halves = np.frombuffer(b"".join(digests), ">u8").astype(np.uint64).view(np.int64).reshape(-1, 2)
                    ids = part.column("id").take(pa.array(rows))
                    place = np.array(places, np.uint64).view(np.int64)
                    columns = [pa.array(halves[:, 0]), pa.array(halves[:, 1]), ids, pa.array(place)]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out)], schema=out)

    return map_arrow(docs, run, schema)


def later_occurrences(found: DataFrame) -> DataFrame:
    """``id, place`` of every unit that is not the first of its digest."""
    first = found.groupBy("hi", "lo").agg(F.count("*").alias("n"), F.min(F.struct("id", "place")).alias("first"))
    repeated = stored(first.where("n > 1").select("hi", "lo", "first"), "repeated-units")
    joined = found.join(repeated, ["hi", "lo"])
    return joined.where(~F.struct("id", "place").eqNullSafe(F.col("first"))).select("id", "place")


def kept_spans(text: str, marked: list[int], min_words: int = MIN_WORDS) -> list[tuple[int, int]]:
    """Spans of the text that stay, given the numbers of the marked units.

    A run of neighbouring marked units goes if its units of ``COUNTED_WORDS`` or more words add up to
    ``min_words``, together with the white space behind it; a line end behind it stays if the text before it
    would otherwise run on.  Units of punctuation alone are in no digest and end a run.
    """
    if not marked:
        return [(0, len(text))] if text else []
    starts, ends = cut_units(text)
    spans, at, i, flags = [], 0, 0, set(marked)
    while i < len(starts):
        if i not in flags:
            i += 1
            continue
        j = words = 0
        for j in range(i, len(starts)):
            if j not in flags:
                break
            n = len(text[starts[j]:ends[j]].split())
            words += n if n >= COUNTED_WORDS else 0
        else:
            j = len(starts)
        if words >= min_words:
            begin, end = starts[i], starts[j] if j < len(starts) else len(text)
            if begin and text[begin - 1] != "\n" and "\n" in text[ends[j - 1]:end]:
                end = ends[j - 1]
            if begin > at:
                spans.append((at, begin))
            at = end
        i = j
    if at < len(text):
        spans.append((at, len(text)))
    return spans


def dedup(docs: DataFrame, id_col="doc_id", text_col="text", min_words: int = MIN_WORDS) -> DataFrame:
    """The table with repeated passages cut out of ``text_col``, plus ``kept``: spans of the original that stay.

    The new text is the concatenation of the kept spans (code points).  Every row stays, also one whose text
    becomes empty; a null text stays null with null spans, an empty one has none.  Rows of equal id and text
    count as one document listed twice and come out alike; rows of equal id and different text are different
    documents ordered by a checksum of the text; null ids rank first.  Other columns pass through, whatever
    their names.
    """
    columns = docs.columns
    inner = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"),
    )
    later = later_occurrences(units(only(docs, id=id_col, text=text_col)))
    marks = later.groupBy("id", F.shiftrightunsigned("place", 32).alias("tag")).agg(
        F.collect_list(F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")).alias("marked")
    )  # at most the units of one text
    marks = marks.select(F.col("id").alias("mark_id"), F.col("tag").alias("mark_tag"), "marked")
    on = F.col("id").eqNullSafe(F.col("mark_id")) & (F.crc32("text") == F.col("mark_tag"))
    joined = inner.join(marks, on, "left").select("row", "text", "marked")

    row_type = joined.schema["row"].dataType.simpleString()
    schema = f"row {row_type}, clean string, kept array<struct<start:int,end:int>>"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                texts, spans = part.column("text").to_pylist(), []
                clean = []
                for text, marked in zip(texts, part.column("marked").to_pylist()):
                    kept = None if text is None else kept_spans(text, marked or [], min_words)
                    clean.append(None if kept is None else "".join(text[s:e] for s, e in kept))
                    spans.append(kept and [{"start": s, "end": e} for s, e in kept])
                yield pa.RecordBatch.from_arrays(
                    [part.column("row").cast(out.field(0).type), pa.array(clean, pa.string()), pa.array(spans, out.field(2).type)],
                    schema=out,
                )

    made = map_arrow(joined, run, schema)
    fields = [F.col("clean").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in columns]
    return made.select(*fields, "kept")
