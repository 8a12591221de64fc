"""Token-id files: one concatenated id array per shard with Elias-Fano encoded document boundaries.

Shard layout, little-endian:  magic | ids (2 bytes each if the vocabulary fits, else 4) | boundaries | document
ids | footer (JSON) | footer length (4 bytes) | magic.  Boundaries and document ids are monotone sequences in
Elias-Fano form: the low bits packed, the high bits in unary, and the bit position of every 256th one, so that
``select`` reads a few words instead of a table of 64-bit offsets.  Null document ids come first and are counted.

Documents are range-partitioned by id; each task writes the shards of its range, in order, and a manifest row for
each.  Only the manifest (one row a shard) is summed up to find where each shard starts in the whole.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from latencylab.llm.shared import SLICE_ROWS, arrow_schema, fresh_path, held, map_arrow, only, open_store, stored

MAGIC = b"EFIDS001"
SELECT_EVERY = 256
SHARD_IDS = 1 << 23  # a shard is closed once it has this many ids
CHUNKS = 400_000  # space-delimited chunks of a generation of a worker's memo; it holds two at most
LEARN_AT_ONCE = 1024  # chunks encoded together
READ_IDS = 1 << 20  # ids read at once
# Python takes these four separators for white space, the tokenizer's \s does not.
ODD_SPACE = re.compile("[\x1c-\x1f]")
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
PLAIN_BELOW = "ɐ"  # chunks of Latin letters may be encoded together


def _pack_bits(values: np.ndarray, width: int) -> bytes:
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


class EliasFano:
    """A monotone sequence of non-negative integers; ``select(i)`` returns the i-th."""

    def __init__(self, n: int, width: int, low: bytes, high: bytes, marks: np.ndarray):
        self.n, self.width, self.low, self.high, self.marks = n, width, low, high, marks

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        low = _pack_bits(values & np.uint64((1 << width) - 1), width)
        places = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
        ones = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        ones[places] = 1
        return cls(n, width, low, np.packbits(ones, bitorder="little").tobytes(), places[::SELECT_EVERY].astype(np.uint32))

    def _low(self, i: int) -> int:
        first, last = i * self.width // 8, ((i + 1) * self.width + 7) // 8
        return int.from_bytes(self.low[first:last], "little") >> (i * self.width % 8) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        place, left = int(self.marks[i // SELECT_EVERY]), i % SELECT_EVERY
        if left:  # continue behind the mark
            place += 1
            byte = self.high[place // 8] >> (place % 8)
            place_in = place // 8
            base = place
            while left > byte.bit_count():
                left -= byte.bit_count()
                place_in += 1
                byte, base = self.high[place_in], place_in * 8
            for bit in range(8):
                left -= byte >> bit & 1
                if not left:
                    place = base + bit
                    break
        return (place - i << self.width) | self._low(i)

    def blocks(self):
        """The values in order, ``SELECT_EVERY`` at a time, from each mark to the next; nothing else is expanded."""
        for k, first in enumerate(range(0, self.n, SELECT_EVERY)):
            count, start = min(SELECT_EVERY, self.n - first), int(self.marks[k])
            stop = int(self.marks[k + 1]) if k + 1 < len(self.marks) else 8 * len(self.high)
            bits = np.unpackbits(np.frombuffer(self.high[start // 8:(stop + 7) // 8], np.uint8), bitorder="little")
            places = np.flatnonzero(bits[start % 8:])[:count] + start
            values = (places - np.arange(first, first + count)).astype(np.uint64) << np.uint64(self.width)
            if self.width:
                a, b = first * self.width, (first + count) * self.width
                low = np.unpackbits(np.frombuffer(self.low[a // 8:(b + 7) // 8], np.uint8), bitorder="little")[a % 8:a % 8 + b - a]
                values |= low.reshape(count, self.width).astype(np.uint64) @ (np.uint64(1) << np.arange(self.width, dtype=np.uint64))
            yield values

    def values(self):
        """The values one by one, from a cursor over the blocks."""
        for block in self.blocks():
            yield from block.tolist()

    def decode(self) -> np.ndarray:
        ones = np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little")
        values = (np.flatnonzero(ones)[: self.n] - np.arange(self.n)).astype(np.uint64) << np.uint64(self.width)
        if self.width and self.n:
            bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little")[: self.n * self.width]
            values |= bits.reshape(self.n, self.width).astype(np.uint64) @ (np.uint64(1) << np.arange(self.width, dtype=np.uint64))
        return values

    def parts(self) -> list[bytes]:
        return [self.low, self.high, self.marks.astype("<u4").tobytes()]


def shard_bytes(ids: list[bytes], id_width: int, doc_ids: list[int | None]) -> list[bytes]:
    """The blocks of a shard file; document ids are ascending with nulls first."""
    bounds = EliasFano.encode(np.concatenate(([0], np.cumsum([len(x) // id_width for x in ids]))))
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    docs = EliasFano.encode(np.array([d - least for d in known], np.uint64))
    body = [MAGIC, *ids]
    at = sum(map(len, body))
    footer = {"docs": len(doc_ids), "nulls": len(doc_ids) - len(known), "least": least, "id_width": id_width, "ids_at": len(MAGIC)}
    for name, coded in (("bounds", bounds), ("doc_ids", docs)):
        lengths = [len(p) for p in coded.parts()]
        footer[name] = {"n": coded.n, "width": coded.width, "at": at, "lengths": lengths}
        body += coded.parts()
        at += sum(lengths)
    tail = json.dumps(footer).encode()
    return [*body, tail, struct.pack("<I", len(tail)), MAGIC]


class Shard:
    """A shard opened for range reads."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        end = self.file.read_at(4 + len(MAGIC), size - 4 - len(MAGIC))
        if end[4:] != MAGIC:
            raise ValueError(f"{uri} is not a token-id shard")
        length = struct.unpack("<I", end[:4])[0]
        self.footer = json.loads(self.file.read_at(length, size - 4 - len(MAGIC) - length))
        self.bounds, self.doc_ids = self._sequence("bounds"), self._sequence("doc_ids")

    def _sequence(self, name: str) -> EliasFano:
        spec = self.footer[name]
        data, cuts = self.file.read_at(sum(spec["lengths"]), spec["at"]), np.cumsum([0, *spec["lengths"]])
        low, high, marks = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        return EliasFano(spec["n"], spec["width"], low, high, np.frombuffer(marks, "<u4"))

    def ids(self, start: int, stop: int) -> np.ndarray:
        width = self.footer["id_width"]
        data = self.file.read_at((stop - start) * width, self.footer["ids_at"] + start * width)
        return np.frombuffer(data, f"<u{width}")

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document: two selects and one range read."""
        return self.ids(self.bounds.select(i), self.bounds.select(i + 1))

    def documents(self):
        """Yield document id, start in the shard, and ids, reading a bounded number of ids at once."""
        end = self.bounds.select(self.bounds.n - 1)
        names = itertools.chain(itertools.repeat(None, self.footer["nulls"]), (self.footer["least"] + d for d in self.doc_ids.values()))
        held, held_at = np.zeros(0, f"<u{self.footer['id_width']}"), 0
        for name, (start, stop) in zip(names, itertools.pairwise(self.bounds.values())):
            if stop > held_at + len(held):
                held, held_at = self.ids(start, max(stop, min(start + READ_IDS, end))), start
            yield name, start, held[start - held_at:stop - held_at]

    def close(self):
        self.file.close()


def _pieces(chunk: str) -> int:
    """Number of words the tokenizer cuts a chunk into."""
    if chunk.isascii() and (chunk.isalpha() or chunk[:-1].isalpha()):
        return 1 if chunk.isalpha() else 2
    return len(PIECE.findall(unicodedata.normalize("NFC", chunk).lower()))


class WordEncoder:
    """Ids of whole texts by the ``tokenizers`` library, encoding each space-delimited chunk once.

    The tokenizer drops white space and never joins what it separates, so a text's ids are those of its chunks.
    """

    def __init__(self, spec: str, end_id: int | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tokenizer.get_vocab()
        self.width = 2 if max(max(vocabulary.values(), default=0), end_id or 0) < 1 << 16 else 4
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.tail = b"" if end_id is None else end_id.to_bytes(self.width, "little")
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _coded(self, ids) -> bytes:
        return np.asarray(ids, f"<u{self.width}").tobytes()

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> None:
        plain, other = [], []
        for c in chunks:
            (plain if c.isascii() or max(c) < PLAIN_BELOW else other).append(c)
        if plain:
            ids = np.array(self._batch([" ".join(plain)])[0], np.int64)
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            pieces = np.cumsum([_pieces(c) for c in plain])
            if len(ends) and pieces[-1] == len(ends) and ends[-1] == len(ids):
                cuts = np.concatenate(([0], ends))[np.concatenate(([0], pieces))].tolist()
                data = self._coded(ids)
                w = self.width
                self.known.update((c, data[a * w:b * w]) for c, a, b in zip(plain, cuts[:-1], cuts[1:]))
            else:
                other += plain
        self.known.update((c, self._coded(ids)) for c, ids in zip(other, self._batch(other)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CHUNKS:
            self.old, self.known = self.known, {}
        chunks = [None if ODD_SPACE.search(t) else t.split() for t in texts]
        unseen = []
        for c in set().union(*filter(None, chunks)).difference(self.known):
            if (ids := self.old.get(c)) is None:
                unseen.append(c)
            else:
                self.known[c] = ids
        for at in range(0, len(unseen), LEARN_AT_ONCE):
            self._learn(unseen[at:at + LEARN_AT_ONCE])
        get = self.known.__getitem__
        whole = iter(self._batch([t for t, cs in zip(texts, chunks) if cs is None]))
        return [(self._coded(next(whole)) if cs is None else b"".join(map(get, cs))) + self.tail for cs in chunks]


MANIFEST = "part int, shard int, path string, docs bigint, ids bigint"


def write_files(
    docs: DataFrame, vocabulary: str, folder: str | None = None, end_id: int | None = None,
    id_col="doc_id", text_col="text", shard_ids: int = SHARD_IDS,
) -> DataFrame:
    """Encode the texts and write shards in ascending id order; returns the stored manifest with ``start``.

    ``vocabulary`` is the path of a tokenizer file (white space dropped, word ends marked) on the driver.
    ``folder`` must be shared by driver and executors; a fresh one in the shared folder is the default.  Null and
    empty texts have no ids but the end id.  Rows of equal id follow each other in the order of their texts;
    null ids come first; repeated rows are written again; an empty table gives no shard; ids must be integers.
    """
    spark = docs.sparkSession
    folder = (folder or fresh_path(spark, "token-ids")).rstrip("/")
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    shipped, key = spark.sparkContext.broadcast(spec), (hashlib.sha256(spec.encode()).hexdigest(), end_id)
    rows = only(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("bigint"))
    ordered = rows.repartitionByRange(F.col("id"), F.crc32("text")).sortWithinPartitions("id", "text")
    out = arrow_schema(MANIFEST)

    def run(batches):
        encoder, task = held(("words", *key), lambda: WordEncoder(shipped.value, end_id)), TaskContext.get()
        part, shard, ids, names, size = task.partitionId(), 0, [], [], 0
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)

        def close():
            path = f"{root}/part-{part:06d}-{shard:05d}.ids"
            # under another name until it is whole; a repeated attempt writes the same bytes
            draft = f"{path}.{task.taskAttemptId()}"
            with store.open_output_stream(draft) as f:
                for block in shard_bytes(ids, encoder.width, names):
                    f.write(block)
            store.move(draft, path)
            row = [[part], [shard], [f"{folder}/part-{part:06d}-{shard:05d}.ids"], [len(names)], [size]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, out)], schema=out)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                piece = batch.slice(at, SLICE_ROWS)
                coded = encoder([t or "" for t in piece.column("text").to_pylist()])
                for name, data in zip(piece.column("id").to_pylist(), coded):
                    ids.append(data)
                    names.append(name)
                    size += len(data) // encoder.width
                    if size >= shard_ids:
                        yield close()
                        shard, ids, names, size = shard + 1, [], [], 0
        if names:
            yield close()

    manifest = stored(map_arrow(ordered, run, MANIFEST), "token-manifest")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    return stored(manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "token-manifest")


READ = "id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def read_files(manifest: DataFrame) -> DataFrame:
    """Read shards back: per document ``id, start`` (ids of all documents before it), ``n_tokens`` and the CRC-32
    of its ids as little-endian unsigned 32-bit integers."""
    out = arrow_schema(READ)

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), out)], schema=out)

    def run(batches):
        for batch in batches:
            for shard in batch.to_pylist():
                opened, rows = Shard(shard["path"]), []
                for name, start, ids in opened.documents():
                    rows.append((name, shard["start"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) >= 4096:
                        yield emit(rows)
                        rows = []
                if rows:
                    yield emit(rows)
                opened.close()

    shards = manifest.count()
    return map_arrow(manifest.repartition(max(1, shards), "path"), run, READ)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int | None = None, **columns) -> DataFrame:
    return read_files(write_files(docs, vocabulary, end_id=end_id, **columns))
