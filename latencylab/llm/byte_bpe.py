"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is itself a token.  Tier two:
every other pre-token is merged by rank with a heap over a doubly linked list of its bytes.  Both results are
kept per worker in bounded caches keyed by space-delimited chunks and by pre-tokens, since words repeat.

Texts are mapped independently: no shuffle, no state beyond the caches, and any task can be run again.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from heapq import heapify, heappop, heappush

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from latencylab.llm.shared import held, only, per_batch

CACHE_ENTRIES = 150_000  # per generation; each cache holds two generations at most
# A space with white space (or a text's end) on both sides: the only case where cutting before each space
# could cut inside a pre-token.
AWKWARD_SPACE = re.compile(r"(?:^|\s) (?:\s|$)")


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file (base64 token and rank on each line)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """Minimal perfect hash by displacement: n keys, n slots, one integer per first-level bucket.

    A bucket of several keys stores the seed that sends all of them to free slots; a bucket of one key
    stores its slot as a negative number.
    """

    def __init__(self, keys: list[bytes]):
        n = self.size = max(1, len(keys))
        buckets: dict[int, list[int]] = {}
        for i, key in enumerate(keys):
            buckets.setdefault(xxhash.xxh3_64_intdigest(key, 0) % n, []).append(i)
        self.shift = [0] * n
        self.key_at = [-1] * n
        several = sorted((b for b in buckets if len(buckets[b]) > 1), key=lambda b: -len(buckets[b]))
        for b in several:
            seed, members = 1, buckets[b]
            while True:
                slots = {xxhash.xxh3_64_intdigest(keys[i], seed) % n for i in members}
                if len(slots) == len(members) and all(self.key_at[s] < 0 for s in slots):
                    break
                seed += 1
            self.shift[b] = seed
            for i in members:
                self.key_at[xxhash.xxh3_64_intdigest(keys[i], seed) % n] = i
        free = (s for s in range(n) if self.key_at[s] < 0)
        for b, members in buckets.items():
            if len(members) == 1:
                slot = next(free)
                self.shift[b], self.key_at[slot] = -slot - 1, members[0]

    def candidate(self, key: bytes) -> int:
        """Index of the only key that can equal this one, or -1."""
        shift = self.shift[xxhash.xxh3_64_intdigest(key, 0) % self.size]
        return self.key_at[-shift - 1 if shift < 0 else xxhash.xxh3_64_intdigest(key, shift) % self.size]


def heap_merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: always merge the adjacent pair of lowest rank, the leftmost among equals.

    A heap entry is one integer made of rank, start and end of a pair, in this order of weight.
    """
    n, rank_of = len(piece), ranks.get
    width = n + 1
    square = width * width
    after = list(range(1, n + 2))  # start of the next part; -1 once a part has been merged away
    before = list(range(-1, n))
    heap = []
    for i in range(n - 1):
        rank = rank_of(piece[i:i + 2])
        if rank is not None:
            heap.append(rank * square + i * width + i + 2)
    heapify(heap)
    while heap:
        i, end = divmod(heappop(heap) % square, width)
        j = after[i]
        if j < 0 or after[j] != end:
            continue  # one of the two parts has changed since
        after[i], after[j] = end, -1
        if end < n:
            before[end] = i
            rank = rank_of(piece[i:after[end]])
            if rank is not None:
                heappush(heap, rank * square + i * width + after[end])
        p = before[i]
        if p >= 0:
            rank = rank_of(piece[p:end])
            if rank is not None:
                heappush(heap, rank * square + p * width + end)
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:after[i]]])
        i = after[i]
    return ids


class Memo(dict):
    """A bounded memo in two generations: a full one becomes the old one, whose hits move over again."""

    def __init__(self, make, entries: int = CACHE_ENTRIES):
        super().__init__()
        self.make, self.entries, self.old = make, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """Encoder and decoder for one vocabulary; ids are bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, tokens: list[bytes], pattern: str, cache_entries: int = CACHE_ENTRIES):
        self.tokens = tokens
        self.present = [t for t in tokens if t]
        self.ranks = {t: i for i, t in enumerate(tokens) if t}
        self.index = PerfectHash(self.present)
        self.pattern = regex.compile(pattern)
        self.pieces = Memo(self._piece, cache_entries)
        self.chunks = Memo(lambda chunk: self._whole(" " + chunk), cache_entries)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode()
        at = self.index.candidate(raw)
        if at >= 0 and self.present[at] == raw:
            return struct.pack("<I", self.ranks[raw])
        ids = heap_merge(raw, self.ranks)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a whole text.

        A pre-token can hold a space only as its first character, and the last space before a word always
        goes with the word, so a text may be cut before each such space and the chunks encoded alone.
        """
        if AWKWARD_SPACE.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        return self._whole(first) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """Encode each text and decode it again: ``id, ids (binary), n_tokens, decoded (binary)``.

    ``vocabulary`` is the path of a rank file on the driver; its tokens travel as a broadcast of about the
    file's size.  A null or empty text has no ids.  Repeated rows, null ids and extra columns are carried
    through or ignored: each input row gives one output row.
    """
    sc = docs.sparkSession.sparkContext
    tokens = read_ranks(vocabulary)
    shipped, key = sc.broadcast(tokens), (hashlib.sha256(b"\0".join(tokens)).hexdigest(), pattern)
    kind = docs.schema[id_col].dataType.simpleString()

    def work(rows):
        c = held(("byte-bpe", *key), lambda: Codec(shipped.value, pattern))
        ids = [c.encode(t) if t else b"" for t in rows["text"]]
        return {"id": rows["id"], "ids": ids, "n_tokens": [len(x) // 4 for x in ids], "decoded": [c.decode(x) for x in ids]}

    return per_batch(only(docs, id=id_col, text=text_col), f"id {kind}, ids binary, n_tokens bigint, decoded binary", work)


def digests(docs: DataFrame, vocabulary: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """SHA-256 of each text's ids and of its decoded bytes, in place of the bytes themselves.

    Columns ``id, n_tokens, ids_sha256, decoded_sha256``; null and empty texts have the digest of no bytes.
    """
    made = encode_documents(docs, vocabulary, pattern, id_col, text_col)
    return made.select(
        "id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
