"""WARC archives of pages with a two-level capture index.

Archives: one gzip member a record.  Of pages with equal payloads only the one of smallest id stores the payload
(``response``); the others are ``revisit`` records that name it and carry the payload's digest and length.

Index: captures sorted by reversed-host URL key, in shards by key range.  A shard is a row of compressed blocks of
``BLOCK_LINES`` lines and, behind them, a sparse directory with the first key, place and length of each block.  A
lookup binary-searches the shards' key ranges, then a shard's directory, reads one block by range, and then the
records by range.

Shuffles: digests (combined before the shuffle) to find equal payloads, the pages once by digest for the join with
these, and the captures, a few hundred bytes each, by key.  Archives are written where the join leaves the pages.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import re
import struct
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from latencylab.llm.shared import SLICE_ROWS, arrow_schema, fresh_path, map_arrow, only, open_store, stored

SHARED_BYTES = 100  # payloads of this size or more are stored once
ARCHIVE_BYTES = 32 << 20  # an archive is closed once it has this many bytes
BLOCK_LINES = 300
READ_BYTES = 4 << 20  # neighbouring records read at once
HELD_DIRECTORIES = 64
CAPTURED_AT = "2000-01-01T00:00:00Z"  # the tables carry no capture time
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
MAGIC = b"CAPIDX01"


def url_key(url: str | None) -> str:
    """Reversed host, then port, path and query: ``com,example,www)/path?x=1``; no scheme, user or fragment."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in map(rest.find, "/?") if i >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:] or "/"
    name, _, port = host.partition(":")
    key = ",".join(reversed(name.split("."))) + (f":{port}" if port not in ("", "80", "443") else "") + ")" + path
    return UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", key)


def record(page: dict) -> bytes:
    """One record as a gzip member; ``payload`` is None for a revisit."""
    revisit = page["payload"] is None
    head = [
        "WARC/1.0",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:x-page:{page['id']}>",
        f"WARC-Date: {CAPTURED_AT}",
        f"WARC-Target-URI: {UNSAFE.sub(lambda m: f'%{ord(m[0]):02X}', page['url'] or '')}",
        f"WARC-Payload-Digest: sha256:{page['digest']}",
        f"X-Payload-Length: {page['bytes']}",
    ]
    if revisit:
        head.append(f"WARC-Refers-To: <urn:x-page:{page['refers_to']}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest")
    block = HTTP + b"\r\n" + (page["payload"] or b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> dict:
    """Header fields (lower case), and the payload as ``payload``, of one record."""
    data = gzip.decompress(member)
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    block = block[: int(fields["content-length"])]
    return fields | {"payload": block.partition(b"\r\n\r\n")[2]}


def _page_of(urn: str | None) -> int | None:
    name = urn and urn[len("<urn:x-page:"):-1]
    return None if name in (None, "None") else int(name)


def typed(pages: DataFrame) -> DataFrame:
    """``id, url, html`` with ``digest, bytes, refers_to``; ``html`` is null and ``refers_to`` set for revisits."""
    html = F.coalesce("html", F.lit(""))
    digested = pages.select("id", "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).cast("bigint").alias("bytes"))
    large = digested.where(F.col("bytes") >= SHARED_BYTES).groupBy("digest").agg(F.min("id").alias("first_id"), F.count("*").alias("n"))
    firsts = stored(large.where("n > 1 and first_id is not null").select("digest", "first_id"), "first-captures")
    joined = digested.join(firsts, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "id", "url", "digest", "bytes", F.when(again, F.col("first_id")).alias("refers_to"), F.when(~again, F.col("html")).alias("html")
    )


CAPTURE = "key string, id bigint, type string, file string, at bigint, length bigint"


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the archives; returns the stored captures: key, id, type, and where each record lies."""
    out = arrow_schema(CAPTURE)

    def run(batches):
        task = TaskContext.get()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        part, n, blocks, size, rows = task.partitionId(), 0, [], 0, []

        def close():
            name = f"part-{part:06d}-{n:05d}.warc.gz"
            draft = f"{root}/{name}.{task.taskAttemptId()}"  # renamed once whole
            with store.open_output_stream(draft, compression=None) as f:
                for b in blocks:
                    f.write(b)
            store.move(draft, f"{root}/{name}")
            made = [(k, i, t, f"{folder}/{name}", at, length) for k, i, t, at, length in rows]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), out)], schema=out)

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                for page in batch.slice(at, SLICE_ROWS).to_pylist():
                    page["payload"] = None if page["html"] is None else page["html"].encode()
                    member = record(page)
                    kind = "revisit" if page["payload"] is None else "response"
                    rows.append((url_key(page["url"]), page["id"], kind, size, len(member)))
                    blocks.append(member)
                    size += len(member)
                    if size >= ARCHIVE_BYTES:
                        yield close()
                        n, blocks, size, rows = n + 1, [], 0, []
        if rows:
            yield close()

    return stored(map_arrow(typed(pages), run, CAPTURE), "captures")


SHARD = "part int, path string, first_key string, last_key string, captures bigint, blocks bigint"


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index of some captures; returns the stored table of shards."""
    ordered = captures.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    out = arrow_schema(SHARD)

    def run(batches):
        task = TaskContext.get()
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        part, lines, directory, at, captures_seen, last = task.partitionId(), [], [], len(MAGIC), 0, None
        path = f"{root}/part-{part:06d}.idx"
        draft, f = f"{path}.{task.taskAttemptId()}", None

        def block():
            data = zlib.compress("\n".join(f"{r['key']}\t{json.dumps(r)}" for r in lines).encode())
            directory.append((lines[0]["key"], at, len(data)))
            f.write(data)
            return at + len(data)

        for batch in batches:
            for row in batch.to_pylist():
                if f is None:
                    f = store.open_output_stream(draft, compression=None)
                    f.write(MAGIC)
                lines.append(row)
                captures_seen, last = captures_seen + 1, row["key"]
                if len(lines) == BLOCK_LINES:
                    at, lines = block(), []
        if f is None:
            return
        if lines:
            at = block()
        sparse = zlib.compress(json.dumps(directory).encode())
        f.write(sparse + struct.pack("<Q", len(sparse)) + MAGIC)
        f.close()
        store.move(draft, path)
        row = part, f"{folder}/part-{part:06d}.idx", directory[0][0], last, captures_seen, len(directory)
        yield pa.RecordBatch.from_arrays([pa.array([v], g.type) for v, g in zip(row, out)], schema=out)

    return stored(map_arrow(ordered, run, SHARD), "index-shards")


class IndexShard:
    """An index shard opened for range reads; holds its sparse directory."""

    def __init__(self, uri: str):
        store, path = open_store(uri)
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is not an index shard")
        length = struct.unpack("<Q", tail[:8])[0]
        self.directory = json.loads(zlib.decompress(self.file.read_at(length, size - 8 - len(MAGIC) - length)))
        self.keys = [d[0] for d in self.directory]

    def block(self, n: int) -> list[dict]:
        _, at, length = self.directory[n]
        return [json.loads(line.partition("\t")[2]) for line in zlib.decompress(self.file.read_at(length, at)).decode().split("\n")]

    def candidates(self, key: str) -> range:
        """Blocks that can hold a key, by binary search in the sparse directory; no block is read."""
        return range(max(0, bisect.bisect_left(self.keys, key) - 1), bisect.bisect_right(self.keys, key))


def matching(lines: list[dict], key: str):
    """Captures of a key in a block, by binary search."""
    at = bisect.bisect_left(lines, key, key=lambda r: r["key"])
    while at < len(lines) and lines[at]["key"] == key:
        yield lines[at]
        at += 1


class _Shards:
    """Index shards a task has open, a bounded number at a time."""

    def __init__(self):
        self.held: dict[str, IndexShard] = {}

    def __call__(self, path: str) -> IndexShard:
        if path not in self.held:
            if len(self.held) >= HELD_DIRECTORIES:
                self.held.pop(next(iter(self.held))).file.close()
            self.held[path] = IndexShard(path)
        return self.held[path]


def url_keys(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``url, key`` of some URLs."""
    schema = "url string, key string"
    out = arrow_schema(schema)

    def run(batches):
        for batch in batches:
            urls = batch.column("url")
            yield pa.RecordBatch.from_arrays([urls, pa.array([url_key(u) for u in urls.to_pylist()], pa.string())], schema=out)

    return map_arrow(only(urls, url=url_col), run, schema)


def search(shards: DataFrame, keys: DataFrame) -> DataFrame:
    """The captures of some distinct keys, one row each; keys without a capture give none.

    Keys are searched in the shards' ranges (the driver holds one a shard), then in the sparse directories, which
    gives the blocks that can hold them.  Each such block is read once, by range, and searched for its keys; a key with
    very many captures is spread over its blocks.
    """
    ranges = sorted((r["first_key"], r["last_key"], r["path"]) for r in shards.select("first_key", "last_key", "path").collect())
    lasts = [r[1] for r in ranges]
    probe = "key string, path string, block int"
    probe_out, out = arrow_schema(probe), arrow_schema(CAPTURE)

    def locate(batches):
        opened = _Shards()
        for batch in batches:
            found = []
            for key in batch.column("key").to_pylist():
                for first, _, path in ranges[bisect.bisect_left(lasts, key):]:
                    if first > key:
                        break
                    found += [(key, path, n) for n in opened(path).candidates(key)]
                if len(found) >= SLICE_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), probe_out)], schema=probe_out)
                    found = []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), probe_out)], schema=probe_out)

    def fetch(batches):
        opened, now, lines = _Shards(), None, []
        for batch in batches:
            found = []
            for key, path, n in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                if now != (path, n):
                    now, lines = (path, n), opened(path).block(n)
                found += matching(lines, key)
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=out)

    probes = map_arrow(keys.select("key").repartitionByRange("key").sortWithinPartitions("key"), locate, probe)
    return map_arrow(probes.repartition("path", "block").sortWithinPartitions("path", "block"), fetch, CAPTURE)


def lookup(shards: DataFrame, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """``url`` with the columns of its captures, one row each; urls without a capture give none."""
    wanted = stored(url_keys(urls, url_col).distinct(), "wanted-urls")
    return wanted.join(search(shards, wanted.select("key").distinct()), "key").select("url", *[f.name for f in arrow_schema(CAPTURE)])


RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def read_records(captures: DataFrame) -> DataFrame:
    """The records of some captures, read from the archives by range, neighbours together.

    Digest and length are those of the payload read; a revisit has none and states both in its header.
    """
    placed = stored(captures.select("file", "at", "length"), "placed-records")
    archives = placed.select("file").distinct().count()
    files = placed.repartition(max(1, archives), "file").sortWithinPartitions("file", "at")
    out = arrow_schema(RECORD)

    def rows(data: bytes, base: int, spans: list[tuple[int, int]]):
        for at, length in spans:
            fields = parse(data[at - base:at - base + length])
            payload, revisit = fields["payload"], fields["warc-type"] == "revisit"
            digest = fields["warc-payload-digest"].partition(":")[2] if revisit else hashlib.sha256(payload).hexdigest()
            size = int(fields["x-payload-length"]) if revisit else len(payload)
            yield _page_of(fields["warc-record-id"]), size, digest, fields["warc-type"], _page_of(fields.get("warc-refers-to")), fields["warc-target-uri"]

    def read(f, spans):
        base, end = spans[0][0], spans[-1][0] + spans[-1][1]
        made = list(rows(f.read_at(end - base, base), base, spans))
        return pa.RecordBatch.from_arrays([pa.array(c, g.type) for c, g in zip(zip(*made), out)], schema=out)

    def run(batches):
        name, f, spans = None, None, []
        for batch in batches:
            for file, at, length in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                apart = spans and (file != name or at != spans[-1][0] + spans[-1][1] or at + length - spans[0][0] > READ_BYTES)
                if apart:
                    yield read(f, spans)
                    spans = []
                if file != name:
                    if f:
                        f.close()
                    store, path = open_store(file)
                    name, f = file, store.open_input_file(path)
                spans.append((at, length))
        if spans:
            yield read(f, spans)

    return map_arrow(files, run, RECORD)


def archive(pages: DataFrame, folder: str | None = None, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Write archives and index of a page table; returns the stored index shards.

    Null html is an empty payload; null urls have the empty key; a null id is never referred to.  Rows that share
    both id and payload are all responses if the id is the smallest of its payload.  An empty table gives an empty
    index; extra columns are ignored.
    """
    folder = (folder or fresh_path(pages.sparkSession, "archives")).rstrip("/")
    rows = only(pages, id=id_col, url=url_col, html=html_col).withColumn("id", F.col("id").cast("bigint"))
    return write_index(write_archives(rows, f"{folder}/warc"), f"{folder}/index")


def verified(records: DataFrame) -> DataFrame:
    """The records; a revisit whose length and digest are not those of the response it names is an error."""
    named = records.where("record_type = 'response'").select(
        F.col("page_id").alias("named_id"), F.col("payload_digest").alias("named_digest"), F.col("payload_bytes").alias("named_bytes")
    ).distinct()
    on = (F.col("refers_to") == F.col("named_id")) & (F.col("payload_digest") == F.col("named_digest")) & (F.col("payload_bytes") == F.col("named_bytes"))
    joined = records.join(named.where(F.col("named_bytes") >= SHARED_BYTES), on, "left")
    wrong = F.concat(F.lit("revisit "), F.col("page_id").cast("string"), F.lit(" doesn't agree with the record it names"))
    kind = F.when((F.col("record_type") == "revisit") & F.col("named_id").isNull(), F.raise_error(wrong).cast("string")).otherwise(F.col("record_type"))
    return joined.withColumn("record_type", kind).select(records.columns)


def round_trip(pages: DataFrame, url_col="url", **columns) -> DataFrame:
    """Archive some pages, look every page up by its URL's key, and read what is found back from the archives."""
    shards = archive(pages, url_col=url_col, **columns)
    keys = url_keys(pages, url_col).select("key").distinct()
    return verified(stored(read_records(search(shards, keys)), "records-read")).drop("url")
