"""WARC archives and a two-level capture index.

Archives hold one gzip member per record.  Of records with equal payloads of
at least ``REVISIT_BYTES``, that with the smallest id is a response and the
others are revisits, which have its headers but no payload.

The index sorts captures by their URL with the host reversed.  Its lines are
compressed in blocks; each shard of it has a sparse directory with the first
key of every block; a short list, small enough to travel with a task, has the
first key of every shard.  A lookup bisects the list, the directory and the
block, and reads just the block's and then the record's range of bytes.

Defined results: a null payload is an empty one; a null URL has the empty key
and no target in its record; a null id is smaller than no other and never
referred to, so its record is a response unless an id has the same payload;
rows that share the smallest id are all responses; other columns are ignored;
an empty table gives empty archives and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import HOT_GROUPS, HOT_ROWS, StoreWriter, batches_of, materialise, open_store, read_range, rows_of, shared_dir

REVISIT_BYTES = 100
#: Lines of a compressed block of the index.
BLOCK_LINES = 1000
#: Bytes of records that a task reads, about, once there is enough for all tasks.
READ_BYTES = 64 << 20

# Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def reversed_host_key(url: str | None) -> str:
    """``com,example)/path?query`` of a URL: no scheme, user, ``www.``, default port or fragment, all in lower case."""
    if not url:
        return ""
    clean = _CONTROL.sub(lambda m: quote(m[0]), url.strip())
    try:
        parts = urlsplit(clean)
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return clean.lower()
    if not host:
        return clean.lower()
    host = re.sub(r"^www\d*\.", "", host)
    labels = host if ":" in host else ",".join(reversed(host.split(".")))
    shown = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return f"{labels}{shown}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


# ---- records

def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return VERSION + b"\r\n" + head + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    headers = [("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", _CONTROL.sub(lambda m: quote(m[0]), url)))
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return record("response" if refers_to is None else "revisit", headers, http if refers_to is not None else http + payload)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of the record that ``data`` begins with."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not gap or not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    if len(block) < int(headers["content-length"]):
        raise ValueError("a WARC record is cut short")
    return headers, block


def _page_of(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if text in ("", "None") else int(text)


def read_page(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    """(page id, payload bytes, payload digest, record type, refers to) of a record; a revisit's headers speak for its payload."""
    headers, block = parse_record(data)
    http, _, payload = block.partition(b"\r\n\r\n")
    if headers["warc-type"] == "response":
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        if headers["warc-payload-digest"] != f"sha256:{digest}":
            raise ValueError("a payload doesn't fit its digest")
    else:
        size, digest = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", http)[1]), headers["warc-payload-digest"].removeprefix("sha256:")
    return _page_of(headers["warc-record-id"]), size, digest, headers["warc-type"], _page_of(headers.get("warc-refers-to"))


# ---- archives

def write_archives(df: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row, an archive per task; return the captures (key, id, file, offset, length)."""
    folder = shared_dir(df.sparkSession)
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = df.select(F.col(id_col).alias("i"), F.col(url_col).alias("u"), payload.alias("p"), F.sha2(payload.cast("binary"), 256).alias("d"), F.octet_length(payload).alias("n"))
    firsts = rows.where(F.col("n") >= REVISIT_BYTES).groupBy("d").agg(F.min("i").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null")
    firsts = materialise(firsts)
    # Payloads with very many copies, of which there are few, are known to all tasks.  Their rows, and those too short to be
    # a revisit, go where the hash of all of the row's own values sends them, so no payload fills a task.
    many = max(HOT_ROWS, df.count() // HOT_GROUPS)
    hot = F.broadcast(firsts.where(F.col("copies") > many).select("d", F.col("first").alias("hot")))
    alone = F.concat_ws(" ", "d", "i", "u")
    keyed = rows.join(hot, "d", "left").withColumn("k", F.when(F.col("hot").isNull() & (F.col("n") >= REVISIT_BYTES), F.col("d")).otherwise(alone))
    first = F.coalesce("hot", "first")
    typed = keyed.join(firsts.where(F.col("copies") <= many).select(F.col("d").alias("k"), "first"), "k", "left")
    typed = typed.select("i", "u", "p", "d", F.when(F.col("i").isNull() | (F.col("i") > first), first).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, found = None, []
        for i, url, text, digest, refers in rows_of(batches, "i", "u", "p", "d", "r"):
            if out is None:
                out = StoreWriter(folder, ".warc.gz")
                out.write(gzip.compress(record("warcinfo", [("WARC-Record-ID", f"<urn:archive:{out.uri.rpartition('/')[2]}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"), mtime=0))
            start = out.size
            out.write(gzip.compress(page_record(i, url, text.encode(), digest, refers, date), 6, mtime=0))
            found.append((reversed_host_key(url), i, out.uri, start, out.size - start))
        if out:
            out.close()
        yield from batches_of(iter(found), pa.schema([("key", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    return materialise(typed.mapInArrow(run, "key string, id long, file string, offset long, length long"))


# ---- the index

class CaptureIndex:
    """``shards``: (first key, directory file) in key order, one for each task that wrote a part of the index."""

    def __init__(self, shards: list[tuple[bytes, str]]):
        self.shards = shards
        self.firsts = [k for k, _ in shards]

    @classmethod
    def build(cls, captures: DataFrame, block_lines: int = BLOCK_LINES) -> CaptureIndex:
        folder = shared_dir(captures.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out, directory, lines = None, [], []

            def flush() -> None:
                data = gzip.compress(b"\n".join(lines), 6, mtime=0)
                directory.append(b"%s\t%d\t%d" % (lines[0].partition(b"\t")[0], out.size, len(data)))
                out.write(data)
                lines.clear()

            for key, i, file, offset, length in rows_of(batches, "key", "id", "file", "offset", "length"):
                out = out or StoreWriter(folder, ".cdx.gz")
                lines.append(f"{key}\t{'' if i is None else i}\t{file}\t{offset}\t{length}".encode())
                if len(lines) == block_lines:
                    flush()
            if out:
                if lines:
                    flush()
                out.close()
                at = StoreWriter(folder, ".directory")
                at.write(b"\n".join([out.uri.encode(), *directory]))
                yield pa.RecordBatch.from_pydict({"first": [directory[0].partition(b"\t")[0]], "last": [key.encode()], "directory": [at.close()]})

        sorted_rows = captures.repartitionByRange("key", "id", "file", "offset").sortWithinPartitions("key", "id", "file", "offset")
        shards = materialise(sorted_rows.mapInArrow(run, "first binary, last binary, directory string")).collect()  # one for each task
        return cls([(bytes(r["first"]), r["directory"]) for r in sorted(shards, key=lambda r: (bytes(r["first"]), bytes(r["last"])))])

    def blocks(self, key: str) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of the blocks that can have a key's captures."""
        want = key.encode()
        # A key may begin in the shard before the first that starts with it, and go on in later ones.
        for at in range(max(0, bisect_left(self.firsts, want) - 1), bisect_right(self.firsts, want)):
            file, firsts, ranges = _directory(self.shards[at][1])
            for block in range(max(0, bisect_left(firsts, want) - 1), bisect_right(firsts, want)):
                yield file, *ranges[block]

    def find(self, key: str) -> Iterator[tuple[str, int | None, str, int, int]]:
        """(key, id, file, offset, length) of a key's captures."""
        for block in self.blocks(key):
            yield from captures_in(key, *block)


def captures_in(key: str, file: str, offset: int, length: int) -> Iterator[tuple[str, int | None, str, int, int]]:
    """A key's captures in a block, whose lines are bisected."""
    want, lines = key.encode(), _block(file, offset, length)
    for k in range(bisect_left(lines, want + b"\t"), len(lines)):
        own, i, archive, at, size = lines[k].split(b"\t")
        if own != want:
            return
        yield key, int(i) if i else None, archive.decode(), int(at), int(size)


@lru_cache(maxsize=4)
def _directory(uri: str) -> tuple[str, list[bytes], list[tuple[int, int]]]:
    fs, path = open_store(uri)
    with fs.open_input_stream(path) as f:
        file, *lines = f.read().split(b"\n")
    rows = [x.split(b"\t") for x in lines]
    return file.decode(), [r[0] for r in rows], [(int(r[1]), int(r[2])) for r in rows]


@lru_cache(maxsize=8)
def _block(uri: str, offset: int, length: int) -> list[bytes]:
    return gzip.decompress(read_range(uri, offset, length)).split(b"\n")


def look_up(index: CaptureIndex, urls: DataFrame, url_col: str = "url") -> DataFrame:
    """The captures of each row's URL.

    Keys are looked up in key order, so they share directories; what they need
    is dealt by block, so a key with very many captures is read by many tasks.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(((reversed_host_key(u),) for (u,) in rows_of(batches, "u")), pa.schema([("key", pa.string())]))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((key, *block) for (key,) in rows_of(batches, "key") for block in index.blocks(key))
        yield from batches_of(found, pa.schema([("key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (x for row in rows_of(batches, "key", "file", "offset", "length") for x in captures_in(*row))
        yield from batches_of(found, pa.schema([("key", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    asked = urls.select(F.col(url_col).alias("u")).mapInArrow(keys, "key string").distinct()
    located = asked.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(locate, "key string, file string, offset long, length long")
    dealt = located.repartition("file", "offset").sortWithinPartitions("file", "offset", "key")
    return dealt.mapInArrow(run, "key string, id long, file string, offset long, length long")


def read_captures(captures: DataFrame, id_col: str = "page_id") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of captures, each by a range read of its record.

    Tasks are dealt by the bytes of the records, not by those of the captures.
    """
    captures = materialise(captures.select("file", "offset", "length"))
    size = captures.agg(F.sum("length")).first()[0] or 0
    slots = 4 * captures.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, -(-size // READ_BYTES), min(slots, -(-size // (1 << 20))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (read_page(zlib.decompress(read_range(*x), 31)) for x in rows_of(batches, "file", "offset", "length"))
        yield from batches_of(rows, pa.schema([("i", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]))

    spread = captures.repartition(tasks, "file", "offset")  # a URL with many captures is read by many tasks
    return spread.mapInArrow(run, "i long, payload_bytes long, payload_digest string, record_type string, refers_to long").withColumnRenamed("i", id_col)
