"""WARC archives with a two-level capture index.

Writing: each task writes the captures of its partition as gzip members of one
archive and yields a line per capture: the reversed-host URL key, the archive and
the byte range. The lines are range-sorted by key and written as compressed
blocks of ``BLOCK_LINES``; a sparse directory keeps the first and last key and
the byte range of each block. Files are named by task attempt and only those that
a finished task has listed are ever read, so lost or repeated tasks do no harm.

Reading: wanted keys are range-sorted, so that a task needs the stretch of the
directory between its first and last key only; they are looked up there by binary
search, then in the lines of the blocks they fall in, which are read by range and
unpacked. The captures found are dealt out by the bytes they have, read by range and
checked against their digests. A key with very many captures is in many blocks, and
so in many tasks.

Defined cases: a null html is an empty payload; a null url has the empty key;
rows that share the smallest page_id of a payload are responses all of them;
repeated rows have a record each; a null page_id is never a payload's response
unless no page has one; an empty table gives no archives and an empty result; a very long
html is one record, and a task holds a few hundred at a time; other columns are
ignored, whatever their names; a url that can't stand in a header is there in
percent codes and as it is, in JSON, in a header of our own.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from bisect import bisect_left
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Appender, Ranges, Scratch, dealt, open_file, sliced, small_side, spread

LEAST_SHARED, BLOCK_LINES, LEVEL, BROADCAST_ROWS, KEYS_A_TASK = 100, 1000, 3, 1_000_000, 20_000
DATE = "2024-01-01T00:00:00Z"
CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def surt(url: str | None) -> str:
    """``http://www.a.org:80/b?c#d`` -> ``org,a,www:80)/b?c``."""
    try:
        parts = urlsplit(url or "")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").lower()
    if not host:
        return url or ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def record_id(page_id, digest: str, url: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {url}')}>"


def header_uri(url: str) -> str:
    """``url`` as it may stand in a header: visible ASCII stays, the rest in percent codes."""
    return quote(url.encode("utf-8", "surrogatepass"), safe="".join(map(chr, range(33, 127))))


def _member(head: list[str], body: bytes) -> bytes:
    raw = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(body)}"]).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def opening(name: str) -> bytes:
    """The record that tells of its archive."""
    body = b"software: maskwright\r\nformat: WARC File Format 1.1\r\n"
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], body)


def pack(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, refers_url: str | None = None) -> bytes:
    """One gzip member: a response with its payload, or a revisit without."""
    again = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, url)}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-Id: {json.dumps(page_id)}"]
    if url is not None:
        plain = header_uri(url)
        head += [f"WARC-Target-URI: {plain}"] + [f"X-Url: {json.dumps(url)}"] * (plain != url)
    if again:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest, refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {refers_to}"]
        head += [f"WARC-Refers-To-Target-URI: {header_uri(refers_url)}"] * (refers_url is not None)
    return _member([*head, "Content-Type: application/http; msgtype=response"], http if again else http + payload)


def unpack(member: bytes) -> dict:
    """The fields of a record; a response's payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b"Content-Length: ")[2])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record of page {fields['X-Page-Id']}")
    return {
        "page_id": json.loads(fields["X-Page-Id"]), "url": json.loads(fields["X-Url"]) if "X-Url" in fields else fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": int(fields["X-Refers-To-Page"]) if "X-Refers-To-Page" in fields else None, "payload": payload if kind == "response" else None,
    }


class CaptureArchive:
    """Archives, index blocks and block directory below one folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.scratch = spark, Scratch(spark, "warc")

    def write(self, pages: DataFrame) -> CaptureArchive:
        s, root = self.scratch, self.scratch.root
        rows = spread(pages).selectExpr("cast(page_id as long) page_id", "url", "coalesce(html, '') html")
        rows = rows.select("page_id", "url", "html", F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
        alike = rows.where(F.octet_length("html") >= LEAST_SHARED).groupBy("digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("n"))
        alike = s.save(alike.where("n > 1 and first is not null").select(F.col("digest").alias("d"), "first"), "alike")
        rows = rows.join(small_side(alike, BROADCAST_ROWS), F.col("digest") == F.col("d"), "left")
        again = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))

        def archive(batches):
            out = Appender(f"{root}/captures", ".warc.gz")
            for b in sliced(batches):
                lines = []
                for page, url, html, digest, first, first_url in zip(*(c.to_pylist() for c in b.columns)):
                    if out.out is None:
                        out.add(opening(out.name))
                    member = pack(page, url, html.encode("utf-8", "surrogatepass"), digest, first, first_url)
                    lines.append((surt(url), page, out.name, out.add(member), len(member)))
                cols = list(zip(*lines)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "page_id", "file", "at", "size"])
            out.close()

        rows = rows.select("page_id", "url", "html", "digest", F.when(again, F.col("first.page_id")).alias("first_page"), F.when(again, F.col("first.url")).alias("first_url"))
        lines = s.save(rows.mapInArrow(archive, "key string, page_id long, file string, at long, size long"), "lines")

        def blocks(batches):
            out, held = Appender(f"{root}/index", ".cdx.gz"), []

            def flush(some):
                packed = zlib.compress("\n".join(json.dumps(r) for r in some).encode(), 6)
                row = (some[0][0], some[-1][0], out.name, out.add(packed), len(packed))
                return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["first", "last", "file", "at", "size"])

            for b in sliced(batches):
                held += list(zip(*(c.to_pylist() for c in b.columns)))
                while len(held) >= BLOCK_LINES:
                    yield flush(held[:BLOCK_LINES])
                    held = held[BLOCK_LINES:]
            if held:
                yield flush(held)
            out.close()

        order = ["key", "page_id", "file", "at"]  # equal keys part by what follows
        ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
        directory = ranged.mapInArrow(blocks, "first string, last string, file string, at long, size long")
        s.save(directory, "directory")
        s.drop("lines", "alike")
        return self

    def find_blocks(self, keys: DataFrame) -> DataFrame:
        """(key, file, at, size): the index blocks in which each of ``keys`` (column ``key``) can be."""
        where = self.scratch.path("directory")

        def search(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                wanted = b.column(0).to_pylist()
                fs, path = open_file(where)
                # files of the directory are sorted: what lies outside the batch's keys is passed over by its statistics
                near = (ds.field("last") >= wanted[0]) & (ds.field("first") <= wanted[-1])
                d = sorted(ds.dataset(path, filesystem=fs, format="parquet", exclude_invalid_files=False).to_table(filter=near).to_pylist(), key=lambda x: (x["first"], x["last"], x["file"], x["at"]))
                lasts, found = [x["last"] for x in d], []
                for k in wanted:
                    i = bisect_left(lasts, k)
                    while i < len(d) and d[i]["first"] <= k:
                        found.append((k, d[i]["file"], d[i]["at"], d[i]["size"]))
                        i += 1
                cols = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "at", "size"])

        keys = self.scratch.save(keys.select("key").distinct(), f"keys-{uuid.uuid4().hex}")
        sorted_keys = keys.repartitionByRange(1 + keys.count() // KEYS_A_TASK, "key").sortWithinPartitions("key")
        return sorted_keys.mapInArrow(search, "key string, file string, at long, size long")

    def find_captures(self, keys: DataFrame) -> DataFrame:
        """(key, file, at, size): the captures of ``keys``, from the lines of the blocks."""
        folder = f"{self.scratch.root}/index"

        def search(batches):
            source, block, lines, heads = Ranges(folder), None, [], []
            for b in batches:
                found = []
                for key, *place in zip(*(c.to_pylist() for c in b.columns)):
                    if place != block:
                        block = place
                        lines = [json.loads(x) for x in zlib.decompress(source.read(*place)).decode().split("\n")]
                        heads = [x[0] for x in lines]
                    i = bisect_left(heads, key)
                    while i < len(heads) and heads[i] == key:
                        found.append((key, *lines[i][2:]))
                        i += 1
                cols = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["key", "file", "at", "size"])

        found = self.scratch.save(self.find_blocks(keys), f"blocks-{uuid.uuid4().hex}")
        found = found.repartition(1 + found.count() // KEYS_A_TASK, "file", "at").sortWithinPartitions("file", "at", "key")
        return found.mapInArrow(search, "key string, file string, at long, size long")

    def read(self, keys: DataFrame, payloads: bool = False) -> DataFrame:
        """The captures of ``keys``, read through the index; with ``payloads`` also the responses' payloads."""
        folder = f"{self.scratch.root}/captures"
        types = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "key": pa.string()}
        types |= {"payload": pa.binary()} if payloads else {}

        def fetch(batches):
            source = Ranges(folder)
            for b in sliced(batches):
                rows = [unpack(source.read(*place)) | {"key": key} for key, *place in zip(*(c.to_pylist() for c in b.columns))]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in types.items()], list(types))

        found = self.scratch.save(self.find_captures(keys), f"found-{uuid.uuid4().hex}")
        found = dealt(found, "file", "at").sortWithinPartitions("file", "at")
        return found.mapInArrow(fetch, f"{CAPTURE}, key string" + ", payload binary" * payloads)

    def lookup(self, urls: DataFrame) -> DataFrame:
        """Captures of the given urls (column ``url``), with payloads."""
        return self.read(keys_of(urls), payloads=True)


def keys_of(urls: DataFrame) -> DataFrame:
    def run(batches):
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array(sorted({surt(u) for u in b.column(0).to_pylist()}), pa.string())], ["key"])

    return urls.select("url").mapInArrow(run, "key string")


def op2_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    archive = CaptureArchive(spark).write(pages)
    return archive.read(keys_of(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with p as (select page_id, coalesce(html, '') html from pages),
q as (select page_id, strlen(html) n, sha256(html) d, min(page_id) over (partition by html) f from p)
select page_id, cast(n as bigint) payload_bytes, d payload_digest,
  case when n >= 100 and f <> page_id then 'revisit' else 'response' end record_type,
  case when n >= 100 and f <> page_id then f end refers_to
from q
"""
