"""File trees as tables, and tables back as file trees.

Spark's own file source hides names that start with a dot or an underscore, which
would leave their contents unmasked. So a data source of our own lists the tree, a
task for each folder below its root, and tasks read the bytes, a block at a time.
Paths are those of a file system that driver and executors share.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.finder import Finder
from ..operators.aliases import numbered

# Suffixes that are copied through unread.
BINARY = (
    "png", "jpg", "jpeg", "gif", "bmp", "ico", "tif", "tiff", "webp", "pdf", "zip", "gz", "tar", "tgz", "7z", "rar", "bz2", "xz", "xlsx", "xls", "docx", "doc", "pptx", "ppt", "odt", "ods",
    "evtx", "etl", "pcap", "pcapng", "cap", "exe", "dll", "so", "dylib", "bin", "dat", "db", "sqlite", "mp3", "mp4", "wav", "avi", "mov", "mkv", "flac", "class", "pyc", "o", "a", "lib",
    "woff", "woff2", "ttf", "otf", "eot",
)
PACKETS = "this capture is not searched; save its dissection as text (`tshark -r CAPTURE -V`, or Wireshark's plain-text export) and run on that with --profile pcap-text"
EVENTS = "this event log is not searched; save it as text (`wevtutil qe LOG /lf:true /f:text`) and run on that"
HINTS = dict.fromkeys(("pcap", "pcapng", "cap"), PACKETS) | dict.fromkeys(("evtx", "etl"), EVENTS)
PROBE, BLOCK, CHUNK_CHARS, MARGIN_CHARS = 4096, 1 << 20, 8 * 1024 * 1024, 262_144
DOCS = "rel string, file_ord long, size long, status string, encoding string, chunk int, whole boolean, text string, source_sha256 string"


def suffix(rel: str) -> str:
    return os.path.splitext(rel)[1].lower().lstrip(".")


def glob_pattern(glob: str) -> str:
    """A glob in which ``*`` also crosses ``/``, as a whole-string pattern for both dialects."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if c == "[" and (end := glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!"))) > 0:
            body = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + body[1:] if body.startswith("!") else "\\" + body if body.startswith("^") else body) + "]"
            i = end
        else:
            out += ".*" if c == "*" else "." if c == "?" else re.escape(c)
        i += 1
    return rf"(?s)\A{out}\z" if not out else rf"(?s)\A(?:{out})\z"


def included(rel: Column, include=(), exclude=()) -> Column:
    """Excluding wins; without globs to include, all are."""
    anyof = lambda globs: F.coalesce(F.greatest(*(rel.rlike(glob_pattern(g)) for g in globs), F.lit(False)), F.lit(False))
    keep = anyof(include) if include else F.lit(True)
    return keep & ~anyof(exclude) if exclude else keep


def status_gate(rel: Column, size: Column, max_bytes: int) -> Column:
    """Why a file is copied through without being read; null for those to be read."""
    ext = F.lower(F.regexp_extract(rel, r"[^/.][^/]*\.([^./]*)$", 1))
    return F.when(size > max_bytes, "oversize").when(ext.isin(*BINARY), "binary")


def file_order(rel: Column) -> Column:
    """Paths are compared part by part: ``a/b`` comes before ``a.txt``."""
    return F.split(rel, "/")


class _Folder(InputPartition):
    def __init__(self, path: str, deep: bool):
        self.path, self.deep = path, deep


class _TreeReader(DataSourceReader):
    def __init__(self, root: str, skip: set[str]):
        self.root, self.skip = root, skip

    def partitions(self):
        below = [e.path for e in os.scandir(self.root) if e.is_dir(follow_symlinks=False) and e.name not in self.skip]
        return [_Folder(self.root, False), *(_Folder(p, True) for p in sorted(below))]

    def read(self, partition):
        for folder, dirs, names in os.walk(partition.path):
            dirs[:] = [d for d in dirs if partition.deep and d not in self.skip]
            for name in names:
                p = Path(folder, name)
                if p.is_file():
                    yield p.relative_to(self.root).as_posix(), str(p), p.stat().st_size


class TreeSource(DataSource):
    """``spark.read.format("maskwright_tree")`` with ``root`` and ``skip``, a JSON list of folder names."""

    @classmethod
    def name(cls):
        return "maskwright_tree"

    def schema(self):
        return "rel string, path string, size long"

    def reader(self, schema):
        return _TreeReader(self.options["root"], set(json.loads(self.options.get("skip", "[]"))))


def list_files(spark: SparkSession, root: str, exclude_dirs=(), include=(), exclude=()) -> DataFrame:
    """(rel, path, size, file_ord) of the files that are wanted, numbered from 0 in the order of their paths."""
    spark.dataSource.register(TreeSource)
    rows = spark.read.format("maskwright_tree").option("root", str(root)).option("skip", json.dumps(sorted(exclude_dirs))).load()
    rows = rows.where(included(F.col("rel"), include, exclude)).withColumn("parts", file_order(F.col("rel"))).withColumn("all", F.lit(0))
    return numbered(rows, "all", ["parts"]).select("rel", "path", "size", (F.col("rank") - 1).alias("file_ord"))


def blocks(path: str) -> Iterator[bytes]:
    with open(path, "rb") as f:
        while block := f.read(BLOCK):
            yield block


def possible(head: bytes) -> list[str]:
    """The encodings to try for a file that starts so; none for what is not text."""
    marks = {codecs.BOM_UTF8: "utf-8-sig", codecs.BOM_UTF32_LE: "utf-32", codecs.BOM_UTF32_BE: "utf-32", codecs.BOM_UTF16_LE: "utf-16", codecs.BOM_UTF16_BE: "utf-16"}
    marked = [e for mark, e in marks.items() if head.startswith(mark)]  # of two that fit the longer mark is listed first
    return marked[:1] or ([] if b"\0" in head[:PROBE] else ["utf-8", "cp1252"])


def survey(stream: Iterator[bytes]) -> tuple[str, str | None, str]:
    """(status, encoding, SHA-256) of a file, from its blocks; the first encoding that reads all of it is taken."""
    sha, live, status = hashlib.sha256(), None, "undecodable"
    for block in stream:
        sha.update(block)
        if live is None:
            names = possible(block)
            status = "undecodable" if names else "binary"
            live = [(e, codecs.getincrementaldecoder(e)()) for e in names]
        live = [x for x in live if _reads(x[1], block, False)]
    if live is None:
        return "processed", "utf-8", sha.hexdigest()
    live = [x for x in live if _reads(x[1], b"", True)]
    return ("processed", live[0][0], sha.hexdigest()) if live else (status, None, sha.hexdigest())


def _reads(decoder, block: bytes, final: bool) -> bool:
    try:
        decoder.decode(block, final)
    except UnicodeDecodeError:
        return False
    return True


def pieces(stream: Iterator[str], finder: Finder, chunk: int = CHUNK_CHARS, margin: int = MARGIN_CHARS) -> Iterator[str]:
    """Pieces of a huge text that no span crosses, from its parts as they are read.

    A piece ends at a line end if there is one, else behind a space, so that it is
    searched as the whole would be. At most ``chunk + margin`` characters and a part are held.
    """
    held = ""
    for part in stream:
        held += part
        while len(held) > chunk + margin:
            low = chunk - margin if chunk > margin else 1
            cut = held.rfind("\n", low, chunk) + 1 or held.rfind(" ", low, chunk) + 1 or chunk
            start = max(0, cut - margin)
            for x in finder.spans(held[start : cut + margin]):
                if start + x.start < cut < start + x.end:
                    cut = start + x.start
            cut = cut or chunk
            yield held[:cut]
            held = held[cut:]
    yield held


def decoded(path: str, encoding: str) -> Iterator[str]:
    decoder = codecs.getincrementaldecoder(encoding)()
    for block in blocks(path):
        yield decoder.decode(block)
    yield decoder.decode(b"", True)


def read_documents(files: DataFrame, max_bytes: int = 1 << 62, threshold: int = 50 << 20, detectors=(), allow=frozenset(), chunk: int = CHUNK_CHARS, seen=None) -> DataFrame:
    """Files as documents; those over ``threshold`` bytes as several rows, by ``chunk``.

    A file is read twice, first for its hash and encoding, so that what is no text
    to the end is known before any of it is given out. A huge file never is in
    memory as a whole. ``seen``, two accumulators, counts bytes and files read.
    """
    gated = files.withColumn("gate", status_gate(F.col("rel"), F.col("size"), max_bytes)).select("rel", "path", "size", "file_ord", "gate")
    names = [c.split()[0] for c in DOCS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.string()]
    finder = Finder(detectors, allow)

    def counted(path):
        for block in blocks(path):
            if seen:
                seen[0].add(len(block))
            yield block
        if seen:
            seen[1].add(1)

    def rows(r):
        status, encoding, sha = survey(counted(r["path"]))
        head = (r["rel"], r["file_ord"], r["size"])
        if r["gate"] or encoding is None:
            yield (*head, r["gate"] or status, None, 0, True, None, sha)
            return
        whole = r["size"] <= threshold
        text = decoded(r["path"], encoding)
        for i, piece in enumerate(["".join(text)] if whole else pieces(text, finder, chunk)):
            yield (*head, "processed", encoding, i, whole, piece, sha)

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                for row in rows(r):
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names)

    # a task for few files each: sizes differ, contents are read here
    return gated.repartition(max(files.sparkSession.sparkContext.defaultParallelism, 1)).mapInArrow(run, DOCS)


def write_mirror(docs: DataFrame, src: str, dst: str) -> DataFrame:
    """Write each file below ``dst`` in its encoding, or copy it through; (rel, output_sha256).

    Whole files are written where they are; only pieces of huge ones are brought
    together, in order. A file is written under another name and renamed when
    whole, so a lost or repeated task leaves no half file.
    """

    def run(batches):
        out = None
        try:
            for b in batches:
                done = []
                for r in b.to_pylist():
                    if out is not None and (out.name != r["rel"] or r["chunk"] == 0):
                        done.append(out.close())
                        out = None
                    if out is None:
                        out = _Target(src, dst, r["rel"], r["encoding"])
                    if r["text"] is None:
                        done.append(out.copy())
                        out = None
                    else:
                        out.write(r["text"])
                        if r["whole"]:
                            done.append(out.close())
                            out = None
                yield _hashes(done)
            if out is not None:
                last, out = out.close(), None
                yield _hashes([last])
        finally:
            if out is not None:
                out.drop()

    rows, schema = docs.select("rel", "chunk", "whole", "encoding", "text"), "rel string, output_sha256 string"
    apart = rows.where("not whole").repartition("rel").sortWithinPartitions("rel", "chunk")
    return rows.where("whole").mapInArrow(run, schema).unionByName(apart.mapInArrow(run, schema))


def _hashes(done: list[tuple[str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], pa.string()) for k in (0, 1)], ["rel", "output_sha256"])


class _Target:
    """One file below ``dst`` in the making."""

    def __init__(self, src: str, dst: str, name: str, encoding: str | None):
        self.name, self.source, self.target = name, os.path.join(src, name), os.path.join(dst, name)
        self.tmp, self.sha, self.file = f"{self.target}.{uuid.uuid4().hex}.part", hashlib.sha256(), None
        self.encoder = encoding and codecs.getincrementalencoder(encoding)()
        os.makedirs(os.path.dirname(self.target), exist_ok=True)

    def write(self, text: str) -> None:
        data = self.encoder.encode(text)
        self.file = self.file or open(self.tmp, "wb")  # noqa: SIM115
        self.sha.update(data)
        self.file.write(data)

    def close(self) -> tuple[str, str]:
        self.file.close()
        os.replace(self.tmp, self.target)
        return self.name, self.sha.hexdigest()

    def copy(self) -> tuple[str, str]:
        shutil.copy2(self.source, self.tmp)
        for block in blocks(self.tmp):
            self.sha.update(block)
        os.replace(self.tmp, self.target)
        return self.name, self.sha.hexdigest()

    def drop(self) -> None:
        if self.file:
            self.file.close()
            os.unlink(self.tmp)


def skip_warning(rel: str, status: str) -> str:
    hint = HINTS.get(suffix(rel))
    return f"{rel}: {status}, copied through unprocessed" + (f"; {hint}" if hint else "")
