"""A dictionary of any size that a function of one row may ask, where no join is possible.

It is written to the shared folder in files of sorted digests and values. Tasks
map files of a plain path into memory, which the system takes back when it needs
to, and read others whole; a worker keeps few. Keys are known by 128 bits of their
SHA-256.
"""

from __future__ import annotations

import mmap
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from itertools import accumulate

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import note, open_file, shared_dir

FILE_ROWS, KEPT, DIGEST, PLACE = 1 << 16, 32, 16, 4


def digest(key: str) -> bytes:
    import hashlib

    return hashlib.sha256(key.encode()).digest()[:DIGEST]


def _write(folder: str, digests: list[bytes], values: list[bytes]) -> str:
    """A file: all digests, where each value ends, all values."""
    name = uuid.uuid4().hex  # by chance, so that a repeated task writes another one
    fs, path = open_file(f"{folder}/{name}")
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as out:
        out.write(b"".join(digests))
        out.write(b"".join(n.to_bytes(PLACE, "little") for n in accumulate(map(len, values))))
        out.write(b"".join(values))
    return name


class Lookup:
    """Made on the driver by ``packed``; sent to tasks as names of files."""

    def __init__(self, folder: str, files: list[tuple[bytes, str, int]]):
        self.folder, self.files = folder, sorted(files)
        self.firsts, self.open = [f[0] for f in self.files], {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def _file(self, name: str):
        got = self.open.pop(name, None)
        if got is None:
            if len(self.open) >= KEPT:
                self.open.pop(next(iter(self.open)))
            fs, path = open_file(f"{self.folder}/{name}")
            if isinstance(fs, pafs.LocalFileSystem):
                with open(path, "rb") as f:
                    got = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            else:
                with fs.open_input_stream(path, compression=None) as f:
                    got = f.read()
        self.open[name] = got
        return got

    def table(self, keys: Iterable[str]) -> dict[str, str]:
        """The entries of those ``keys`` that have one. All are looked up at once, so that each file is taken up once."""
        out = {}
        for d, key in sorted((digest(k), k) for k in keys):
            at = bisect_right(self.firsts, d) - 1
            if at < 0:
                continue
            _, name, rows = self.files[at]
            data = self._file(name)
            i = bisect_left(range(rows), d, key=lambda i: data[i * DIGEST : (i + 1) * DIGEST])
            if i < rows and data[i * DIGEST : (i + 1) * DIGEST] == d:
                ends, values = rows * DIGEST + i * PLACE, rows * (DIGEST + PLACE)
                start = int.from_bytes(data[ends - PLACE : ends], "little") if i else 0
                out[key] = data[values + start : values + int.from_bytes(data[ends : ends + PLACE], "little")].decode()
        return out


def packed(mapping: DataFrame) -> Lookup:
    """(mk, new) of a written table as a ``Lookup``."""
    spark = mapping.sparkSession
    folder = note(f"{shared_dir(spark)}/lookup-{uuid.uuid4().hex}")

    def run(batches):
        table = [(d, v.encode()) for b in batches for d, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        for i in range(0, len(table), 2 * FILE_ROWS):  # a range may be larger than asked for
            digests, values = zip(*table[i : i + 2 * FILE_ROWS])
            name = _write(folder, digests, values)
            yield pa.RecordBatch.from_arrays([pa.array([digests[0]], pa.binary()), pa.array([name]), pa.array([len(digests)], pa.int64())], ["first", "name", "n"])

    rows = mapping.where("mk is not null and new is not null").select(F.unhex(F.substring(F.sha2(F.col("mk").cast("binary"), 256), 1, 2 * DIGEST)).alias("d"), "new")
    ranged = rows.repartitionByRange(1 + mapping.count() // FILE_ROWS, "d").sortWithinPartitions("d")
    return Lookup(folder, [(bytes(r["first"]), r["name"], r["n"]) for r in ranged.mapInArrow(run, "first binary, name string, n long").collect()])
