"""Shared plumbing of the corpus operators: scratch tables and files, slices of batches, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession

from ..operators.scratch import cleared, delete, note, open_file, shared_dir, spread

# Python's bytes.split() and the class [^\x20\x09-\x0D]+ agree: both cut at
# the six ASCII white-space characters only.
MULT = np.uint64(0x9E3779B97F4A7C15)
MULT_B = np.uint64(0xD6E8FEB86659FD93)
SLICE_ROWS, OPEN_FILES, RANGE_BYTES, SALT, BATCH_BYTES = 256, 16, 16 << 20, 16, 4 << 20


def sliced(batches):
    """Arrow batches, which Spark bounds by bytes, in slices of few rows: what Python makes of them is freed slice by slice."""
    for b in batches:
        for i in range(0, b.num_rows, SLICE_ROWS):
            yield b.slice(i, SLICE_ROWS)


def own_name(stem: str, names: list[str]) -> str:
    """A column name that is not among ``names``, however they are written."""
    taken, name = {n.lower() for n in names}, stem
    while name.lower() in taken:
        name += "_"
    return name


class Appender:
    """A new file below ``folder``, made with the first bytes; named by chance, so that a repeated task writes another one."""

    def __init__(self, folder: str, suffix: str):
        self.uri, self.out, self.at = f"{folder}/{uuid.uuid4().hex}{suffix}", None, 0

    @property
    def name(self) -> str:
        return self.uri.rpartition("/")[2]

    def add(self, data: bytes) -> int:
        """Where ``data`` begins."""
        if self.out is None:
            fs, path = open_file(self.uri)
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            self.out = fs.open_output_stream(path, compression=None)
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


class Ranges:
    """Byte ranges of files below ``folder``; few files are open at a time."""

    def __init__(self, folder: str):
        self.folder, self.streams = folder, {}

    def read(self, file: str, at: int, size: int) -> bytes:
        if file not in self.streams:
            if len(self.streams) >= OPEN_FILES:
                self.streams.pop(next(iter(self.streams))).close()
            fs, path = open_file(f"{self.folder}/{file}")
            self.streams[file] = fs.open_input_file(path)
        return self.streams[file].read_at(size, at)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of at most ``BATCH_BYTES`` for what is planned and run inside; the session's own setting is back afterwards."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Tables written in the shared folder: they cut lineage and outlive executors."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.root = note(f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        schema = df.schema
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later table depends on any more."""
        delete(self.spark, [self.path(name) for name in names])


def small_side(df: DataFrame, limit_rows: int):
    """``df`` with a broadcast hint if its row count is proven to be at most ``limit_rows``.

    ``df`` must be a written table, so that counting reads file footers only.
    Beyond the limit it comes back as it is and Spark joins by shuffle.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if df.count() <= limit_rows else df


def joined_near(rows: DataFrame, table: DataFrame, key: str, on: str, limit_rows: int) -> DataFrame:
    """``rows`` and what ``table``, a written one with one row a key, has for their ``key``, if anything.

    Up to ``limit_rows`` the table is broadcast. Beyond, rows meet it by key, those of one key in ``SALT``
    places, as a third of all may have it; rows without a key are not moved.
    """
    from pyspark.sql import functions as F

    if table.count() <= limit_rows:
        return rows.join(F.broadcast(table), F.col(key) == F.col(on), "left").drop(on)
    salt, part = own_name("salt", rows.columns + table.columns), own_name("part", rows.columns + table.columns)
    spare = table.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salted = rows.where(F.col(key).isNotNull()).withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int"))
    met = salted.join(spare, (F.col(key) == F.col(on)) & (F.col(salt) == F.col(part)), "left").drop(on, salt, part)
    return met.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True)


def dealt(places: DataFrame, *keys: str) -> DataFrame:
    """Rows that name byte ranges (``size``), dealt out by ``keys``: a task for ``RANGE_BYTES`` each, since Spark, which sees the names only, would make one of all."""
    from pyspark.sql import functions as F

    total = places.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return places.repartition(1 + total // RANGE_BYTES, *keys)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, on a copy."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def gram_hashes(h: np.ndarray, k: int, base: np.uint64 = MULT) -> np.ndarray:
    """A 64-bit hash of each run of ``k`` words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = np.zeros(n, dtype=np.uint64)
    p = np.uint64(1)
    with np.errstate(over="ignore"):
        for j in range(k):
            acc += h[j : j + n] * p
            p = p * base
    return mix(acc)


__all__ = ["Appender", "MULT", "MULT_B", "Ranges", "Scratch", "cleared", "dealt", "gram_hashes", "joined_near", "mix", "open_file", "own_name", "powers", "sliced", "small_side", "spread", "word_hashes"]
