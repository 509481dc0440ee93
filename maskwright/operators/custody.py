"""Hashes, manifest and run digest."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def manifest_rows(stats: DataFrame, written: DataFrame, stamp: str) -> DataFrame:
    """A record per file, by name; a hash that is missing is blank."""
    out = stats.join(written.withColumnRenamed("rel", "wrel"), F.col("rel") == F.col("wrel"), "left")
    text = F.col("status").isin("processed", "reconciled")
    return out.select(
        F.col("rel").alias("file"), "status", F.when(text, F.coalesce("encoding", F.lit(""))).otherwise("").alias("encoding"),
        F.when(text, F.col("replacements")).otherwise(0).cast("long").alias("replacements"),
        F.coalesce("source_sha256", F.lit("")).alias("source_sha256"), F.coalesce("output_sha256", F.lit("")).alias("output_sha256"), F.lit(stamp).alias("timestamp"),
    ).orderBy("file")


def run_digest(records: DataFrame) -> DataFrame:
    """One row: SHA-256 over file, source hash and output hash of all files by name.

    A hash is one stream, so one task takes the sorted names and hashes; it holds no more than a batch of them.
    """

    def run(batches):
        sha, n = hashlib.sha256(), 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                sha.update("".join(f"{x}\0" for x in row).encode())
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([sha.hexdigest()]), pa.array([n], pa.int64())], ["run_digest", "file_count"])

    return records.select("file", "source_sha256", "output_sha256").repartition(1).sortWithinPartitions("file").mapInArrow(run, "run_digest string, file_count long")


def _json(f, value) -> None:
    """``value``; an iterator is written as it comes, of pairs as an object and of others as a list."""
    text = lambda x: json.dumps(x, ensure_ascii=False, indent=1)
    if not isinstance(value, Iterator):
        f.write(text(value))
        return
    first = next(value, None)
    pairs = first is None or isinstance(first, tuple)
    f.write("{" if pairs else "[")
    for i, x in enumerate(chain([first] if first is not None else [], value)):
        f.write(",\n" if i else "\n")
        if pairs:
            f.write(f"{text(x[0])}: ")
        _json(f, x[1] if pairs else x)
    f.write("\n}" if pairs else "\n]")


def write_json(data: dict | Iterator, path: Path, mode: int = 0o644) -> None:
    """``data``, or what an iterator among its values yields, row by row. The file appears when it is whole."""
    path.parent.mkdir(parents=True, exist_ok=True)
    tmp = path.with_name(path.name + ".part")
    with os.fdopen(os.open(tmp, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, mode), "w", encoding="utf-8") as f:
        _json(f, iter(data.items()) if isinstance(data, dict) else data)
        f.write("\n")
    os.replace(tmp, path)


def rows_of(df: DataFrame) -> Iterator[dict]:
    """Rows one partition at a time."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def append_log(manifest: dict, path: Path) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    keep = ("timestamp", "version", "source", "target", "file_count", "run_digest_sha256")
    with open(path, "a", encoding="utf-8") as f:
        f.write(json.dumps({k: manifest[k] for k in keep}, ensure_ascii=False) + "\n")
