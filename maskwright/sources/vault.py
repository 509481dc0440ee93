"""The alias store between runs: an exclusive lock, one published version, and JSON for exchange."""

from __future__ import annotations

import json
import os
import platform
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aliases
from ..operators.custody import rows_of, write_json

SCHEMA_TAG = "maskwright-vault/1"
READABLE = re.compile(r"[a-z]+-vault/1")  # other tools write this version of the schema too


class VaultLocked(RuntimeError):
    pass


class Vault:
    """``root`` on a file system that driver and executors share. Tables are written as a new version, then the pointer moves.

    ``with`` holds the lock: a file that says who holds it, linked into place, which fails if there is one.
    """

    def __init__(self, root: str):
        self.root, self.lock = Path(root), Path(root, ".lock")
        self.held = False

    def __enter__(self) -> Vault:
        self.root.mkdir(parents=True, exist_ok=True)
        mine = self.root / f".lock-{uuid.uuid4().hex}"
        mine.write_text(json.dumps({"pid": os.getpid(), "host": platform.node()}))
        try:
            os.link(mine, self.lock)
            self.held = True
        except FileExistsError:
            raise VaultLocked(f"{self.root} is in use by {self.lock.read_text()}; if that run has ended, remove {self.lock}") from None
        finally:
            mine.unlink()
        return self

    def __exit__(self, *_) -> None:
        if self.held:
            self.lock.unlink(missing_ok=True)
            self.held = False

    def known(self) -> bool:
        return (self.root / "CURRENT").is_file() or (self.root / "map.json").is_file()

    def load(self, spark: SparkSession) -> Tables:
        """The dictionary; empty before the first run."""
        pointer = self.root / "CURRENT"
        if pointer.is_file():
            v = self.root / pointer.read_text().strip()
            return Tables(*(spark.read.schema(schema).parquet(f"{v}/{name}") for name, schema in SCHEMAS.items()))
        if (self.root / "map.json").is_file():
            return from_json(spark, json.loads((self.root / "map.json").read_text(encoding="utf-8")))
        return empty(spark)

    def save(self, tables: Tables) -> None:
        pointer = self.root / "CURRENT"
        n = int(re.sub(r"\D", "", pointer.read_text()) or 0) + 1 if pointer.is_file() else 1
        v = self.root / f"v{n}"
        for name in SCHEMAS:
            getattr(tables, name).write.mode("overwrite").parquet(str(v / name))
        tmp = self.root / "CURRENT.tmp"
        tmp.write_text(v.name)
        os.replace(tmp, pointer)
        for p in (pointer, v):
            p.chmod(0o700 if p.is_dir() else 0o600)

    def export_json(self, spark: SparkSession) -> Path:
        """``map.json`` for tools that read one file; written row by row."""
        tables = self.load(spark)
        entries, ents = tables.entries, tables.entities.orderBy("ord").collect()  # entities are an operator's table
        per: dict = {}
        for e in ents:
            stem, n = re.fullmatch(r"(.*?)(\d+)", e["label"]).groups()
            per[stem] = max(per.get(stem, 0), int(n))
        data = {
            "_schema": SCHEMA_TAG, "key_index": ((r["ckey"], r["alias"]) for r in rows_of(entries.select("ckey", "alias"))), "entries": decode_pairs(tables),
            "counters": ((r["counter"], r["top"]) for r in rows_of(aliases.counters(entries))),
            "entities": {e["entity_id"]: {"label": e["label"], "type": e["type"], "pretty": e["pretty"], "notes": e["notes"]} for e in ents}, "entity_counters": per,
        }
        write_json(data, self.root / "map.json", 0o600)
        return self.root / "map.json"

    def run_dir(self, stamp: str, run: str) -> Path:
        d = self.root / "runs" / f"{stamp.translate({ord(':'): None, ord('+'): 'Z'})}-{run[:8]}"
        d.mkdir(parents=True, exist_ok=True)
        return d


@dataclass
class Tables:
    entries: DataFrame
    entities: DataFrame
    sightings: DataFrame


SCHEMAS = {"entries": aliases.ENTRIES, "entities": aliases.ENTITIES, "sightings": aliases.SIGHTINGS}


def empty(spark: SparkSession) -> Tables:
    return Tables(*(spark.createDataFrame([], schema) for schema in SCHEMAS.values()))


def decode_pairs(tables: Tables) -> Iterator[tuple[str, dict]]:
    """(alias, what is known of it), in numbering order."""
    met = tables.sightings.groupBy("ckey").agg(F.array_sort(F.collect_list(F.struct("ord", "rel")))["rel"].alias("files")).withColumnRenamed("ckey", "k")
    rows = tables.entries.join(met, F.col("ckey") == F.col("k"), "left").orderBy("counter", "n")
    for r in rows.toLocalIterator():
        meta = {"original": r["original"], "category": r["category"], "count": r["count"], "files": r["files"] or [], "entity": r["entity_id"]}
        yield r["alias"], meta | {k: r[k] for k in ("superseded_by", "supersedes") if r[k]}


def entries_of(data) -> dict:
    """The alias table of a decode map or a vault map, checked."""
    table = data.get("entries", data) if isinstance(data, dict) else None
    if not isinstance(table, dict) or not all(isinstance(m, dict) for m in table.values()):
        raise ValueError("not an alias table")
    return table


def from_json(spark: SparkSession, data: dict) -> Tables:
    """Tables of a JSON map; a decode map has no keys, then aliases alone identify. A map's schema, if named, must be of this version."""
    table = entries_of(data)
    if "entries" in data and not READABLE.fullmatch(str(data.get("_schema", SCHEMA_TAG))):
        raise ValueError(f"unknown vault schema: {data['_schema']!r}")
    keys = {a: k for k, a in (data.get("key_index") or {}).items()} if "entries" in data else {}
    rows, met = [], []
    for alias, m in table.items():
        counter, _, n = alias.strip("<>").rpartition("_")
        text = m.get("superseded_by") if isinstance(m.get("superseded_by"), str) else None
        rows.append((alias, keys.get(alias), counter, int(n) if n.isdigit() else 0, m.get("original"), m.get("category"), counter.rpartition(".")[2], m.get("entity"), int(m.get("count") or 0), text, list(m.get("supersedes") or ())))
        met += [(keys.get(alias) or alias, f, i) for i, f in enumerate(m.get("files") or ())]
    ents = [(i, e["label"], e.get("type", ""), e.get("pretty", ""), e.get("notes", ""), k) for k, (i, e) in enumerate((data.get("entities") or {}).items())] if "entries" in data else []
    return Tables(spark.createDataFrame(rows, aliases.ENTRIES), spark.createDataFrame(ents, aliases.ENTITIES), spark.createDataFrame(met, aliases.SIGHTINGS))


def load_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a map in one file, which the driver reads whole."""
    p = Path(path)
    if not p.is_file():
        raise FileNotFoundError(f"map not found: {path}")
    return from_json(spark, json.loads(p.read_text(encoding="utf-8"))).entries
