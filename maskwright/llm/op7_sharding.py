"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

The ring is cut into a fixed number of cells. A cell belongs to the first
virtual node at or after it. All rows of a cell are offered to that node's
shard; a shard that is full passes what overflows on to the next distinct shard
clockwise, and so on, so no shard ever holds more than its bound. With load
factor 0 the bounds are the exact quotas (law ``rows``: counts at most one
apart); a larger factor moves fewer rows and gives looser balance.

Which part of a cell goes where only depends on the rows per cell, a table whose
size is the number of cells and not that of the data. Rows that are equal in doc_id,
size and CRC are one line with their number, made before anything is moved; lines are
ranked inside their cell by running sums and spelt out again, a large number in
parts on several tasks. So neither copies nor rows without id are a hot group, and
no text is shuffled.

Defined cases: a null text has size 1 and the CRC of nothing; a row's ring key is
its ``doc_id`` with its size and CRC, so that rows sharing a null or repeated
``doc_id`` spread over the ring; rows equal in all three share a cell and take a
slot each; an empty table gives an empty result; a very long text is only measured;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, spread

CELLS, REPLICAS, PART = 4096, 64, 10_000


def _place(label: str, cells: int) -> int:
    return int.from_bytes(hashlib.sha256(label.encode()).digest()[:8], "big") % cells


def ring(n_shards: int, cells: int = CELLS, replicas: int = REPLICAS) -> list[list[int]]:
    """For each cell the distinct shards met clockwise from it."""
    nodes: dict[int, list[int]] = {}
    for s in range(n_shards):
        for r in range(replicas):
            nodes.setdefault(_place(f"shard {s} replica {r}", cells), []).append(s)
    out: list[list[int]] = [[] for _ in range(cells)]
    met: list[int] = []
    for c in [*range(cells - 1, -1, -1)] * 2:  # twice round: the first turn fills what lies clockwise
        for s in sorted(nodes.get(c, ()), reverse=True):
            met = [s, *(x for x in met if x != s)]
        out[c] = met
    return out


def deal(counts: dict[int, int], n_shards: int, load_factor: float = 0.0, cells: int = CELLS, replicas: int = REPLICAS) -> list[tuple[int, int, int, int]]:
    """Segments (cell, first rank, shard, first slot): who takes which ranks of a cell."""
    total = sum(counts.values())
    base, extra = divmod(total, n_shards)
    if load_factor > 0:
        room = [-int(-(1 + load_factor) * total // n_shards)] * n_shards
    else:
        room = [base + (s < extra) for s in range(n_shards)]
    order, used = ring(n_shards, cells, replicas), [0] * n_shards
    left = {c: [0, n] for c, n in sorted(counts.items())}
    segments = []
    for turn in range(n_shards):
        for c, (rank, n) in left.items():
            if not n:
                continue
            s = order[c][turn]
            take = min(n, room[s] - used[s])
            if take:
                segments.append((c, rank, s, used[s]))
                used[s] += take
                left[c] = [rank + take, n - take]
    return segments


def shard(docs: DataFrame, n_shards: int = 8, load_factor: float = 0.0, cells: int = CELLS) -> DataFrame:
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "sharding")
    key = ["doc_id", "size", "text_crc32"]
    rows = spread(docs).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    lines = scratch.save(rows.groupBy(*key).agg(F.count("*").alias("n")).withColumn("cell", F.pmod(F.xxhash64(*key), F.lit(cells)).cast("int")), "lines")
    counts = {r["cell"]: r["n"] for r in lines.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # at most `cells` rows
    segments = deal(counts, n_shards, load_factor, cells)
    by_cell: dict[int, list] = {}
    for c, rank, s, slot in segments:
        by_cell.setdefault(c, []).append((rank, s, slot))
    listed = json.dumps([{"cell": c, "seg": [dict(zip(("rank", "shard", "slot"), x)) for x in sorted(v)]} for c, v in by_cell.items()])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<cell:int,seg:array<struct<rank:bigint,shard:int,slot:bigint>>>>")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cell").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = lines.withColumn("first", before.cast("long"))
    few = ranked.where(F.col("n") <= PART).select(*key, "cell", "first", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    if not lines.where(F.col("n") > PART).isEmpty():
        parts = ranked.where(F.col("n") > PART).withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PART).cast("long"))))
        parts = parts.repartition(F.col("cell"), F.col("at"))
        few = few.unionByName(parts.select(*key, "cell", "first", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + PART, F.col("n")) - 1)).alias("i")))
    placed = few.withColumn("rank", F.col("first") + F.col("i")).join(F.broadcast(table), "cell")  # bounded by `cells`
    placed = placed.withColumn("s", F.element_at(F.filter("seg", lambda x: x["rank"] <= F.col("rank")), -1))
    return placed.select(
        *key, F.lit("rows").alias("law"), F.col("s.shard").alias("shard"),
        (F.col("s.slot") + F.col("rank") - F.col("s.rank")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
