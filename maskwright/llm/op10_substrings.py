"""Incremental substring deduplication over a log-structured index of window hashes.

A window is ``WINDOW`` consecutive words. Its fingerprint is the smallest hash of
the short word runs inside it, so equal windows have equal fingerprints, and a
text has about one distinct fingerprint in twenty words.

The index has three levels, each a list of immutable runs, one for each batch,
written in buckets by key and sorted by it: fingerprints (the one text that holds
it, or that several do), windows of fingerprints that several texts hold (two
independent hashes, the smallest doc_id), and texts (digest, smallest doc_id, where
its bytes are). A batch is merge-joined with the runs of each level, which are read
in their order and not moved; too many runs are compacted into one. A row of a
level stands for a key, however many texts hold it, so no key is hot.

A fingerprint met in a second text makes both texts candidates: their windows at it
are hashed whole and go into the level of windows. An old text is read for that by
its byte range, once at most for each of its fingerprints. The join of windows is on
one hash, the other verifies. Equal texts are settled by digest alone: all but those
with the smallest doc_id lose every word that a window covers.

Defined cases: null, empty and short texts (under ``WINDOW`` words) lose nothing;
rows with a null doc_id lose nothing and take nothing away; rows that share a
doc_id take nothing from each other; repeated rows give equal results; an empty
table gives an empty result; very long texts are handled alike, a text at a time;
other columns are ignored, whatever their names. Documents of earlier batches are
not judged again when a later batch brings a smaller doc_id.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import MULT, MULT_B, Appender, Ranges, Scratch, dealt, gram_hashes, mix, powers, sliced, small_side, spread, word_hashes

WINDOW, RUN_WORDS, MAX_RUNS, BROADCAST_ROWS, BATCHES, KNOWN = 50, 10, 2, 1_000_000, 4, 100_000
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"
TEXT = [("file", pa.string()), ("at", pa.int64()), ("size", pa.int64())]


def fingerprints(h: np.ndarray, window: int = WINDOW, run: int = RUN_WORDS) -> np.ndarray:
    """For each window its smallest run hash."""
    g = gram_hashes(h, run)
    width = window - run + 1
    if len(g) < width:
        return np.zeros(0, dtype=np.uint64)
    have, m = 1, g
    while 2 * have <= width:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    rest = width - have
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def window_hashes(h: np.ndarray, at: np.ndarray, base: np.uint64, salt: int, window: int = WINDOW) -> np.ndarray:
    """Hash of the windows that start at ``at``: a difference of running sums, freed from its place."""
    with np.errstate(over="ignore"):
        p = powers(base, len(h) + 1)
        inverse = np.uint64(pow(int(base), -1, 2**64))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt)) * p[:-1], dtype=np.uint64)])
        return mix((sums[at + window] - sums[at]) * powers(inverse, len(h) + 1)[at])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _digest(col: str = "text"):
    return F.unhex(F.md5(F.coalesce(F.col(col), F.lit("")).cast("binary")))


def _base_rows(docs: DataFrame, folder: str) -> DataFrame:
    """Per row: digest, number of words, the digest of its words as they are, the fingerprints of its windows, and where its text was written."""

    def run(batches):
        store, known = Appender(folder, ".texts"), {}
        for b in sliced(batches):
            n, sha, prints, places = [], [], [], []
            for dg, t in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                w = _words(t)
                n.append(len(w))
                sha.append(_sha(w))
                long = len(w) >= WINDOW
                prints.append(np.unique(fingerprints(word_hashes(w))).view(np.int64) if long else np.zeros(0, np.int64))
                if long and dg not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    data = zlib.compress(t.encode("utf-8", "surrogatepass"), 1)
                    known[dg] = (store.name, store.add(data), len(data))
                places.append(known[dg] if long else (None, None, None))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in prints])]), pa.int32())
            flat = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(prints), pa.int64()))
            where = [pa.array([x[i] for x in places], t) for i, (_, t) in enumerate(TEXT)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.string()), flat, *where], ["doc_id", "dg", "n_words", "sha", "prints", *(c for c, _ in TEXT)])
        store.close()

    return docs.select("doc_id", _digest().alias("dg"), "text").mapInArrow(run, "doc_id long, dg binary, n_words long, sha string, prints array<long>, file string, at long, size long")


class Level:
    """Runs with one row for each key, bucketed and sorted by it. ``merge`` makes that row of several."""

    def __init__(self, scratch: Scratch, name: str, keys: list[str], merge: list):
        self.spark, self.scratch, self.name, self.keys, self.merge = scratch.spark, scratch, name, keys, merge
        # as many buckets as an aggregate by key has partitions, so that each task writes its own
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []

    def add(self, rows: DataFrame) -> DataFrame:
        """A further run, of rows that need not be merged yet."""
        table = f"{self.name}_{uuid.uuid4().hex}"
        merged = rows.groupBy(*self.keys).agg(*self.merge)
        merged.write.bucketBy(self.buckets, *self.keys).sortBy(*self.keys).option("path", self.scratch.path(table)).saveAsTable(table)
        self.runs.append(table)
        return self.spark.table(table)

    def beside(self, run: DataFrame) -> DataFrame:
        """The newest run with a column ``past``: the rows of the earlier runs that have its key, from one merge join for each."""
        names = [f"past{i}" for i in range(len(self.runs) - 1)]
        for name, table in zip(names, self.runs):
            old = self.spark.table(table)
            values = F.struct(*(c for c in old.columns if c not in self.keys))
            old = old.select(*(F.col(k).alias(f"{name}_{k}") for k in self.keys), values.alias(name))
            on = F.lit(True)
            for k in self.keys:
                on = on & (F.col(k) == F.col(f"{name}_{k}"))
            run = run.join(old, on, "left").drop(*(f"{name}_{k}" for k in self.keys))
        kind = run.select(F.array(F.struct(*(c for c in run.columns if c not in self.keys and c not in names)))).schema[0].dataType.simpleString()
        past = F.array_compact(F.array(*names)) if names else F.expr(f"cast(array() as {kind})")
        return run.withColumn("past", past).drop(*names)

    def earlier(self) -> DataFrame | None:
        """The rows of all runs but the newest."""
        return self._together(self.runs[:-1])

    def _together(self, runs: list[str]) -> DataFrame | None:
        # as plain files: a union of bucketed tables passes for bucketed where their scans are not
        return self.spark.read.schema(self.spark.table(runs[0]).schema).parquet(*map(self.scratch.path, runs)) if runs else None

    def compact(self, most: int) -> None:
        """One run in place of all, if there are more than ``most``."""
        if len(self.runs) > most:
            old, self.runs = self.runs, []
            self.add(self._together(old))
            self._drop(old)

    def _drop(self, runs: list[str]) -> None:
        for r in runs:
            self.spark.sql(f"drop table if exists {r}")
        self.scratch.drop(*runs)

    def close(self) -> None:
        self._drop(self.runs)
        self.runs = []


class FingerprintIndex:
    """The levels and the texts, in the shared folder."""

    def __init__(self, spark: SparkSession, max_runs: int = MAX_RUNS):
        self.spark, self.scratch, self.max_runs, self.n = spark, Scratch(spark, "fingerprints"), max_runs, 0
        several = (F.max("shared") | (F.min("dg") != F.max("dg"))).alias("shared")
        self.prints = Level(self.scratch, "prints", ["print"], [F.min("dg").alias("dg"), several])
        self.windows = Level(self.scratch, "windows", ["w", "v"], [F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id")])
        self.texts = Level(self.scratch, "texts", ["dg"], [F.min("text").alias("text")])

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Judge a batch against the index and itself, add it to the index, and return its results."""
        self.n += 1
        n, s = self.n, self.scratch
        docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
        rows = s.save(_base_rows(docs, s.path("texts")), f"rows-{n}")
        long = rows.where(f"doc_id is not null and n_words >= {WINDOW}")
        fresh = long.groupBy("dg").agg(F.min("doc_id").alias("first_id"), F.any_value("prints").alias("prints"), F.any_value(F.struct(*(c for c, _ in TEXT))).alias("place"))
        fresh = s.save(fresh.select("dg", "first_id", "prints", "place.*"), f"fresh-{n}")
        known = self.texts.beside(self.texts.add(fresh.select("dg", F.struct("first_id", *(c for c, _ in TEXT)).alias("text"))))
        least = s.save(known.select(F.col("dg").alias("ld"), F.least(F.col("text.first_id"), F.coalesce(F.array_min("past.text.first_id"), F.col("text.first_id"))).alias("first_id")), f"least-{n}")

        # fingerprints that a second text holds now; where none but one old text held it before, that text is read too
        held = fresh.select("dg", F.explode("prints").alias("print"))
        met = self.prints.beside(self.prints.add(held.withColumn("shared", F.lit(False))))
        owners = F.array_distinct("past.dg")
        before = F.exists("past.shared", lambda x: x) | (F.size(owners) > 1)
        met = met.select("print", "shared", before.alias("before"), owners.alias("owners"), F.array_distinct(F.concat(owners, F.array("dg"))).alias("holders"))
        met = met.where("shared or before or size(holders) > 1").select("print", F.when(~F.col("before"), F.get("owners", F.lit(0))).alias("old"))
        met = s.save(met, f"met-{n}")
        new = held.join(small_side(met.select(F.col("print").alias("p")), BROADCAST_ROWS), F.col("print") == F.col("p")).groupBy("dg").agg(F.collect_set("print").alias("prints"))
        new = new.join(fresh.drop("prints").withColumnRenamed("dg", "fd"), F.col("dg") == F.col("fd")).withColumn("new", F.lit(True)).drop("fd")
        old = self.texts.earlier()
        if old is not None:
            asked = s.save(met.where("old is not null").groupBy(F.col("old").alias("od")).agg(F.collect_set("print").alias("prints")), f"old-{n}")
            old = old.join(small_side(asked, BROADCAST_ROWS), F.col("dg") == F.col("od")).groupBy("dg").agg(F.any_value("prints").alias("prints"), F.min("text").alias("text"))
            new = new.unionByName(old.select("dg", "prints", "text.*", F.lit(False).alias("new")))
        wanted = s.save(new.withColumn("t", F.xxhash64("dg")), f"wanted-{n}")
        folder = s.path("texts")
        windows = dealt(wanted.select("file", "at", "size", "first_id", "t", "new", "prints"), "file").sortWithinPartitions("file", "at")
        windows = s.save(windows.mapInArrow(_windows(folder), "first_id long, t long, new boolean, at int, w long, v long"), f"windows-{n}")
        low = self.windows.beside(self.windows.add(windows.select("w", "v", "first_id", F.col("first_id").alias("last_id"))))
        low = low.select(F.col("w").alias("lw"), F.col("v").alias("lv"), "last_id", F.least("first_id", F.coalesce(F.array_min("past.first_id"), F.col("first_id"))).alias("low_id"))
        low = s.save(low.where("low_id < last_id").drop("last_id"), f"low-{n}")
        hit = windows.where("new").join(low, (F.col("w") == F.col("lw")) & (F.col("v") == F.col("lv")) & (F.col("low_id") < F.col("first_id")))
        places = s.save(hit.groupBy("first_id", "t").agg(F.collect_set("at").alias("gone")).select(F.col("first_id").alias("hd"), F.col("t").alias("ht"), "gone"), f"places-{n}")
        cut = wanted.where("new").join(places, (F.col("first_id") == F.col("hd")) & (F.col("t") == F.col("ht"))).select("file", "at", "size", "dg", "first_id", "gone")
        cut = dealt(s.save(cut, f"gone-{n}"), "file").sortWithinPartitions("file", "at")
        cut = s.save(cut.mapInArrow(_cut(folder), "cdg binary, cd long, n_removed long, kept string"), f"cut-{n}")
        s.drop(*(f"{x}-{n}" for x in ("fresh", "met", "wanted", "windows", "low", "places", "gone", *(["old"] if old is not None else []))))
        for level in (self.prints, self.windows, self.texts):
            level.compact(self.max_runs)
        out = rows.drop("prints", *(c for c, _ in TEXT)).join(least, F.col("dg") == F.col("ld"), "left").drop("ld")
        out = out.join(cut, (F.col("doc_id") == F.col("cd")) & (F.col("dg") == F.col("cdg")), "left")
        copy = F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))
        return out.select(
            "doc_id", "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(copy, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        )

    def close(self) -> None:
        """The levels go; results stay readable."""
        for level in (self.prints, self.windows, self.texts):
            level.close()


def _windows(folder: str):
    def run(batches):
        source = Ranges(folder)
        for b in sliced(batches):
            out = [[], [], [], [], [], []]
            for file, at, size, first, t, new, prints in zip(*(c.to_pylist() for c in b.columns)):
                h = word_hashes(zlib.decompress(source.read(file, at, size)).split())
                spots = np.flatnonzero(np.isin(fingerprints(h), np.array(prints, dtype=np.int64).view(np.uint64)))
                if len(spots):
                    hashes = (window_hashes(h, spots, base, salt).view(np.int64) for base, salt in ((MULT, 1), (MULT_B, 2)))
                    for c, x in zip(out, (np.full(len(spots), first, np.int64), np.full(len(spots), t, np.int64), np.full(len(spots), new), spots.astype(np.int32), *hashes)):
                        c.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["first_id", "t", "new", "at", "w", "v"])

    return run


def _cut(folder: str):
    def run(batches):
        source = Ranges(folder)
        for b in sliced(batches):
            removed, kept = [], []
            for file, at, size, gone in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 5))):
                w = zlib.decompress(source.read(file, at, size)).split()
                edge = np.zeros(len(w) + 1, np.int64)
                gone = np.array(gone, dtype=np.int64)
                np.add.at(edge, gone, 1)
                np.add.at(edge, gone + WINDOW, -1)
                stay = np.cumsum(edge[:-1]) == 0
                removed.append(int(len(w) - stay.sum()))
                kept.append(_sha([x for x, k in zip(w, stay) if k]))
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["cdg", "cd", "n_removed", "kept"])

    return run


def in_batches(docs: DataFrame, n: int = BATCHES) -> list[DataFrame]:
    """``docs`` as up to ``n`` batches of rising doc_ids, so that no batch holds what an earlier one is judged by."""
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], 1000)).first()[0] or []
    cuts = sorted(set(cuts))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    lows, highs = [None, *cuts], [*cuts, None]
    return [docs.where((F.lit(True) if a is None else key > a) & (F.lit(True) if b is None else key <= b)) for a, b in zip(lows, highs)]


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table, taken in as batches that are merged with the runs before them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    index, out = FingerprintIndex(spark), None
    for batch in in_batches(docs):
        got = index.ingest(spread(batch))
        out = got if out is None else out.unionByName(got)
    index.close()
    return out
