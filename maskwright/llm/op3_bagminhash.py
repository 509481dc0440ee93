"""Near-duplicate detection with BagMinHash signatures.

A document is the bag of its five-word shingles. Every unit of weight of a
shingle carries a Poisson process of points in time, keyed by shingle and weight
level, over all components of the signature at once; a component keeps its
earliest point. Two bags agree in a component with a probability of exactly their
weighted Jaccard similarity. Levels are grouped in blocks (0,1], (1,2], (2,4],
(4,8] and so on: one process of the block's whole rate, whose points fall on a
level each and count only up to the shingle's weight, so that heavy shingles cost
in proportion to the logarithm of their weight. Points are only drawn up to a
time limit that leaves no component empty; it is doubled where one is.

Bands of the signature give candidate buckets. Equal texts are one node. Each
node is paired with its buckets' leaders, first with the one it shares most
bands with; every pair is verified by the exact overlap of both bags. Pairs whose
ends are already in one component are skipped. Then the members of different
components in each bucket of up to ``SMALL`` nodes are verified with each other, and
in larger buckets each node with its other leaders. Larger buckets that still hold
several components are gone through whole, in tiles: the members outside a bucket's
largest component against all its members, in blocks of about ``BLOCK``, by one
index of shingles a tile, which hands on no more links than join its components. So
every pair that shares a bucket is in one component or has been compared. Components
come from min-label propagation with pointer jumps; later links only label the
joined components anew.

Defined cases: null and empty texts are equal to each other and join nothing
else; texts of one to four words are one shingle of all their words; a null doc_id
gives a row with the class of its text, and a class without any doc_id has a negative class_id of its own; repeated rows give a row each; an empty
table gives an empty result; a very long text is one bag; other columns are
ignored, and the pipeline form returns them, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import gram_hashes, mix, own_name, Scratch, sliced, small_side, spread, word_hashes

SHINGLE, SIMILAR, BANDS, BAND_ROWS = 5, 0.8, 24, 4
GOLD = np.uint64(0x9E3779B97F4A7C15)
BROADCAST_ROWS, SMALL = 1_000_000, 64
BLOCK, FILE_ROWS, VERIFY_ROWS = 512, 50_000, 2_000  # texts of a block; rows of a file and pairs of a task, where their number is known


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def bag_hashes(words: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts."""
    h = word_hashes(words)
    return np.unique(gram_hashes(h, min(k, len(words))), return_counts=True) if len(words) else (h, h)


def bag_minhash(elements: np.ndarray, counts: np.ndarray, m: int) -> np.ndarray:
    """The signature: for each component the identity of its earliest point."""
    with np.errstate(over="ignore"):
        units, rates, lows, weights = [mix(elements + np.uint64(1))], [np.ones(len(elements))], [np.zeros(len(elements), np.int64)], [counts]
        size, rest = 1, np.flatnonzero(counts > 1)
        while len(rest):
            units.append(mix(mix(elements[rest] + np.uint64(1)) + GOLD * np.uint64(size)))
            rates.append(np.full(len(rest), float(size)))
            lows.append(np.full(len(rest), size, np.int64))
            weights.append(counts[rest])
            size *= 2
            rest = rest[counts[rest] > size]
        unit, rate, low, weight = map(np.concatenate, (units, rates, lows, weights))
        limit = (math.log(m) + 3.0) / float(counts.sum())
        while True:
            sig, best = np.zeros(m, np.uint64), np.full(m, np.inf)
            live, time, r = np.arange(len(unit)), np.zeros(len(unit)), 0
            at, ids = [], []
            # few units have many points each: draw them side by side
            wide = max(1, min(4096, int(2 * limit * m * float(rate.mean())) if len(unit) < 64 else 1))
            while len(live):
                steps = np.arange(r + 1, r + wide + 1, dtype=np.uint64)
                keys = mix(unit[live, None] + steps[None, :] * GOLD)
                gaps = -np.log(((keys >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (rate[live, None] * m)
                t = time[live, None] + np.cumsum(gaps, axis=1)
                inside = t <= limit
                level = low[live, None] + 1 + (mix(keys ^ GOLD) >> np.uint64(11)).astype(np.float64) * 2.0**-53 * rate[live, None]
                ok = inside & (level.astype(np.int64) <= weight[live, None])
                at.append(t[ok])
                ids.append(keys[ok])
                time[live] = t[:, -1]
                live = live[inside[:, -1]]
                r += wide
            t, k = np.concatenate(at), np.concatenate(ids)
            order = np.argsort(-t, kind="stable")
            part = (mix(k + np.uint64(7)) % np.uint64(m)).astype(np.int64)
            sig[part[order]] = k[order]  # of several the last stays, the earliest point
            best[part] = 0
            if not np.isinf(best).any():
                return sig
            limit *= 2


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return gram_hashes(sig, 1)[: bands * rows].reshape(bands, rows) @ (GOLD ** np.arange(1, rows + 1, dtype=np.uint64)) + mix(np.arange(bands, dtype=np.uint64) + np.uint64(99))


def similarity(a: Counter, b: Counter) -> float:
    """Exact weighted Jaccard similarity of two bags."""
    same = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - same
    return same / total if total else 0.0


def bag(text: str | None, k: int = SHINGLE) -> Counter:
    w = _words(text)
    if not w:
        return Counter()
    k = min(k, len(w))
    return Counter(zip(*(w[i:] for i in range(k))))


def _signatures(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    def run(batches):
        for b in sliced(batches):
            out = []
            for t in b.column(1).to_pylist():
                w = _words(t)
                out.append(band_keys(bag_minhash(*bag_hashes(w), bands * rows), bands, rows).view(np.int64) if w else np.zeros(0, np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]), pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat, b.column(2)], ["doc_id", "bands", "dg"])

    return docs.select("doc_id", "text", _digest().alias("dg")).mapInArrow(run, "doc_id long, bands array<long>, dg binary")


def _digest():
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _verify(threshold: float):
    def run(batches):
        known: OrderedDict = OrderedDict()

        def of(key, text):
            if key not in known:
                known[key] = bag(text)
                if len(known) > 32:
                    known.popitem(last=False)
            return known[key]

        for b in sliced(batches):
            a, c = b.column(0).to_pylist(), b.column(1).to_pylist()
            sims = [similarity(of(x, s), of(y, t)) for x, y, s, t in zip(a, c, b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sims, pa.float64())], ["a", "b", "sim"]).filter(pa.array([x >= threshold for x in sims], pa.bool_()))

    return run


def tile_links(ids: list, labels: list, texts: list, asks: list, threshold: float) -> list[tuple]:
    """Similar pairs (asking, other) of one tile, as far as they join different labels."""
    if not any(asks):
        return []
    bags = [bag_hashes(_words(x)) for x in texts]
    totals = np.array([int(c.sum()) for _, c in bags])
    own = np.flatnonzero(np.array(asks, bool))
    token = np.concatenate([bags[i][0] for i in own])
    order = np.argsort(token, kind="stable")
    token = token[order]
    slot = np.repeat(np.arange(len(own)), [len(bags[i][0]) for i in own])[order]
    count = np.concatenate([bags[i][1] for i in own])[order]
    root = {x: x for x in labels}

    def top(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    found = []
    for j, (h, c) in enumerate(bags):
        if asks[j]:
            continue
        same = np.zeros(len(own), np.int64)
        for k in range(0, len(h), 4096):
            lo, hi = np.searchsorted(token, h[k : k + 4096], "left"), np.searchsorted(token, h[k : k + 4096], "right")
            n = hi - lo
            at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            same += np.bincount(slot[at], np.minimum(count[at], np.repeat(c[k : k + 4096], n)), len(own)).astype(np.int64)
        for x in np.flatnonzero(same >= (threshold - 1e-9) * (totals[own] + totals[j] - same)):
            i = own[x]
            one, two = top(labels[i]), top(labels[j])
            if one != two:
                root[one] = two
                found.append((ids[i], ids[j]))
    return found


def _tile(threshold: float):
    def run(table):
        found = tile_links(*(table.column(c).to_pylist() for c in ("dg", "label", "text", "asks")), threshold)
        return pa.table([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return run


def components(scratch: Scratch, edges: DataFrame, tag: str) -> DataFrame:
    """(node, label): the smallest node of each component. Rounds grow with the logarithm of its width.

    ``edges`` must be a written table; its row count bounds every table here, and so decides on files and broadcasts.
    """
    n = 2 * edges.count()
    files = 1 + n // FILE_ROWS
    both = scratch.save(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct().coalesce(files), f"{tag}-both")
    labels = scratch.save(both.groupBy("x").agg(F.least(F.min("y"), F.col("x")).alias("label")).select(F.col("x").alias("node"), "label").coalesce(files), f"{tag}-0")
    small = F.broadcast if n <= BROADCAST_ROWS else lambda df: df
    i = 0
    while True:
        near = both.join(small(labels), F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        near = scratch.save(near.coalesce(files), f"{tag}-near-{i}")
        step = labels.join(small(near), F.col("node") == F.col("x"), "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("low"))
        step = scratch.save(step.coalesce(files), f"{tag}-step-{i}")
        jump = step.select(F.col("node").alias("at"), F.col("low").alias("further"))
        after = step.join(small(jump), F.col("low") == F.col("at"), "left").select("node", "was", F.least("low", F.coalesce("further", "low")).alias("label"))
        after = scratch.save(after.coalesce(files), f"{tag}-{i + 1}")
        done = after.where("was <> label").isEmpty()
        scratch.drop(f"{tag}-near-{i}", f"{tag}-step-{i}", f"{tag}-{i}")
        labels, i = after.select("node", "label"), i + 1
        if done:
            return labels


def classify(docs: DataFrame, threshold: float = SIMILAR, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """Per row: doc_id, class_id, stays and the text's digest ``dg``."""
    spark = docs.sparkSession
    s = Scratch(spark, "bagminhash")
    docs = spread(docs).selectExpr("cast(doc_id as long) doc_id", "text")
    signed = s.save(_signatures(docs, bands, rows), "signed")
    nodes = s.save(signed.groupBy("dg").agg(F.min("doc_id").alias("first_id"), F.any_value("bands").alias("bands")), "nodes")
    banded = nodes.select("dg", F.explode("bands").alias("key"))
    heads = s.save(banded.groupBy("key").agg(F.min("dg").alias("head"), F.max("dg").alias("tail")).where("head <> tail").select(F.col("key").alias("hk"), "head"), "heads")
    buckets = s.save(banded.join(heads, F.col("key") == F.col("hk")).select("key", "dg", "head"), "buckets")
    s.drop("heads")
    pairs = s.save(buckets.where("dg <> head").groupBy("dg", "head").agg(F.count("*").alias("n")).select(F.col("dg").alias("a"), F.col("head").alias("b"), "n"), "pairs")

    needed = s.save(buckets.select("dg").distinct().join(nodes.select(F.col("dg").alias("nd"), "first_id"), F.col("dg") == F.col("nd")).select("nd", "first_id"), "needed")
    owned = docs.select("doc_id", "text", _digest().alias("dg"))
    texts = owned.join(small_side(needed, BROADCAST_ROWS), (F.col("dg") == F.col("nd")) & F.col("doc_id").eqNullSafe(F.col("first_id"))).select("dg", "text")
    texts = s.save(texts, "texts")

    def verified(some: DataFrame, tag: str) -> DataFrame:
        """Of the pairs in a written table those that are similar; only the texts they name are dealt out."""
        left = texts.join(small_side(some.select("a", "b"), BROADCAST_ROWS), F.col("dg") == F.col("a")).select("a", "b", F.col("text").alias("lt"))
        right = texts.join(small_side(s.save(some.select(F.col("b").alias("rd")).distinct(), f"{tag}-right"), BROADCAST_ROWS), F.col("dg") == F.col("rd")).select("rd", F.col("text").alias("rt"))
        joined = left.join(right, F.col("b") == F.col("rd"))
        joined = joined.select("a", "b", "lt", "rt").coalesce(1 + some.count() // VERIFY_ROWS)
        return s.save(joined.mapInArrow(_verify(threshold), "a binary, b binary, sim double").select("a", "b"), tag)

    def merged(labels: DataFrame, links: DataFrame, tag: str) -> DataFrame:
        """The labels after more links: only the components that a link joins are labelled anew, not their members."""
        one, two = (labels.select(F.col("node").alias(f"{x}n"), F.col("label").alias(f"{x}l")) for x in "ab")
        ends = links.join(one, F.col("a") == F.col("an")).join(two, F.col("b") == F.col("bn")).where("al <> bl")
        ends = s.save(ends.select(F.least("al", "bl").alias("a"), F.greatest("al", "bl").alias("b")).distinct(), f"{tag}-ends")
        moved = components(s, ends, tag).select(F.col("node").alias("old"), F.col("label").alias("new"))
        return s.save(labels.join(small_side(moved, BROADCAST_ROWS), F.col("label") == F.col("old"), "left").select("node", F.coalesce("new", "label").alias("label")), f"{tag}-labels")

    # first the leader with which a node shares most bands
    first = s.save(pairs.groupBy("a").agg(F.max_by("b", F.struct("n", "b")).alias("b")), "first")
    labels = merged(needed.select(F.col("nd").alias("node"), F.col("nd").alias("label")), verified(first, "links-0"), "c0")

    def members(labels: DataFrame, of: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
        """Buckets with labels, and the sizes of those that hold several components."""
        files = 1 + of.count() // FILE_ROWS
        comp = small_side(labels.select(F.col("node").alias("cn"), "label"), BROADCAST_ROWS)
        member = s.save(of.join(comp, F.col("dg") == F.col("cn")).select("key", "dg", "head", "label").coalesce(files), f"member-{tag}")
        sizes = member.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1")
        return member, s.save(sizes.select(F.col("key").alias("fk"), "n").coalesce(files), f"sizes-{tag}")

    # in small buckets all members of different components, in others a node's leaders
    member, sizes = members(labels, buckets, "1")
    few = small_side(s.save(sizes.where(f"n <= {SMALL}").select("fk"), "few"), BROADCAST_ROWS)
    mixed = s.save(member.join(few, F.col("key") == F.col("fk")).select("key", "dg", "label"), "mixed")
    other = mixed.select(F.col("key").alias("ok"), F.col("dg").alias("od"), F.col("label").alias("ol"))
    within = mixed.join(other, (F.col("key") == F.col("ok")) & (F.col("dg") < F.col("od")) & (F.col("label") != F.col("ol"))).select(F.col("dg").alias("a"), F.col("od").alias("b"))
    mine = member.where("dg <> head").select("dg", "head", "label").distinct()
    mine = mine.join(labels.select(F.col("node").alias("cn"), F.col("label").alias("hl")), F.col("head") == F.col("cn")).where("label <> hl")
    fresh = mine.select(F.least("dg", "head").alias("a"), F.greatest("dg", "head").alias("b")).union(within).distinct()
    done = first.select(F.least("a", "b").alias("ta"), F.greatest("a", "b").alias("tb"))
    fresh = s.save(fresh.join(done, (F.col("a") == F.col("ta")) & (F.col("b") == F.col("tb")), "left_anti"), "fresh")
    labels = merged(labels, verified(fresh, "links-1"), "c1")

    # in large buckets the members outside the largest component with all others
    large = s.save(sizes.where(f"n > {SMALL}").select("fk"), "large")
    left = s.save(member.join(small_side(large, BROADCAST_ROWS), F.col("key") == F.col("fk"), "left_semi").select("key", "dg", "head"), "left")
    member, sizes = members(labels, left, "2")
    parts = member.groupBy("key", "label").agg(F.count("*").alias("m"))
    lead = parts.groupBy("key").agg(F.max_by("label", F.struct("m", "label")).alias("ll"), F.sum("m").alias("all"), F.max("m").alias("most")).where("all > most")
    blocks = lambda n: F.ceil(F.expr(n) / BLOCK).cast("int")
    lead = s.save(lead.select(F.col("key").alias("lk"), "ll", blocks("all - most").alias("na"), blocks("all").alias("no")), "lead")
    inside = member.join(small_side(lead, BROADCAST_ROWS), F.col("key") == F.col("lk")).select("key", "dg", "label", "ll", "na", "no", F.xxhash64("dg").alias("h"))
    asking = inside.where("label <> ll").selectExpr("key", "dg", "label", "true asks", "pmod(h, na) x", "explode(sequence(0, no - 1)) y")
    asked = inside.selectExpr("key", "dg", "label", "false asks", "explode(sequence(0, na - 1)) x", "pmod(h, no) y").select(asking.columns)
    tiles = s.save(asking.withColumn("x", F.col("x").cast("int")).union(asked.withColumn("y", F.col("y").cast("int"))), "tiles")
    whole = texts.select(F.col("dg").alias("td"), "text").join(small_side(s.save(tiles.select("dg").distinct().withColumnRenamed("dg", "sd"), "tiled"), BROADCAST_ROWS), F.col("td") == F.col("sd"), "left_semi")
    near = tiles.join(whole, F.col("dg") == F.col("td")).select("key", "x", "y", "dg", "label", "asks", "text").groupBy("key", "x", "y").applyInArrow(_tile(threshold), "a binary, b binary")
    near = s.save(near, "near")
    near = s.save(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-distinct")
    labels = merged(labels, verified(near, "links-2"), "c2")
    s.drop("texts", "buckets", "pairs", "tiles", "near", "member-1", "member-2")

    label = nodes.select("dg", "first_id").join(small_side(labels, BROADCAST_ROWS), F.col("dg") == F.col("node"), "left").select("dg", "first_id", F.coalesce("label", "dg").alias("label"))
    label = s.save(label, "label")
    least = label.groupBy("label").agg(F.min("first_id").alias("least_id"), F.min_by("dg", F.struct(F.col("first_id").isNull(), "first_id", "dg")).alias("kept"))
    # a class without any doc_id is told apart by a negative number made from its label
    number = F.coalesce("least_id", F.lit(-1) - F.shiftrightunsigned(F.xxhash64("label"), 1))
    least = s.save(least.select(F.col("label").alias("l"), "least_id", number.alias("class_id"), "kept"), "least")
    classes = s.save(label.join(least, F.col("label") == F.col("l")).select(F.col("dg").alias("cd"), "class_id", "least_id", (F.col("dg") == F.col("kept")).alias("kept")), "classes")
    return signed.select("doc_id", "dg").join(classes, F.col("dg") == F.col("cd"), "left").select(
        "doc_id", "class_id", (F.col("kept") & F.col("doc_id").eqNullSafe(F.col("least_id"))).alias("stays"), "dg"
    )


def near_duplicates(docs: DataFrame, threshold: float = SIMILAR, bands: int = BANDS, rows: int = BAND_ROWS) -> DataFrame:
    """Per row: doc_id, class_id (the smallest doc_id of its class) and whether the row's text stays."""
    return classify(docs, threshold, bands, rows).drop("dg")


def keep_one(docs: DataFrame) -> DataFrame:
    """Pipeline form: of each class the document with the smallest doc_id, columns unchanged.

    Texts of one class that share this doc_id are told apart by their digests, and
    of rows equal in both one stays; a class without any doc_id keeps a row as well.
    """
    s, names = Scratch(docs.sparkSession, "keep-one"), docs.columns
    sd, sg, many, dg = (own_name(x, names) for x in ("sd", "sg", "many", "dg"))
    stay = classify(docs.select("doc_id", "text")).where("stays").groupBy("doc_id", "dg").agg((F.count("*") > 1).alias(many))
    stay = s.save(stay.select(F.col("doc_id").alias(sd), F.col("dg").alias(sg), many), "stay")
    rows = docs.withColumn(dg, _digest())
    kept = rows.join(small_side(stay, BROADCAST_ROWS), F.col("doc_id").cast("long").eqNullSafe(F.col(sd)) & (F.col(dg) == F.col(sg))).drop(dg)
    if not stay.where(many).isEmpty():
        kept = kept.where(~F.col(many)).unionByName(kept.where(many).dropDuplicates([sd, sg]))
    return kept.drop(sd, sg, many)


def op3_bagminhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
