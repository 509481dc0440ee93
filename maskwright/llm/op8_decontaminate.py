"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Only DataFrame functions. A document's windows are hashed inside its own row and
tested against the set of test window hashes. The texts with a hit, known by digest,
are then gone through word by word: what stands there must be a test window. Only
(digest, place) rows and texts with a hit are ever moved.

While the benchmark has at most ``set_limit`` windows the set is part of the plan
and the test is made inside the row. Beyond, hashes of windows (no words) go through
a join with the set, which is broadcast up to ``BROADCAST_WINDOWS`` rows of 16 bytes;
beyond that too the join moves hashes, three times a text's bytes, and no words.

Defined cases: a null or empty text, or one of separators only, has no words and
is clean; an item without words, or with a null id, is ignored; repeated items
count once, repeated documents each for themselves; an empty benchmark leaves
all documents clean; very long texts are one row each, tested in place; other
columns are ignored, and the pipeline form returns them, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, own_name, small_side, spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SET_LIMIT, BROADCAST_ROWS, BROADCAST_WINDOWS = 10, 100_000, 500_000, 4_000_000


def words_of(col: str):
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(col), F.lit("")), UPPER, LOWER), SEPARATORS), "")


def grams_of(benchmark: DataFrame, n: int) -> DataFrame:
    """Distinct (h, len, gram, item): the windows of all items."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of("text").alias("w")).where("item is not null and size(w) > 0")
    at = F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))))
    grams = items.select("item", "w", at.alias("i")).select("item", F.slice("w", F.col("i") + 1, n).alias("g"))
    return grams.select(
        F.xxhash64(F.transform("g", lambda x: F.xxhash64(x))).alias("h"), F.size("g").alias("len"), F.array_join("g", " ").alias("gram"), "item"
    ).distinct()


def _digest():
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _places(lens: list[int], keys: dict[int, list[int]] | None):
    """A row's windows as (pos, len, h); with ``keys`` only those of the set."""
    empty = F.expr("cast(array() as array<struct<pos:int,len:int,h:bigint>>)")
    found = empty
    for ln in lens:
        picked = f"transform(sequence(0, size(wh) - {ln}), i -> named_struct('pos', i, 'len', {ln}, 'h', xxhash64(slice(wh, i + 1, {ln}))))"
        if keys is not None:
            picked = f"filter({picked}, x -> x.h in ({','.join(f'{h}L' for h in keys[ln])}))"
        found = F.concat(found, F.when(F.size("wh") >= ln, F.expr(picked)).otherwise(empty))
    return found


def hits(docs: DataFrame, benchmark: DataFrame, n: int, set_limit: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(dg, doc_id, n_words) of each row, and (hd, pos, len, items) of each verified window of each text."""
    grams = scratch.save(grams_of(benchmark, n), "grams")
    keys = scratch.save(grams.select("h", "len").distinct(), "keys")
    lens = sorted(r["len"] for r in keys.select("len").distinct().collect())  # at most n
    rows = docs.select("doc_id", "text", _digest().alias("dg")).withColumn("w", words_of("text")).withColumn("wh", F.transform("w", lambda x: F.xxhash64(x)))
    if keys.count() <= set_limit:
        of: dict[int, list[int]] = {ln: [] for ln in lens}
        for r in keys.collect():  # bounded by the set's limit
            of[r["len"]].append(r["h"])
        base = scratch.save(rows.select("dg", "doc_id", F.size("w").cast("long").alias("n_words"), _places(lens, of).alias("hit")), "rows")
        found = base.select("dg", F.explode("hit").alias("x")).select("dg", "x.*")
        base = base.drop("hit")
    else:
        base = scratch.save(rows.select("dg", "doc_id", F.size("w").cast("long").alias("n_words")), "rows")
        flat = rows.select("dg", F.explode(_places(lens, None)).alias("x")).select("dg", "x.*")
        # grouped first, so that a window of many copies is one row
        found = flat.join(small_side(keys.select(F.col("h").alias("kh"), F.col("len").alias("kl")), BROADCAST_WINDOWS), (F.col("h") == F.col("kh")) & (F.col("len") == F.col("kl")), "left_semi")
    per = scratch.save(found.groupBy("dg").agg(F.collect_set(F.struct("pos", "len", "h")).alias("hit")).withColumnRenamed("dg", "hd"), "found")
    texts = docs.select("text", _digest().alias("dg")).join(small_side(per.select(F.col("hd").alias("sd")), BROADCAST_ROWS), F.col("dg") == F.col("sd"), "left_semi").groupBy("dg").agg(F.any_value("text").alias("text"))
    placed = texts.join(per, F.col("dg") == F.col("hd")).select("hd", words_of("text").alias("w"), "hit")
    spelt = F.expr("transform(hit, x -> named_struct('pos', x.pos, 'len', x.len, 'h', x.h, 'gram', array_join(slice(w, x.pos + 1, x.len), ' ')))")
    spelt = placed.select("hd", F.explode(spelt).alias("x")).select("hd", "x.*")
    table = scratch.save(grams.groupBy("h", "len", "gram").agg(F.collect_set("item").alias("items")), "table")
    verified = scratch.save(spelt.join(small_side(table, set_limit), ["h", "len", "gram"]).select("hd", "pos", "len", "items"), "verified")
    scratch.drop("grams", "keys", "found", "table")
    return base, verified


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, set_limit: int = SET_LIMIT) -> DataFrame:
    """Words, hit words and items of each document."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    base, verified = hits(spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, n, set_limit, scratch)
    spans = F.collect_set(F.struct("pos", (F.col("pos") + F.col("len")).alias("end")))
    per = verified.groupBy("hd").agg(F.array_sort(spans).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    covered = F.expr(
        "aggregate(spans, named_struct('n', 0L, 'e', 0), (a, s) -> named_struct('n', a.n + greatest(0, s.end - greatest(a.e, s.pos)), 'e', greatest(a.e, s.end)), a -> a.n)"
    )
    per = scratch.save(per.select("hd", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")), "per-text")
    out = base.join(small_side(per, BROADCAST_ROWS), F.col("dg") == F.col("hd"), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, set_limit: int = SET_LIMIT) -> DataFrame:
    """Pipeline form: the documents without any verified window, columns unchanged."""
    scratch, names = Scratch(docs.sparkSession, "decontaminate"), docs.columns
    _, verified = hits(docs.select(F.lit(None).cast("long").alias("doc_id"), "text"), benchmark, n, set_limit, scratch)
    digest, bad = own_name("digest", names), own_name("bad", names)
    table = scratch.save(verified.select(F.col("hd").alias(bad)).distinct(), "bad")
    rows = docs.withColumn(digest, _digest())
    return rows.join(small_side(table, BROADCAST_ROWS), F.col(digest) == F.col(bad), "left_anti").drop(digest)


def op8_ngram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
with dw as (select row_number() over () rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
bw as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark where item_id is not null),
g as (select distinct item_id, len(w[i + 1:i + 10]) ln, array_to_string(w[i + 1:i + 10], ' ') gram from (select item_id, w, unnest(range(0, greatest(len(w) - 10, 0) + 1)) i from bw where len(w) > 0)),
lens as (select distinct ln from g),
p as (select rid, ln, i, array_to_string(w[i + 1:i + ln], ' ') gram from (select rid, w, ln, unnest(range(0, len(w) - ln + 1)) i from dw, lens where len(w) >= ln)),
h as (select p.rid, p.i, p.ln, g.item_id from p join g on g.gram = p.gram and g.ln = p.ln),
c as (select rid, count(distinct i + k) n_hit from (select distinct rid, i, unnest(range(0, ln)) k from h) group by rid),
it as (select rid, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) items from h group by rid)
select doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
  sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from dw left join c using (rid) left join it using (rid)
"""
