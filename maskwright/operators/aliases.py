"""The alias dictionary as tables: numbering, counts, entities, supersession, legend.

``entries``: alias, ckey, counter, n, original, category, prefix, entity_id,
count, superseded_by, supersedes. ``entities``: entity_id, label, type, pretty,
notes, ord. ``sightings``: ckey, rel, ord, a row for each file that holds a key, as
a common address is in all of them. Counters are never stored; they are ``max(n)``
per counter.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.registry import classify
from .scratch import written

ENTRIES = (
    "alias string, ckey string, counter string, n long, original string, category string, prefix string, entity_id string, "
    "count long, superseded_by string, supersedes array<string>"
)
SIGHTINGS = "ckey string, rel string, ord long"
ENTITIES = "entity_id string, label string, type string, pretty string, notes string, ord long"
# Label prefixes of the known entity types.
ENTITY_PREFIX = {"device": "DEV", "person": "USR", "site": "SITE", "service": "SVC"}
WINDOW_ROWS = 2_000_000


def empty_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ENTRIES)


def empty_sightings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SIGHTINGS)


def empty_entities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ENTITIES)


def entity_prefix(kind: str) -> str:
    return ENTITY_PREFIX.get(kind.lower()) or re.sub(r"[^A-Z]", "", kind.upper())[:4] or "ENT"


def numbered(rows: DataFrame, group: str, order: list[str], out: str = "rank") -> DataFrame:
    """Rank from 1 inside ``group`` by ``order``.

    Up to ``WINDOW_ROWS`` rows a window does; beyond, rows are range-sorted over
    all tasks and a small table of counts gives each task's offset, so that one
    huge group is no single task.
    """
    rows = written(rows, "keys")
    if rows.count() <= WINDOW_ROWS:
        return rows.withColumn(out, F.row_number().over(Window.partitionBy(group).orderBy(*order)).cast("long"))
    ranged = written(rows.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = written(sizes.withColumn("_off", F.coalesce(before, F.lit(0))).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_off"), "offsets")
    inside = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    joined = ranged.withColumn("_in", inside).join(offsets, (F.col(group) == F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(out, (F.col("_in") + F.col("_off")).cast("long")).drop("_part", "_in", "_off", "_g", "_p")


def counters(entries: DataFrame) -> DataFrame:
    return entries.groupBy("counter").agg(F.max("n").alias("top"))


def assign(occ: DataFrame, prior: DataFrame, entities: DataFrame) -> DataFrame:
    """``prior`` with the occurrences counted and new keys numbered in first-seen order.

    ``occ`` has file_ord, rel, s and the columns of ``spans.occurrences``; existing
    aliases never change. A key's original is its first surface form.
    """
    place = F.struct("file_ord", "s", "value")
    per = occ.groupBy("ckey").agg(
        F.min(place).alias("first"), F.count("*").alias("seen"), F.min_by("category", place).alias("category"), F.any_value("prefix").alias("prefix"), F.any_value("entity_id").alias("entity_id")
    )
    per = written(per, "per-key")
    old = prior.join(per.select(F.col("ckey").alias("k"), "seen"), F.col("ckey") == F.col("k"), "left")
    old = old.withColumn("count", F.col("count") + F.coalesce("seen", F.lit(0))).drop("k", "seen")
    new = per.join(prior.select(F.col("ckey").alias("k")), F.col("ckey") == F.col("k"), "left_anti")
    new = new.join(entities.select(F.col("entity_id").alias("eid"), "label"), F.col("entity_id") == F.col("eid"), "left")
    new = new.withColumn("counter", F.concat_ws(".", "label", "prefix")).withColumn("o", F.col("first.file_ord")).withColumn("p", F.col("first.s"))
    new = numbered(new, "counter", ["o", "p", "ckey"])
    new = new.join(counters(prior).withColumnRenamed("counter", "c"), F.col("counter") == F.col("c"), "left")
    n = F.col("rank") + F.coalesce("top", F.lit(0))
    new = new.select(
        F.concat(F.lit("<"), "counter", F.lit("_"), n.cast("string"), F.lit(">")).alias("alias"), "ckey", "counter", n.alias("n"), F.col("first.value").alias("original"),
        "category", "prefix", "entity_id", F.col("seen").alias("count"), F.lit(None).cast("string").alias("superseded_by"), F.expr("cast(array() as array<string>)").alias("supersedes"),
    )
    return old.unionByName(new)


def sightings(occ: DataFrame, prior: DataFrame) -> DataFrame:
    """``prior`` and the files in which ``occ`` has keys, behind it in file order."""
    top = prior.agg(F.coalesce(F.max("ord") + 1, F.lit(0))).first()[0]
    now = occ.where("rel is not null").groupBy("ckey", "rel").agg((F.min("file_ord") + top).alias("ord"))
    return prior.unionByName(now).groupBy("ckey", "rel").agg(F.min("ord").alias("ord"))


def register_entities(spark: SparkSession, rows: list[dict], prior: DataFrame) -> DataFrame:
    """Labels in table order; known entities keep theirs and only blank names and notes are filled. An operator's table: small."""
    known = {r["entity_id"]: r.asDict() for r in prior.collect()}
    tops: dict[str, int] = {}
    for e in known.values():
        m = re.fullmatch(r"(.*?)(\d+)", e["label"])
        tops[m[1]] = max(tops.get(m[1], 0), int(m[2]))
    for row in rows:
        e = known.get(row["id"])
        if e is None:
            p = entity_prefix(row["type"])
            tops[p] = tops.get(p, 0) + 1
            known[row["id"]] = {"entity_id": row["id"], "label": f"{p}{tops[p]:04d}", "type": row["type"], "pretty": row["pretty_name"], "notes": row["notes"], "ord": len(known)}
        else:
            e["pretty"], e["notes"] = e["pretty"] or row["pretty_name"], e["notes"] or row["notes"]
    return spark.createDataFrame([tuple(e[c.split()[0]] for c in ENTITIES.split(", ")) for e in known.values()], ENTITIES)


def classified(value: Column) -> Column:
    """``classify`` as a column: a struct of category and prefix."""
    def run(values: pa.Array) -> pa.Array:
        got = [classify(v or "") for v in values.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([g[k] for g in got], pa.string()) for k in (0, 1)], ["category", "prefix"])

    return F.arrow_udf(run, "category string, prefix string").asNondeterministic()(value)


def identifier_rows(spark: SparkSession, rows: list[dict], first: int = 0) -> DataFrame:
    """(value, key, category, prefix, entity_id, ord) of the identifiers of an operator's table."""
    ids = [(v, v.casefold(), *classify(v), r["id"]) for r in rows for v in r["identifiers"]]
    return spark.createDataFrame([(*x, i + first) for i, x in enumerate(ids)], "value string, key string, category string, prefix string, entity_id string, ord long")


def link_entities(identifiers: DataFrame, prior: DataFrame, entities: DataFrame) -> DataFrame:
    """Reserve an alias for each identifier (see ``identifier_rows``) and mark plain aliases of the same value as superseded."""
    ids = identifiers.withColumn("ckey", F.concat_ws("\0", F.lit("E"), "entity_id", "prefix", "key"))
    occ = ids.select("ckey", F.col("ord").alias("file_ord"), F.lit(None).cast("string").alias("rel"), F.lit(0).alias("s"), "value", "category", "prefix", "entity_id")
    fresh = occ.join(prior.select(F.col("ckey").alias("k")), F.col("ckey") == F.col("k"), "left_anti")
    after = written(assign(fresh, prior, entities), "linked")
    probe = ids.select("ckey", F.array(F.col("value"), F.col("key")).alias("tries"), "category", "ord")
    probe = probe.select(F.col("ckey").alias("ek"), "ord", F.posexplode("tries").alias("turn", "try"), "category").withColumn("pk", F.concat(F.lit("C\0"), "category", F.lit("\0"), "try"))
    plain = after.where("entity_id is null").select(F.col("ckey").alias("pk2"), F.col("alias").alias("plain"))
    hit = probe.join(plain, F.col("pk") == F.col("pk2"))
    first = hit.groupBy("ek", "ord").agg(F.min_by("plain", "turn").alias("plain"))
    first = first.join(after.select(F.col("ckey").alias("k"), F.col("alias").alias("by")), F.col("ek") == F.col("k")).select("plain", "by", "ord")
    first = written(first, "superseded")
    last = first.groupBy("plain").agg(F.max_by("by", "ord").alias("by2")).withColumnRenamed("plain", "p1")
    lists = first.groupBy("by").agg(F.array_distinct(F.array_sort(F.collect_list(F.struct("ord", "plain")))["plain"]).alias("more")).withColumnRenamed("by", "b1")
    out = after.join(last, F.col("alias") == F.col("p1"), "left").join(lists, F.col("alias") == F.col("b1"), "left")
    out = out.withColumn("superseded_by", F.coalesce("by2", "superseded_by")).withColumn("supersedes", F.array_union("supersedes", F.coalesce("more", F.expr("array()"))))
    # reserved, not seen: aliases made here count no occurrence
    made = fresh.select(F.col("ckey").alias("mk")).distinct()
    out = out.join(made, F.col("ckey") == F.col("mk"), "left").withColumn("count", F.when(F.col("mk").isNotNull(), F.lit(0)).otherwise(F.col("count")).cast("long"))
    return out.select(*(c.split()[0] for c in ENTRIES.split(", ")))


def categories(entries: DataFrame) -> DataFrame:
    """Unique aliases and occurrences per category."""
    return entries.groupBy("category").agg(F.count("*").alias("unique_values"), F.sum("count").alias("occurrences"))


def legend(entries: DataFrame, entities: DataFrame) -> DataFrame:
    """Per entity its label, names, aliases and the aliases they supersede, both in numbering order."""
    order = F.struct("counter", "n", "alias")
    own = entries.where("entity_id is not null").groupBy("entity_id").agg(F.array_sort(F.collect_list(order))["alias"].alias("aliases")).withColumnRenamed("entity_id", "e1")
    heads = entries.where("entity_id is not null").select(F.col("alias").alias("ha"), F.col("entity_id").alias("e2"))
    past = entries.where("superseded_by is not null").join(heads, F.col("superseded_by") == F.col("ha")).groupBy("e2").agg(F.array_sort(F.collect_list(order))["alias"].alias("superseded_aliases"))
    none = F.expr("cast(array() as array<string>)")
    return entities.join(own, F.col("entity_id") == F.col("e1"), "left").join(past, F.col("entity_id") == F.col("e2"), "left").select(
        "label", "entity_id", "pretty", "type", "notes", F.coalesce("aliases", none).alias("aliases"), F.coalesce("superseded_aliases", none).alias("superseded_aliases"), "ord"
    )


def starter_rows(entries: DataFrame) -> DataFrame:
    """Identifiers not yet in any entity, for the operator to group."""
    return entries.where(F.col("entity_id").isNull() & F.col("category").isin("ipv4", "ipv6", "mac", "email", "fqdn", "host")).select("original").distinct().orderBy("original")


def is_alias(value: Column) -> Column:
    return value.rlike(r"\A<[A-Z0-9_]+(?:\.[A-Z0-9_]+)?_[0-9]+>\z")
