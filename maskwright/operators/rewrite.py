"""Replacing spans by mapped values: pseudonymise, reverse, reconcile, canonical closure.

A row is rewritten from its own places, so that rows need no key and texts are not
shuffled. The mapping goes to the tasks as a table while it has at most
``MAP_BYTES``. Beyond that each row's distinct keys are joined with it, salted, and
come back to the row by a number that a written copy of the table holds; then texts
are shuffled once.
"""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

TOKEN = r"<[A-Z0-9_]+(?:\.[A-Z0-9_]+)?_[0-9]+>"
MAP_BYTES, ENTRY_BYTES, SALT = 32 << 20, 160, 8
PLACES = "array<struct<s:int,e:int,mk:string>>"


def table_of(mapping: DataFrame) -> dict | None:
    """(mk, new) of a written table, or nothing if it is over ``MAP_BYTES``."""
    size = mapping.agg(F.coalesce(F.sum(F.octet_length("mk") + F.octet_length("new") + ENTRY_BYTES), F.lit(0))).first()[0]
    return None if size > MAP_BYTES else {r["mk"]: r["new"] for r in mapping.collect()}


def put(text: str, places, table) -> tuple[str, int]:
    """``text`` with each (start, end, key) whose key is in ``table`` replaced, and how many were."""
    out, at, n = [], 0, 0
    for start, end, key in places:
        new = table.get(key)
        if new is not None:
            out += (text[at:start], new)
            at, n = end, n + 1
    return ("".join(out) + text[at:], n) if n else (text, 0)


def put_tokens(text: str, table) -> tuple[str, int]:
    """``text`` with each alias token that is in ``table`` replaced."""
    if "<" not in text:
        return text, 0
    n = 0

    def new(m: re.Match) -> str:
        nonlocal n
        got = table.get(m[0])
        n += got is not None
        return m[0] if got is None else got

    return re.sub(TOKEN, new, text), n


def _result(pairs: list[tuple]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.int64())], ["text", "n"])


def _triples(column: pa.ListArray) -> list[list[tuple]]:
    ends, flat = column.offsets.to_pylist(), column.values
    items = list(zip(*(flat.field(k).to_pylist() for k in range(3))))
    return [items[a:b] for a, b in zip(ends, ends[1:])]


def _own(name: str) -> str:
    return f"{name}_{uuid.uuid4().hex[:8]}"


def substitute(docs: DataFrame, mapping: DataFrame, text: str = "text", places: Column | None = None) -> DataFrame:
    """``docs`` with ``text`` rewritten and ``replacements`` counted; a null text stays null.

    ``places`` is an array of (s, e, mk) by start, or nothing for all alias tokens;
    ``mapping`` has mk and new. Keys without a mapping stay.
    """
    spark = docs.sparkSession
    mapping = written(mapping.select("mk", "new"), "mapping")
    table = table_of(mapping)
    both, spots, rid, of, pairs = map(_own, ("both", "spots", "rid", "of", "pairs"))
    if places is not None:
        docs = docs.withColumn(spots, F.coalesce(places.cast(PLACES), F.expr(f"cast(array() as {PLACES})")))
    if table is not None:
        shared = spark.sparkContext.broadcast(table)

        def by_places(texts: pa.Array, at: pa.Array) -> pa.Array:
            return _result([(t, 0) if t is None else put(t, p, shared.value) for t, p in zip(texts.to_pylist(), _triples(at))])

        def by_tokens(texts: pa.Array) -> pa.Array:
            return _result([(t, 0) if t is None else put_tokens(t, shared.value) for t in texts.to_pylist()])

        kernel = F.arrow_udf(by_tokens, "text string, n bigint")(text) if places is None else F.arrow_udf(by_places, "text string, n bigint")(text, spots)
    else:
        docs = written(docs.withColumn(rid, F.monotonically_increasing_id()), "numbered")
        keys = F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)) if places is None else F.col(f"{spots}.mk")
        wanted = docs.select(rid, F.explode(F.array_distinct(keys)).alias("k")).withColumn("salt", F.pmod(F.xxhash64(rid), F.lit(SALT)))
        spare = mapping.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        per = wanted.join(spare, (F.col("k") == F.col("mk")) & (F.col("salt") == F.col("part"))).groupBy(F.col(rid).alias(of)).agg(F.map_from_entries(F.collect_list(F.struct("mk", "new"))).alias(pairs))
        docs = docs.join(per, F.col(rid) == F.col(of), "left").drop(of, rid)

        def by_row(texts: pa.Array, own: pa.Array, *at: pa.Array) -> pa.Array:
            rows = zip(texts.to_pylist(), own.to_pylist(), _triples(at[0]) if at else [None] * len(texts))
            return _result([(t, 0) if t is None else put_tokens(t, dict(m or ())) if p is None else put(t, p, dict(m or ())) for t, m, p in rows])

        if places is None:
            kernel = F.arrow_udf(lambda t, m: by_row(t, m), "text string, n bigint")(text, pairs)
        else:
            kernel = F.arrow_udf(lambda t, m, p: by_row(t, m, p), "text string, n bigint")(text, pairs, spots)
    out = docs.withColumn(both, kernel)
    return out.withColumn(text, F.col(f"{both}.text")).withColumn("replacements", F.col(f"{both}.n")).drop(both, spots, pairs)


def pseudonymise(docs: DataFrame, entries: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """Spans, as ``with_spans`` found them in the same row, to their aliases."""
    places = F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["ckey"].alias("mk")))
    return substitute(docs, entries.select(F.col("ckey").alias("mk"), F.col("alias").alias("new")), text, places).drop(spans)


def alias_shaped(docs: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose source already holds what looks like an alias: reversing would put foreign originals there."""
    return docs.where(F.col(text).rlike(TOKEN))


def reverse(docs: DataFrame, entries: DataFrame, text: str = "text") -> DataFrame:
    """Aliases back to their originals; unknown tokens stay. ``replacements`` counts what was restored."""
    return substitute(docs, entries.select(F.col("alias").alias("mk"), F.col("original").alias("new")).where("new is not null"), text)


def canonical(entries: DataFrame) -> DataFrame:
    """(alias, terminal): where each superseded alias leads.

    A pointer to nothing is a terminal; where a chain comes back to a node, that
    node is. Chains are walked for all aliases at once, a join for each step.
    """
    step = written(entries.where("superseded_by is not null").select(F.col("alias").alias("f"), F.col("superseded_by").alias("t")), "pointers")
    live = step.select(F.col("f").alias("alias"), F.col("t").alias("at"), F.array("f", "t").alias("path"), (F.col("f") == F.col("t")).alias("done"))
    while True:
        live = written(live, "walk")
        if live.where("not done").isEmpty():
            break
        ahead = live.join(step, (F.col("at") == F.col("f")) & ~F.col("done"), "left")
        again = F.array_contains("path", F.col("t"))
        live = ahead.select(
            "alias", F.coalesce("t", "at").alias("at"), F.when(F.col("t").isNull() | again, F.col("path")).otherwise(F.concat("path", F.array("t"))).alias("path"),
            (F.col("done") | F.col("t").isNull() | F.coalesce(again, F.lit(False))).alias("done"),
        )
    return live.where("alias <> at").select("alias", F.col("at").alias("terminal"))


def reconcile(docs: DataFrame, closure: DataFrame, text: str = "text") -> DataFrame:
    """Superseded aliases to their terminals."""
    return substitute(docs, closure.select(F.col("alias").alias("mk"), F.col("terminal").alias("new")), text)
