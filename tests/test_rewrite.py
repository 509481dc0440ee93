"""Rewriting inside the row: null and repeated keys, extra columns, large dictionaries, scratch folders."""

import pytest
from pyspark.sql import functions as F

from maskwright.functions import registry
from maskwright.operators import aliases, rewrite, scratch
from maskwright.operators.spans import occurrences, with_spans

ROWS = [(1, "ip 10.0.0.1"), (1, "ip 10.0.0.2"), (None, "mail jane@example.com"), (None, None), (2, ""), (3, "10.0.0.1 10.0.0.1, <IP_9>"), (3, "10.0.0.1 10.0.0.1, <IP_9>"), (4, "x" * 200_000 + " 10.0.0.2")]
WANT = [(1, "ip <IP_1>", 1), (1, "ip <IP_2>", 1), (None, "mail <EMAIL_1>", 1), (None, None, 0), (2, "", 0), (3, "<IP_1> <IP_1>, <IP_9>", 2), (3, "<IP_1> <IP_1>, <IP_9>", 2), (4, "x" * 200_000 + " <IP_2>", 1)]
key = lambda r: tuple((x is not None, x) for x in r)


def masked(spark):
    df = spark.createDataFrame(ROWS, "id long, text string").selectExpr("*", "'a' mk", "'b' new", "7 r", "8 pairs", "9 replacements_", "'c' both")
    docs = scratch.written(with_spans(df, registry.active()), "spans")
    occ = occurrences(docs, ["id"]).withColumn("file_ord", F.coalesce("id", F.lit(9))).withColumn("rel", F.lit("x"))
    return df, docs, aliases.assign(occ, aliases.empty_entries(spark), aliases.empty_entities(spark))


@pytest.mark.parametrize("most", [32 << 20, 1])
def test_there_and_back(spark, monkeypatch, most):
    monkeypatch.setattr(rewrite, "MAP_BYTES", most)
    df, docs, entries = masked(spark)
    entries = scratch.written(entries, "entries")
    out = scratch.written(rewrite.pseudonymise(docs, entries), "out")
    assert sorted((tuple(r) for r in out.select("id", "text", "replacements").collect()), key=key) == sorted(WANT, key=key)
    assert set(out.columns) == {*df.columns, "replacements"} and {tuple(r) for r in out.select("mk", "new", "r", "pairs", "both").collect()} == {("a", "b", 7, 8, "c")}
    back = rewrite.reverse(out.drop("replacements"), entries)
    assert sorted((tuple(r) for r in back.select("id", "text").collect()), key=key) == sorted(ROWS, key=key)
    assert rewrite.pseudonymise(docs.limit(0), entries).count() == 0


def test_texts_are_not_shuffled(spark):
    _, docs, entries = masked(spark)
    plan = rewrite.pseudonymise(docs, scratch.written(entries, "entries"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_numbering_needs_no_single_task(spark, monkeypatch):
    df = spark.range(1000).selectExpr("'g' || id % 2 g", "id * 37 % 1000 o")
    want = sorted(tuple(r) for r in aliases.numbered(df, "g", ["o"]).collect())
    monkeypatch.setattr(aliases, "WINDOW_ROWS", 10)
    assert sorted(tuple(r[c] for c in ("g", "o", "rank")) for r in aliases.numbered(df, "g", ["o"]).collect()) == want


def test_scratch_is_shared_or_local():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())


def test_small_scans_are_dealt_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert scratch.row_groups(spark, docs.inputFiles()) < cores and scratch.spread(docs).rdd.getNumPartitions() == cores
    assert scratch.spread(spark.range(5)).count() == 5
