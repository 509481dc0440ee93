"""The stream's sink and documents_spans against plain Python."""

from pyspark.sql import functions as F

from maskwright.functions import registry
from maskwright.plans.catalog import QUERIES
from maskwright.streaming.incremental import Sink, hits_per_window

from . import plain

SF = "/root/testdata/sf0.001"
DETS = registry.active()


def found(text):
    """(start, end, category, prefix, key) of each value."""
    for s, e, value, d in plain.spans(text, DETS):
        yield s, e, (d.category, d.prefix, value.casefold() if d.fold else value)


def numbered(batches):
    """Aliases and counts after the batches: keys are numbered by prefix as they are first seen."""
    alias, count, tops = {}, {}, {}
    for batch in batches:
        for _, text in sorted(batch):
            for _, _, key in found(text):
                if key not in alias:
                    tops[key[1]] = tops.get(key[1], 0) + 1
                    alias[key] = f"<{key[1]}_{tops[key[1]]}>"
                count[key] = count.get(key, 0) + 1
    return alias, count


def dictionary(batches):
    alias, count = numbered(batches)
    return sorted((alias[k], k[0], n) for k, n in count.items())


def masked(text, alias):
    out, at = [], 0
    for start, end, key in found(text):
        out += [text[at:start], alias[key]]
        at = end
    return "".join(out) + text[at:]


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_sink_over_batches_and_a_replay(spark, tmp_path):
    docs = documents(spark)
    parts = [[x for x in docs if x[0] % 3 == k] for k in (2, 0, 1)]
    sink = Sink(spark, f"file://{tmp_path}", DETS)
    frames = [spark.createDataFrame(p, "doc_id long, text string") for p in parts]
    for n in (0, 1, 1, 2):
        sink(frames[n], n)
    got = sorted(tuple(r) for r in sink.dictionary().select("alias", "category", "count").collect())
    assert got == dictionary(parts)
    alias, _ = numbered(parts)
    rows = spark.read.parquet(*(f"file://{tmp_path}/masked/batch={n}" for n in range(3)))
    assert {r.doc_id: r.text for r in rows.select("doc_id", "text").collect()} == {d: masked(t, alias) for d, t in docs}


def test_documents_spans(spark):
    got = sorted(tuple(r[c] for c in ("doc_id", "s", "e", "category")) for r in QUERIES["documents_spans"](spark, SF).select("doc_id", F.col("s").cast("long"), F.col("e").cast("long"), "category").collect())
    assert got == sorted((d, s, e, k[0]) for d, t in documents(spark) for s, e, k in found(t))


def test_tokenize_documents(spark):
    docs = documents(spark)
    alias, _ = numbered([docs])
    got = {r.doc_id: (r.text, r.replacements) for r in QUERIES["tokenize_documents"](spark, SF).collect()}
    assert got == {d: (masked(t, alias) if t is not None else None, len(list(found(t)))) for d, t in docs}


def test_rows_without_or_with_the_same_key(spark, tmp_path):
    rows = [(None, "mail jane@example.com"), (None, None), (1, "ip 10.0.0.1"), (1, "ip 10.0.0.2")]
    sink = Sink(spark, f"file://{tmp_path}", DETS)
    sink(spark.createDataFrame(rows, "doc_id long, text string"), 0)
    got = [(r.doc_id, r.text) for r in spark.read.parquet(f"file://{tmp_path}/masked/batch=0").collect()]
    assert sorted(got, key=str) == sorted([(None, "mail <EMAIL_1>"), (None, None), (1, "ip <IP_1>"), (1, "ip <IP_2>")], key=str)


def test_hits_per_window(spark, tmp_path):
    import datetime

    at = datetime.datetime(2024, 1, 1, 10, 5)
    spark.createDataFrame([(at, "10.0.0.1 10.0.0.2"), (at + datetime.timedelta(hours=5), "x")], "ts timestamp, text string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, text string").parquet(f"{tmp_path}/in")
    q = hits_per_window(stream, DETS).writeStream.format("memory").queryName("hits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["category"], r["count"]) for r in spark.table("hits").collect()] == [("ipv4", 2)]
