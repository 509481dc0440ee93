"""Rewriting as a SQL function, with dictionaries that go to the tasks and larger ones."""

import mmap

import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from maskwright.functions import registry
from maskwright.operators import aliases, lookup, rewrite
from maskwright.operators.scratch import written
from maskwright.operators.spans import occurrences, with_spans
from maskwright.plans import sqlfunctions


@pytest.mark.parametrize("most", [32 << 20, 1])
def test_mask_text(spark, monkeypatch, most):
    monkeypatch.setattr(rewrite, "MAP_BYTES", most)
    if most == 1:
        monkeypatch.setattr(lookup, "FILE_ROWS", 7)
        monkeypatch.setattr(sqlfunctions, "ASKED", 20)
    texts = [f"from 10.0.{i // 250}.{i % 250} by É{i}@example.com, a{i}@example.com and 10.0.0.1" for i in range(1000)] + ["", None, "none", "x" * 200_000 + " 10.0.0.2"]
    docs = written(with_spans(spark.createDataFrame(enumerate(texts), "id long, text string"), registry.active()), "spans")
    occ = occurrences(docs, ["id"]).withColumn("file_ord", F.col("id")).withColumn("rel", F.lit("x"))
    entries = written(aliases.assign(occ, aliases.empty_entries(spark), aliases.empty_entities(spark)), "entries")
    entries = entries.where("alias not in ('<IP_7>', '<EMAIL_9>')")  # what a dictionary does not know stays
    want = {r["id"]: r["text"] for r in rewrite.pseudonymise(docs, written(entries, "known")).collect()}
    sqlfunctions.register(spark, registry.active(), entries)
    rows = spark.sql("select id, mask_text(text) text from {docs}", docs=docs.select("id", "text")).collect()
    assert len(rows) == len(texts) and {r["id"]: r["text"] for r in rows} == want
    assert want[1001] is None and "<IP_2>" in want[500] and "10.0.0.6" in want[6] and want[1003].endswith("x <IP_3>")


def test_lookup(spark, monkeypatch):
    mapping = written(spark.range(200_000).selectExpr("'k' || id mk", "case when id % 5 > 0 then repeat('é', cast(id % 4 as int)) || id end new"), "mapping")
    found = lookup.packed(mapping)
    assert len(found.files) > 1 and sum(f[2] for f in found.files) == 160_000
    keys = [f"k{i}" for i in range(-300, 200_300, 7)]
    want = {f"k{i}": "é" * (i % 4) + str(i) for i in range(-300, 200_300, 7) if 0 <= i < 200_000 and i % 5}
    assert found.table(keys) == want and isinstance(next(iter(found.open.values())), mmap.mmap)
    # a store whose files can't be mapped, and fewer files kept than there are
    monkeypatch.setattr(lookup, "open_file", lambda uri: (pafs.SubTreeFileSystem("/", pafs.LocalFileSystem()), uri.removeprefix("file://").lstrip("/")))
    monkeypatch.setattr(lookup, "KEPT", 1)
    found = lookup.Lookup(found.folder, found.files)
    assert found.table(keys) == want and [type(x) for x in found.open.values()] == [bytes]
    assert lookup.packed(mapping.limit(0)).table(keys) == {}
