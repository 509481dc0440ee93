"""The search and the rewriting as SQL functions of a session.

``mask_spans(text)`` is an array of spans, ``mask_find(text)`` a table of them for
``lateral``, ``mask_text(text)`` the text with the aliases of a dictionary: it goes
to the tasks while it is small, and is looked up in the shared folder beyond.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.finder import Finder
from ..operators.lookup import packed
from ..operators.rewrite import put, table_of
from ..operators.scratch import written
from ..operators.spans import SPANS, span_arrays

ASKED = 5_000  # places that are looked up at once


def register(spark: SparkSession, detectors, entries: DataFrame | None = None, allow: frozenset[str] = frozenset()) -> None:
    finder = Finder(detectors, allow)

    def spans(texts: pa.Array) -> pa.Array:
        return span_arrays(finder, texts)

    class Find:
        def eval(self, text: str):
            for x in finder.spans(text):
                yield x.start, x.end, x.value, x.detector.category

    spark.udf.register("mask_spans", F.arrow_udf(spans, SPANS).asNondeterministic())
    spark.udtf.register("mask_find", F.udtf(Find, returnType="s int, e int, value string, category string"))
    if entries is not None:
        mapping = written(entries.select(F.col("ckey").alias("mk"), F.col("alias").alias("new")), "mapping")
        table = table_of(mapping)
        large = table is None
        shared = packed(mapping) if large else spark.sparkContext.broadcast(table)

        def put_all(rows: list[tuple]) -> list[str | None]:
            known = shared.table({x.ckey() for _, found in rows for x in found}) if large else shared.value
            return [t and put(t, [(x.start, x.end, x.ckey()) for x in found], known)[0] for t, found in rows]

        def text(texts: pa.Array) -> pa.Array:
            out, rows, held = [], [], 0
            for t in texts.to_pylist():
                rows.append((t, finder.spans(t)))
                held += len(rows[-1][1])
                if held >= ASKED:
                    out += put_all(rows)
                    rows, held = [], 0
            return pa.array(out + put_all(rows), pa.string())

        spark.udf.register("mask_text", F.arrow_udf(text, "string"))
