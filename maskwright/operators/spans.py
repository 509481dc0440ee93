"""Span search as a column expression.

Texts go to Python workers in Arrow batches and only places, values and keys come
back: the patterns mean what Python's mean, borders next to combining marks
included, guards spare most texts most patterns, and time grows in proportion to
the text. The README compares it with the same patterns in JVM functions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.finder import Finder
from ..functions.registry import Detector
from .scratch import spread

FIELDS = {"s": pa.int32(), "e": pa.int32(), "value": pa.string(), "category": pa.string(), "prefix": pa.string(), "entity_id": pa.string(), "key": pa.string(), "ckey": pa.string(), "line": pa.int64()}
SPANS = "array<struct<s:int,e:int,value:string,category:string,prefix:string,entity_id:string,key:string,ckey:string,line:bigint>>"


def span_arrays(finder: Finder, texts: pa.Array) -> pa.ListArray:
    """The spans of each text of a batch, with the number of the line on which they start."""
    ends, rows = [0], []
    for t in texts.to_pylist():
        at, line = 0, 1
        for x in finder.spans(t):
            line += t.count("\n", at, x.start)
            at, d = x.start, x.detector
            rows.append((x.start, x.end, x.value, d.category, d.prefix, d.entity_id, x.key, x.ckey(), line))
        ends.append(len(rows))
    columns = list(zip(*rows)) or [()] * len(FIELDS)
    flat = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, FIELDS.values())], list(FIELDS))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)


def span_column(text: Column, detectors: list[Detector], allow: frozenset[str] = frozenset()) -> Column:
    finder = Finder(detectors, allow)

    def find(texts: pa.Array) -> pa.Array:
        return span_arrays(finder, texts)

    # as if random, so that Catalyst never searches a second time for a filter or a second use
    return F.arrow_udf(find, SPANS).asNondeterministic()(text)


def with_spans(df: DataFrame, detectors: list[Detector], text: str = "text", allow: frozenset[str] = frozenset(), out: str = "spans") -> DataFrame:
    """``df`` with an array of claimed spans by start. A null text has none. Other columns, ``out`` but for one of that name, stay."""
    if not df.isStreaming:
        df = spread(df)
    return df.withColumn(out, span_column(F.col(text), detectors, allow))


def occurrences(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """A row per span: ``keys``, place, value, key and what the alias is made from."""
    return df.select(*keys, F.explode(spans).alias("x")).select(*keys, *(f"x.{name}" for name in FIELDS))


__all__ = ["occurrences", "span_arrays", "span_column", "with_spans"]
