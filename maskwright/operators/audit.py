"""What sensitive values are left in a masked tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import with_spans

# Files that must not be in a masked tree.
SIDECARS = ("decode.json", "report.json", "report.html", "scan_report.json", "scan_report.html")


def leaks(docs: DataFrame, detectors, allow=frozenset(), first_line: str | None = None) -> DataFrame:
    """(file, category, line, start) of every span left; no alias map is needed. ``first_line`` names a column to add for pieces of a file."""
    found = with_spans(docs.where("text is not null"), detectors, "text", allow)
    add = F.col(first_line) if first_line else F.lit(0)
    return found.select(F.col("rel").alias("file"), add.alias("add"), F.explode("spans").alias("x")).select("file", F.col("x.category").alias("category"), (F.col("x.line") + F.col("add")).alias("line"), F.col("x.s").alias("start"))


def stray(files: DataFrame) -> DataFrame:
    return files.where(F.element_at(F.split("rel", "/"), -1).isin(*SIDECARS)).select(F.col("rel").alias("file"))
