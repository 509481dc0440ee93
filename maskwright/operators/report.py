"""Run reports: aggregates and names only, never originals."""

from __future__ import annotations

import html
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import __version__
from . import aliases

#: How many names a report lists; it states how many there are.
LISTED = 1000


def totals(stats: DataFrame) -> DataFrame:
    done = F.col("status").isin("processed", "reconciled")
    return stats.agg(
        F.count("*").alias("files_total"), F.count_if(done).alias("files_processed"), F.count_if(~done).alias("files_copied"),
        F.coalesce(F.sum(F.when(done, F.col("replacements"))), F.lit(0)).alias("replacements"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes_total"),
    )


def skipped(stats: DataFrame) -> list[dict]:
    """The first files in order that were copied through."""
    rows = stats.where(~F.col("status").isin("processed", "reconciled")).orderBy("file_ord").select(F.col("rel").alias("file"), "status")
    return [r.asDict() for r in rows.limit(LISTED).collect()]


def summary(mode: str, src: str, dst: str | None, stamp: str, stats: DataFrame, entries: DataFrame, entities: int, verify: str | None = None, digest: str | None = None, warnings=()) -> dict:
    t = totals(stats).first()
    cats = {r["category"]: {"unique": r["unique_values"], "occurrences": r["occurrences"]} for r in aliases.categories(entries).orderBy("category").collect()}
    return {
        "mode": mode, "tool": "maskwright", "version": __version__, "timestamp": stamp, "source": src, "target": dst,
        "files_total": t["files_total"], "files_processed": t["files_processed"], "files_copied_unprocessed": t["files_copied"], "total_replacements": t["replacements"],
        "unique_values": sum(c["unique"] for c in cats.values()), "entities": entities, "run_digest_sha256": digest, "by_category": cats,
        "skipped": skipped(stats), "warnings": list(warnings), "verify": verify,
    }


def write_html(data: dict, path: Path) -> None:
    cell = lambda x, tag="td": f"<{tag}>{html.escape(str(x), quote=True)}</{tag}>"
    table = lambda head, rows: ["<table>", f"<tr>{''.join(cell(h, 'th') for h in head)}</tr>", *(f"<tr>{''.join(map(cell, r))}</tr>" for r in rows or [["none"]]), "</table>"]
    verdict = data.get("verify")
    parts = [
        "<!doctype html><meta charset='utf-8'><title>Masking report</title><style>body{font:14px sans-serif}td,th{padding:2px 8px;text-align:left}.PASS{color:green}.FAIL{color:red}</style><h1>Masking report</h1>",
        *([f"<p>Second search of the result: <b class='{html.escape(verdict)}'>{html.escape(verdict)}</b></p>"] if verdict else []),
        *table(["setting", "value"], [(k, "" if v is None else v) for k, v in data.items() if not isinstance(v, (dict, list))]),
        "<h2>Values by category</h2>", *table(["category", "distinct", "found"], [(c, x["unique"], x["occurrences"]) for c, x in data["by_category"].items()]),
        "<h2>Copied through, not searched</h2>", *table(["file", "why"], [(x["file"], x["status"]) for x in data["skipped"]]),
        "<h2>Warnings</h2>", *table(["warning"], [(w,) for w in data["warnings"]]),
    ]
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(parts), encoding="utf-8")
