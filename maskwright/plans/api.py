"""Whole runs over file trees: scan, strip, verify, reverse, reconcile."""

from __future__ import annotations

import datetime
import os
import subprocess
import sys
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from dataclasses import dataclass, field
from pathlib import Path

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import __version__
from ..functions import registry
from ..operators import aliases, audit, custody, flagging, report, rewrite
from ..operators.scratch import cleared, written
from ..operators.spans import occurrences, with_spans
from ..sources import config, filetree, vault
from .progress import Event, Meter

SIDE = "_pii"
KEYS = ["rel", "chunk"]


@dataclass
class Options:
    config: str | None = None
    profile: str | None = None
    project: str | None = None
    entities: str | None = None
    enable: list[str] | None = None
    disable: list[str] | None = None
    include: list[str] | None = None
    exclude: list[str] | None = None
    allowlist: list[str] | None = None
    denylist: list[str] | None = None
    custom: list[dict] | None = None
    max_bytes: int | None = None
    stream_threshold: int | None = None
    emit_entities: bool = False
    provider: flagging.Provider | None = None
    client: object = field(default=flagging.post)
    #: (path, masked text) -> (text, further replacements), called by tasks for each file that was read whole
    post_pass: Callable[[str, str], tuple[str, int]] | None = None
    progress: Callable[[Event], None] | None = None

    def resolve(self) -> config.Settings:
        names = ("enable", "disable", "include", "exclude", "allowlist", "denylist", "custom", "max_bytes", "stream_threshold")
        return config.resolve(self.profile, self.config, **{n: getattr(self, n) for n in names})


def now() -> str:
    return datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")


def guard(src: Path, dst: Path) -> None:
    if src == dst or src.is_relative_to(dst) or dst.is_relative_to(src):
        raise ValueError("source and target must not be the same or inside each other")


def lock_down(path: Path) -> str | None:
    """Only the owner may enter; a failure is a warning."""
    try:
        if os.name == "nt":
            own = f"{os.environ.get('USERNAME', '')}:(OI)(CI)F"
            subprocess.run(["icacls", str(path), "/inheritance:r", "/grant:r", own], check=True, capture_output=True)
        else:
            path.chmod(0o700)
    except (OSError, subprocess.CalledProcessError) as e:
        return f"could not restrict {path}: {e}"
    return None


@dataclass
class Masked:
    docs: DataFrame
    tables: vault.Tables
    notes: list
    model_errors: list


def bind_entities(spark: SparkSession, tables: vault.Tables, path: str | None) -> list:
    """Register the table's entities, reserve and link their identifiers in ``tables``, and give their detectors."""
    rows = config.entity_rows(path) if path and Path(path).is_file() else []
    if rows:
        n = sum(len(r["identifiers"]) for r in rows)
        tables.entities = written(aliases.register_entities(spark, rows, tables.entities), "entities")
        tables.entries = written(aliases.link_entities(aliases.identifier_rows(spark, rows, -n), tables.entries, tables.entities), "entries")
    return registry.for_entities(rows)


def post_passed(docs: DataFrame, change: Callable[[str, str], tuple[str, int]]) -> DataFrame:
    """``docs`` after an operator's own pass over masked texts of whole files."""

    def run(texts: pa.Array, rels: pa.Array) -> pa.Array:
        got = [change(r, t) for t, r in zip(texts.to_pylist(), rels.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int64())], ["text", "n"])

    own = docs.where("whole and text is not null").withColumn("_p", F.arrow_udf(run, "text string, n bigint").asNondeterministic()("text", "rel"))
    own = own.withColumn("text", F.col("_p.text")).withColumn("replacements", F.col("replacements") + F.col("_p.n")).drop("_p")
    return own.unionByName(docs.where("not whole or text is null"))


def mask(docs: DataFrame, detectors, tables: vault.Tables, allow=frozenset(), opts: Options | None = None) -> Masked:
    """Detect, number, rewrite, and let an operator's pass and the model see the rest if asked; ``docs`` as from ``read_documents``."""
    spark, opts = docs.sparkSession, opts or Options()
    found = written(with_spans(docs, detectors, "text", allow), "spans")
    # places inside a file count on over its pieces
    occ = occurrences(found, ["rel", "chunk", "file_ord"]).withColumn("s", F.col("chunk").cast("long") * (1 << 32) + F.col("s"))
    entries = written(aliases.assign(occ, tables.entries, tables.entities), "entries")
    met = aliases.sightings(occ, tables.sightings)
    notes, errors = [], []
    shaped = [r["rel"] for r in rewrite.alias_shaped(found).select("rel").distinct().orderBy("rel").limit(report.LISTED).collect()]
    notes += [f"{rel}: holds text in the form of an alias, which reversing may replace" for rel in shaped]
    out = written(rewrite.pseudonymise(found, entries), "masked")
    if opts.post_pass or opts.provider:
        notes += [f"{r['rel']}: read in pieces, seen by the detectors only" for r in out.where("chunk = 0 and not whole").select("rel").orderBy("rel").limit(report.LISTED).collect()]
    if opts.post_pass:
        out = written(post_passed(out, opts.post_pass), "post-pass")
    if opts.provider:
        flagged = written(flagging.flag(out.where("whole and text is not null"), opts.provider, opts.client), "flagged")
        more = flagging.occurrences(flagged)
        entries = written(aliases.assign(more, entries, tables.entities), "entries")
        met = aliases.sightings(more, written(met, "sightings"))
        out = written(flagging.replace_flagged(out, flagged, entries), "flagged-text")
        errors = [r["error"] for r in flagged.where("error is not null").select("error").orderBy("error").limit(report.LISTED).collect()]
    return Masked(out, vault.Tables(entries, tables.entities, written(met, "sightings")), notes, errors)


def file_stats(docs: DataFrame) -> DataFrame:
    """A row per file; texts stay behind."""
    return docs.groupBy("rel", "file_ord").agg(
        F.any_value("status").alias("status"), F.any_value("encoding").alias("encoding"), F.sum("replacements").alias("replacements"), F.any_value("size").alias("size"), F.any_value("source_sha256").alias("source_sha256")
    )


def verify(spark: SparkSession, dst: str, opts: Options) -> dict:
    """Search a masked tree again, entities' identifiers too if a table is given."""
    cfg = opts.resolve()
    detectors = registry.active(cfg.disable, cfg.enable, cfg.custom, cfg.denylist)
    with cleared(spark):
        return verify_tree(spark, dst, detectors, cfg)


def verify_tree(spark: SparkSession, dst: str, detectors, cfg: config.Settings) -> dict:
    """Whether a tree is clean, how many values are left, and the first of them by file and place."""
    files = filetree.list_files(spark, dst)
    docs = filetree.read_documents(files, threshold=cfg.stream_threshold, detectors=detectors, allow=cfg.allow)
    pieces = docs.where("not whole and text is not null").select("rel", "chunk", (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rel").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = pieces.select(F.col("rel").alias("r"), F.col("chunk").alias("c"), before.alias("lines_before"))
    found = audit.leaks(docs.where("whole"), detectors, cfg.allow)
    if not files.where(F.col("size") > cfg.stream_threshold).isEmpty():
        apart = docs.where("not whole").join(lines, (F.col("rel") == F.col("r")) & (F.col("chunk") == F.col("c")))
        found = found.unionByName(audit.leaks(apart, detectors, cfg.allow, "lines_before"))
    found = written(found, "leaks")
    rows = [r.asDict() for r in found.orderBy(F.split("file", "/"), "line", "start").select("file", "category", "line").limit(report.LISTED).collect()]
    strays = [r["file"] for r in audit.stray(files).orderBy("file").limit(report.LISTED).collect()]
    return {"clean": not rows and not strays, "leak_count": found.count(), "leaks": rows, "stray_sidecars": strays}


def _prepare(spark: SparkSession, src: str, opts: Options):
    source = Path(src).resolve()
    if not source.is_dir():
        raise ValueError(f"source not a directory: {source}")
    cfg = opts.resolve()
    if opts.provider:
        flagging.gate(opts.provider, lambda m: print(m, file=sys.stderr))
        flagging.load_key(opts.provider)
    return source, cfg


@contextmanager
def _key_kept(opts: Options) -> Iterator[None]:
    """A key that shall be forgotten is gone from the environment in any case."""
    try:
        yield
    finally:
        if opts.provider:
            flagging.forget_key(opts.provider)


def _masked_tree(spark: SparkSession, source: Path, cfg: config.Settings, tables: vault.Tables, table: str | None, opts: Options, meter: Meter) -> tuple[Masked, list]:
    """A source tree, listed, read and masked; and its detectors."""
    detectors = registry.active(cfg.disable, cfg.enable, cfg.custom, cfg.denylist) + bind_entities(spark, tables, table)
    files = written(filetree.list_files(spark, str(source), {SIDE}, cfg.include, cfg.exclude), "files")
    total = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    meter.expect(total["n"], total["size"])
    meter.tell("mask")
    docs = filetree.read_documents(files, cfg.max_bytes, cfg.stream_threshold, detectors, cfg.allow, seen=(meter.bytes, meter.files))
    return mask(docs, detectors, tables, cfg.allow, opts), detectors


def _warnings(stats: DataFrame) -> list[str]:
    rows = report.skipped(stats)
    return [filetree.skip_warning(r["file"], r["status"]) for r in rows]


def run_scan(spark: SparkSession, src: str, opts: Options | None = None) -> dict:
    """Detect and report; nothing masked is written and a vault is only read."""
    opts = opts or Options()
    with _key_kept(opts), cleared(spark), Meter(spark, opts.progress) as meter:
        source, cfg = _prepare(spark, src, opts)
        tables = vault.Vault(opts.project).load(spark) if opts.project else vault.empty(spark)
        table = opts.entities or (str(Path(opts.project) / "entities.csv") if opts.project else None)
        got, _ = _masked_tree(spark, source, cfg, tables, table, opts, meter)
        if got.model_errors and opts.provider.strict:
            raise ValueError(f"model pass: {got.model_errors[0]}")
        stats = written(file_stats(got.docs), "stats")
        data = report.summary("scan", str(source), None, now(), stats, got.tables.entries, got.tables.entities.count(), warnings=_warnings(stats) + got.notes + got.model_errors)
        side = source / SIDE
        custody.write_json(data, side / "scan_report.json")
        report.write_html(data, side / "scan_report.html")
        out = {"mode": "scan", "files_total": data["files_total"], "files_processed": data["files_processed"], "would_replace": data["total_replacements"], "report": str(side / "scan_report.html"), "summary": data}
        if opts.emit_entities:
            out["entities_starter"] = str(side / "entities_starter.csv")
            out["entities_rows"] = write_starter(got.tables.entries, side / "entities_starter.csv")
        return out


def write_starter(entries: DataFrame, path: Path) -> int:
    import csv

    n = 0
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["id", "type", "pretty_name", "identifiers", "notes"])
        w.writerow(["# give each entity an id and group its identifiers", "device", "Core Switch Alpha", "10.0.0.5;SRV-AB12", "example row"])
        for r in aliases.starter_rows(entries).toLocalIterator():
            w.writerow(["", "device", "", r["original"], ""])
            n += 1
    return n


def _manifest(stats: DataFrame, hashes: DataFrame, stamp: str, source: Path, target: Path, paths: list[Path]) -> dict:
    """Write the manifest to each of ``paths``, record by record; its head comes back."""
    records = written(custody.manifest_rows(stats, hashes, stamp), "records")
    digest = custody.run_digest(records).first()
    head = {"tool": "maskwright", "version": __version__, "timestamp": stamp, "source": str(source), "target": str(target), "file_count": digest["file_count"], "run_digest_sha256": digest["run_digest"]}
    for path in paths:
        custody.write_json(head | {"files": custody.rows_of(records.orderBy("file"))}, path)
    return head


def run_strip(spark: SparkSession, src: str, dst: str, opts: Options | None = None) -> dict:
    """Write the masked mirror, decode map or vault, reports and manifest; then verify."""
    opts = opts or Options()
    source, target = Path(src).resolve(), Path(dst).resolve()
    guard(source, target)
    root = Path(opts.project).resolve() if opts.project else None
    if root and (root.is_relative_to(source) or root.is_relative_to(target)):
        raise ValueError("the vault must not be inside the source or target tree")
    with _key_kept(opts):
        source, cfg = _prepare(spark, src, opts)
        with vault.Vault(str(root)) if root else nullcontext() as store, cleared(spark), Meter(spark, opts.progress) as meter:
            return _strip(spark, source, target, cfg, store, opts, meter)


def _strip(spark: SparkSession, source: Path, target: Path, cfg: config.Settings, store: vault.Vault | None, opts: Options, meter: Meter) -> dict:
    stamp, run, side = now(), uuid.uuid4().hex, source / SIDE
    tables = store.load(spark) if store else vault.empty(spark)
    target.mkdir(parents=True, exist_ok=True)
    got, detectors = _masked_tree(spark, source, cfg, tables, opts.entities or (str(store.root / "entities.csv") if store else None), opts, meter)
    meter.tell("write")
    hashes = written(filetree.write_mirror(got.docs, str(source), str(target)), "hashes")
    stats = written(file_stats(got.docs), "stats")
    places = [side, *([store.run_dir(stamp, run)] if store else [])]
    head = _manifest(stats, hashes, stamp, source, target, [p / "manifest.json" for p in places])
    meter.tell("verify")
    checked = verify_tree(spark, str(target), detectors, cfg)
    verdict = "PASS" if checked["clean"] else "FAIL"
    data = report.summary("strip", str(source), str(target), stamp, stats, got.tables.entries, got.tables.entities.count(), verdict, head["run_digest_sha256"], _warnings(stats) + got.notes + got.model_errors)
    for p in places:
        custody.write_json(data, p / "report.json")
    report.write_html(data, side / "report.html")
    if store:
        store.save(got.tables)
        where = str(store.export_json(spark))
        named = aliases.legend(got.tables.entries, got.tables.entities).orderBy("ord")
        custody.write_json({r.pop("label"): {k: v for k, v in r.items() if k != "ord"} for r in custody.rows_of(named)}, store.root / "legend.json", 0o600)
        custody.append_log(head, store.root / "manifest_log.jsonl")
        warn = lock_down(store.root)
    else:
        where = str(side / "decode.json")
        custody.write_json(vault.decode_pairs(got.tables), side / "decode.json", 0o600)
        warn = lock_down(side)
    out = {
        "mode": "strip", "files_processed": data["files_processed"], "files_copied_unprocessed": data["files_copied_unprocessed"], "replacements": data["total_replacements"], "entities": data["entities"],
        "decode_map": where, "report": str(side / "report.html"), "manifest": str(side / "manifest.json"), "run_digest": head["run_digest_sha256"], "verify": verdict, "verify_clean": checked["clean"], "verify_detail": checked, "summary": data,
    }
    if opts.emit_entities:
        out["entities_starter"] = str(side / "entities_starter.csv")
        out["entities_rows"] = write_starter(got.tables.entries, side / "entities_starter.csv")
    if warn:
        out["warning"] = warn
    if got.model_errors and opts.provider.strict:
        out["llm_strict_failed"] = got.model_errors[0]
    return out


def run_reverse(spark: SparkSession, source: str, target: str, map_path: str) -> int:
    """Put the originals back into one file, in its own encoding and line ends; the number restored."""
    p, out = Path(source).resolve(), Path(target).resolve()
    if not p.is_file():
        raise FileNotFoundError(f"not a file: {source}")
    entries = vault.load_aliases(spark, map_path)
    files = spark.createDataFrame([(p.name, str(p), p.stat().st_size, 0)], "rel string, path string, size long, file_ord long")
    with cleared(spark):
        docs = written(rewrite.reverse(filetree.read_documents(files), entries), "reversed")
        if docs.where("text is not null").isEmpty():
            raise ValueError(f"not a text file: {source}")
        # the mirror writer names its file after ``rel``
        filetree.write_mirror(docs.withColumn("rel", F.lit(out.name)), str(p.parent), str(out.parent)).count()
        return docs.agg(F.sum("replacements")).first()[0]


def run_reconcile(spark: SparkSession, source: str, target: str, map_path: str | None = None, project: str | None = None) -> dict:
    """Rewrite a masked tree to the aliases that are valid now, as a new tree with its own manifest."""
    src, dst = Path(source).resolve(), Path(target).resolve()
    if not src.is_dir():
        raise ValueError(f"input not a directory: {src}")
    guard(src, dst)
    if not map_path and not project:
        raise ValueError("reconcile needs a map or a project")
    if dst.exists() and (not dst.is_dir() or any(dst.iterdir())):
        raise ValueError(f"output is not an empty directory: {dst}")
    with vault.Vault(project) if not map_path else nullcontext() as store, cleared(spark):
        if store and not store.known():
            raise FileNotFoundError(f"no map in {project}")
        entries = store.load(spark).entries if store else vault.load_aliases(spark, map_path)
        closure = written(rewrite.canonical(entries), "closure")
        dst.mkdir(parents=True, exist_ok=True)
        stamp, run, side = now(), uuid.uuid4().hex, dst / SIDE
        docs = filetree.read_documents(filetree.list_files(spark, str(src), {SIDE}))
        docs = docs.withColumn("status", F.when(F.col("text").isNull(), "copied").otherwise("reconciled"))
        done = written(rewrite.reconcile(docs, closure), "reconciled")
        hashes = written(filetree.write_mirror(done, str(src), str(dst)), "hashes")
        stats = written(file_stats(done), "stats")
        places = [side, *([store.run_dir(stamp, run)] if store else [])]
        head = _manifest(stats, hashes, stamp, src, dst, [p / "manifest.json" for p in places])
        t, n = report.totals(stats).first(), closure.count()
        pairs = lambda: ((r["alias"], r["terminal"]) for r in custody.rows_of(closure.orderBy("alias")))
        data = {
            "mode": "reconcile", "tool": "maskwright", "version": __version__, "timestamp": stamp, "source": str(src), "target": str(dst), "files_total": t["files_total"], "files_processed": t["files_processed"],
            "files_copied_unprocessed": t["files_copied"], "total_replacements": t["replacements"], "aliases_reconciled": n, "run_digest_sha256": head["run_digest_sha256"], "warnings": [],
        }
        for p in places:
            custody.write_json(data | {"supersessions": pairs()}, p / "reconcile_report.json")
        custody.write_json(pairs(), side / "reconcile_map.json")
        if store:
            custody.append_log(head, store.root / "manifest_log.jsonl")
        return {
            "mode": "reconcile", "files_processed": data["files_processed"], "files_copied_unprocessed": data["files_copied_unprocessed"], "replacements": data["total_replacements"],
            "aliases_reconciled": n, "manifest": str(side / "manifest.json"), "reconcile_map": str(side / "reconcile_map.json"), "run_digest": head["run_digest_sha256"],
        }
