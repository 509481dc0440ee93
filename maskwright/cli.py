"""Command line: scan, strip, verify, reverse, reconcile."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from pathlib import Path

from . import __version__
from .operators import flagging
from .sources.config import PROFILES
from .sources.vault import VaultLocked


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="maskwright", description="Reversible pseudonymisation of text trees on Spark.")
    p.add_argument("--version", action="version", version=f"maskwright {__version__}")
    p.add_argument("--selftest", action="store_true", help="mask, reverse and verify a small tree")
    sub = p.add_subparsers(dest="cmd")
    common = argparse.ArgumentParser(add_help=False)
    for name in ("config", "project", "entities"):
        common.add_argument(f"--{name}")
    common.add_argument("--profile", choices=sorted(PROFILES))
    for name in ("enable", "disable", "include", "exclude"):
        common.add_argument(f"--{name}", action="append")
    for name in ("max-bytes", "stream-threshold"):
        common.add_argument(f"--{name}", type=int)
    common.add_argument("--no-progress", action="store_true", help="no bar on the terminal")
    common.add_argument("--llm", action="store_true", help="let a model flag what is left in the masked text")
    common.add_argument("--llm-provider", choices=sorted(flagging.ENDPOINTS))
    for name in ("llm-endpoint", "llm-model", "llm-key-env"):
        common.add_argument(f"--{name}")
    for name in ("allow-cloud", "forget-key", "llm-strict"):
        common.add_argument(f"--{name}", action="store_true")
    for name, places in (("scan", ("source",)), ("strip", ("source", "target")), ("verify", ("target",))):
        s = sub.add_parser(name, parents=[common])
        for x in places:
            s.add_argument(x)
        if name != "verify":
            s.add_argument("--emit-entities", action="store_true")
    for name in ("reverse", "reconcile"):
        s = sub.add_parser(name)
        s.add_argument("input")
        s.add_argument("output")
        s.add_argument("--map", required=name == "reverse")
        if name == "reconcile":
            s.add_argument("--project")
    return p


def options(a: argparse.Namespace):
    from .plans import progress
    from .plans.api import Options

    o = Options(**{k: getattr(a, k) for k in ("config", "profile", "project", "entities", "enable", "disable", "include", "exclude", "max_bytes", "stream_threshold")}, emit_entities=getattr(a, "emit_entities", False), progress=None if a.no_progress else progress.bar())
    if a.llm:
        d = o.resolve().llm
        o.provider = flagging.Provider(
            a.llm_provider or d.get("provider", "ollama"), a.llm_endpoint or d.get("endpoint", ""), a.llm_model or d.get("model", ""),
            a.llm_key_env or d.get("key_env", flagging.Provider.key_env), a.allow_cloud, a.llm_strict, a.forget_key,
        )
    return o


def session():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.appName("maskwright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def selftest(spark) -> int:
    from .plans import api

    with tempfile.TemporaryDirectory() as d:
        src, dst = Path(d, "in"), Path(d, "out")
        src.mkdir()
        text = "user jane@example.com from 10.0.0.5\nagain 10.0.0.5\n"
        (src / "a.log").write_text(text)
        out = api.run_strip(spark, str(src), str(dst))
        api.run_reverse(spark, str(dst / "a.log"), str(Path(d, "back.log")), out["decode_map"])
        ok = out["verify_clean"] and (dst / "a.log").read_text().count("<IP_1>") == 2 and Path(d, "back.log").read_text() == text
    print("selftest", "PASS" if ok else "FAIL")
    return 0 if ok else 1


def main(argv: list[str] | None = None, spark=None) -> int:
    """Exit codes: 0 done, 1 error, 2 no command, 3 vault locked, 10 values left, 11 model pass failed in strict mode."""
    p = parser()
    a = p.parse_args(argv)
    if not a.selftest and not a.cmd:
        p.print_help()
        return 2
    from .plans import api

    try:
        spark = spark or session()
        if a.selftest:
            return selftest(spark)
        if a.cmd == "scan":
            out = api.run_scan(spark, a.source, options(a))
        elif a.cmd == "strip":
            out = api.run_strip(spark, a.source, a.target, options(a))
        elif a.cmd == "verify":
            if not Path(a.target).is_dir():
                raise ValueError(f"target not a directory: {a.target}")
            out = api.verify(spark, a.target, options(a))
            print(json.dumps({"clean": out["clean"], "leak_count": out["leak_count"], "leaks": out["leaks"][:50], "stray_sidecars": out["stray_sidecars"]}, indent=2))
            return 0 if out["clean"] else 10
        elif a.cmd == "reverse":
            out = {"restored": api.run_reverse(spark, a.input, a.output, a.map), "output": a.output}
        else:
            out = api.run_reconcile(spark, a.input, a.output, a.map, a.project)
        print(json.dumps({k: v for k, v in out.items() if k not in ("summary", "verify_detail", "verify_clean")}, indent=2))
        if not out.get("verify_clean", True):
            print(json.dumps({"verify_failed": out["verify_detail"]}, indent=2), file=sys.stderr)
            return 10
        return 11 if out.get("llm_strict_failed") else 0
    except VaultLocked as e:
        print(f"error: {e}", file=sys.stderr)
        return 3
    except (FileNotFoundError, ValueError, KeyError, flagging.FlaggingError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
