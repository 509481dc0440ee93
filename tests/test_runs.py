"""Whole runs over small trees: masking, vault, entities, reversal, reconciliation, exit codes."""

import json
import os

import pytest

from maskwright.cli import main
from maskwright.functions.finder import Finder
from maskwright.operators import flagging, scratch
from maskwright.plans import api, progress
from maskwright.sources import config, filetree
from maskwright.sources.vault import Vault, VaultLocked


def tree(root, files):
    for rel, data in files.items():
        p = root / rel
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(root)


def test_mirror(spark, tmp_path):
    files = {
        "a.log": "user jane@example.com from 10.0.0.5\r\nagain 10.0.0.5\r\n", "b/_under.log": "10.0.0.5 and 10.0.0.6", ".hidden.log": "10.0.0.7", "u16.txt": "ip 10.0.0.8 é".encode("utf-16"),
        "w.txt": b"caf\xe9 10.0.0.9", "x.png": b"10.0.0.5", "n.bin2": b"a\0b 10.0.0.5", "bad.txt": b"10.0.0.5 \x81", "bom.txt": "bom 10.0.0.5".encode("utf-8-sig"),
    }
    src = tree(tmp_path / "in", files)
    out = api.run_strip(spark, src, str(tmp_path / "out"))
    get = lambda rel: (tmp_path / "out" / rel).read_bytes()
    # numbering follows the order of files, part by part
    assert get(".hidden.log") == b"<IP_1>" and get("a.log") == b"user <EMAIL_1> from <IP_2>\r\nagain <IP_2>\r\n" and get("b/_under.log") == b"<IP_2> and <IP_3>"
    assert get("u16.txt").decode("utf-16") == "ip <IP_4> é" and get("w.txt") == b"caf\xe9 <IP_5>" and get("bom.txt") == "bom <IP_2>".encode("utf-8-sig")
    for same in ("x.png", "n.bin2", "bad.txt"):
        assert get(same) == files[same]
    assert out["verify"] == "PASS" and out["files_processed"] == 6 and out["files_copied_unprocessed"] == 3
    manifest = json.loads((tmp_path / "in/_pii/manifest.json").read_text())
    assert [f["file"] for f in manifest["files"]] == sorted(files) and manifest["run_digest_sha256"] == out["run_digest"]
    for name in ("report.json", "report.html", "manifest.json"):
        assert "10.0.0" not in (tmp_path / "in/_pii" / name).read_text() and "jane" not in (tmp_path / "in/_pii" / name).read_text()
    assert main(["reverse", str(tmp_path / "out/a.log"), str(tmp_path / "back.log"), "--map", out["decode_map"]], spark) == 0
    assert (tmp_path / "back.log").read_bytes() == files["a.log"].encode()
    (tmp_path / "out/leak.log").write_text("ok\noops raw 192.168.1.50 here")
    assert main(["verify", str(tmp_path / "out")], spark) == 10


LOG = "".join(f"row {i}: user u{i % 50}@example.com from 10.0.{i % 256}.{i * 7 % 256} mac de:ad:be:ef:{i % 256:02x}:11\n" for i in range(800))


def in_parts(text, n=777):
    return (text[i : i + n] for i in range(0, len(text), n))


def test_pieces_hold_whole_values():
    search = Finder(api.registry.active())
    whole = [x.value for x in search.spans(LOG)]
    for text in (LOG, LOG.replace("\n", " "), "é" + LOG):
        got = list(filetree.pieces(in_parts(text), search, chunk=5000, margin=500))
        assert len(got) > 5 and "".join(got) == text and max(map(len, got)) <= 5500
        assert [x.value for p in got for x in search.spans(p)] == whole
    # without any place to cut, a value that lies across is taken whole
    dense = ("10.0.0.1https://a.corp/" + "x" * 40) * 50
    assert "".join(filetree.pieces(in_parts(dense), search, chunk=100, margin=60)) == dense


@pytest.mark.parametrize("raw, want", [
    (b"", ("processed", "utf-8")), ("é".encode() * 5000, ("processed", "utf-8")), (b"a" * 5000 + b"\xe9", ("processed", "cp1252")), (b"a" * 5000 + b"\x81", ("undecodable", None)),
    (b"a\0b", ("binary", None)), (b"a" * 5000 + b"\0", ("processed", "utf-8")), ("x".encode("utf-16"), ("processed", "utf-16")), ("x".encode("utf-32"), ("processed", "utf-32")),
    ("x".encode("utf-8-sig"), ("processed", "utf-8-sig")), (b"\xef\xbb\xbf\xff", ("undecodable", None)), ("x".encode("utf-16") + b"y", ("undecodable", None)), ("é".encode()[:1], ("processed", "cp1252")),
])
@pytest.mark.parametrize("n", [4999, 1 << 20])
def test_survey(raw, want, n):
    import hashlib

    assert filetree.survey(raw[i : i + n] for i in range(0, len(raw), n)) == (*want, hashlib.sha256(raw).hexdigest())


def test_huge_files(spark, tmp_path):
    """Pieces give what the whole gives; a file that is no text to the end is copied through whole."""
    files = {"x.log": LOG, "late.log": LOG.encode() + b"\x81", "w.log": LOG.encode() + b"caf\xe9", "u.log": LOG.encode("utf-16"), "d/small.log": "10.0.0.5"}
    a = api.run_strip(spark, tree(tmp_path / "a", files), str(tmp_path / "ao"))
    old = filetree.read_documents
    filetree.read_documents = lambda *p, **k: old(*p, **k, chunk=5000)
    try:
        b = api.run_strip(spark, tree(tmp_path / "b", files), str(tmp_path / "bo"), api.Options(stream_threshold=1000, post_pass=lambda rel, text: (text + "!", 1)))
        (tmp_path / "bo/x.log").write_text((tmp_path / "bo/x.log").read_text() + "raw 192.168.1.50\n")
        checked = api.verify(spark, str(tmp_path / "bo"), api.Options(stream_threshold=1000))
    finally:
        filetree.read_documents = old
    for name in ("x.log", "w.log", "u.log", "late.log"):
        want = (tmp_path / "ao" / name).read_bytes()
        assert (tmp_path / "bo" / name).read_bytes() == want + b"raw 192.168.1.50\n" * (name == "x.log")
    assert (tmp_path / "bo/late.log").read_bytes() == files["late.log"] and (tmp_path / "bo/d/small.log").read_bytes().endswith(b"<IP_769>!") is False
    assert (tmp_path / "bo/d/small.log").read_text().endswith("!") and a["replacements"] + 1 == b["replacements"] and b["verify"] == "PASS"
    assert any("in pieces" in w for w in b["summary"]["warnings"]) and any("undecodable" in w for w in b["summary"]["warnings"])
    assert checked["leak_count"] == 1 and checked["leaks"] == [{"file": "x.log", "category": "ipv4", "line": 801}]


def test_a_huge_file_is_never_whole_in_memory(tmp_path):
    import resource
    import subprocess
    import sys

    path = tmp_path / "big.log"
    with open(path, "w") as f:
        for _ in range(60):
            f.write(LOG * 20)
    code = f"""
import resource
from maskwright.functions import finder, registry
from maskwright.sources import filetree
search = finder.Finder(registry.active())
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
status, encoding, _ = filetree.survey(filetree.blocks({str(path)!r}))
n = sum(len(p) for p in filetree.pieces(filetree.decoded({str(path)!r}, encoding), search))
print(status, n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    status, n, more = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=filetree.__file__.rpartition("/maskwright/")[0]).stdout.split()
    assert status == "processed" and int(n) == path.stat().st_size > 60 << 20 and int(more) < 60 << 10


def test_runs_leave_no_scratch(spark, tmp_path):
    from maskwright.operators.scratch import shared_dir

    here = lambda: set(os.listdir(shared_dir(spark).removeprefix("file://")))
    src = tree(tmp_path / "in", {"a.log": "10.0.0.5"})
    before = here()
    out = api.run_strip(spark, src, str(tmp_path / "out"))
    api.run_scan(spark, src)
    api.run_reverse(spark, str(tmp_path / "out/a.log"), str(tmp_path / "back.log"), out["decode_map"])
    api.run_reconcile(spark, str(tmp_path / "out"), str(tmp_path / "out2"), out["decode_map"])
    assert api.verify(spark, str(tmp_path / "out"), api.Options())["clean"] and here() == before


def test_progress(spark, tmp_path):
    import io

    seen = []
    src = tree(tmp_path / "in", {"a.log": "10.0.0.5", "b/c.log": "10.0.0.6" * 100})
    api.run_scan(spark, src, api.Options(progress=seen.append))
    assert [e.bytes_done for e in seen] == sorted(e.bytes_done for e in seen)
    assert (seen[-1].stage, seen[-1].files_done, seen[-1].bytes_done, seen[-1].bytes_total) == ("done", 2, 808, 808)
    assert progress.bar(io.StringIO()) is None and [progress.size_text(n) for n in (0, 1023, 1536, 5 << 30)] == ["0 B", "1023 B", "1.5 KiB", "5.0 GiB"]

    class Terminal(io.StringIO):
        def isatty(self):
            return True

    out = Terminal()
    progress.bar(out)(seen[-1])
    assert "2 of 2 files" in out.getvalue() and out.getvalue().endswith("\n")


def test_vault_entities_reconcile(spark, tmp_path):
    src, v = tree(tmp_path / "in", {"a.log": "from 10.0.0.5 to 10.0.0.6"}), tmp_path / "vault"
    assert main(["strip", src, str(tmp_path / "o1"), "--project", str(v)], spark) == 0
    (v / "entities.csv").write_text("id,type,pretty_name,identifiers,notes\ncore,device,Core,10.0.0.5; SRV-1,\n,device,x,1.1.1.1,\n")
    tree(tmp_path / "in2", {"b.log": "srv-1 is 10.0.0.5, 10.0.0.7 and 10.0.0.6 too"})
    assert main(["strip", str(tmp_path / "in2"), str(tmp_path / "o2"), "--project", str(v)], spark) == 0
    assert (tmp_path / "o2/b.log").read_text() == "<DEV0001.HOST_1> is <DEV0001.IP_1>, <IP_3> and <IP_2> too"
    legend = json.loads((v / "legend.json").read_text())
    assert legend["DEV0001"]["superseded_aliases"] == ["<IP_1>"] and json.loads((v / "map.json").read_text())["counters"]["IP"] == 3
    assert main(["reconcile", str(tmp_path / "o1"), str(tmp_path / "o3"), "--project", str(v)], spark) == 0
    assert (tmp_path / "o3/a.log").read_text() == "from <DEV0001.IP_1> to <IP_2>" and (tmp_path / "o1/a.log").read_text() == "from <IP_1> to <IP_2>"
    assert main(["reconcile", str(tmp_path / "o1"), str(tmp_path / "o3"), "--project", str(v)], spark) == 1
    assert len((v / "manifest_log.jsonl").read_text().splitlines()) == 3
    with Vault(str(v)):
        with pytest.raises(VaultLocked), Vault(str(v)):
            pass
        assert main(["strip", src, str(tmp_path / "o4"), "--project", str(v)], spark) == 3


def test_guards_and_config(spark, tmp_path):
    src = tree(tmp_path / "in", {"a.log": "10.0.0.5", "b.txt": "10.0.0.6"})
    assert main(["strip", src, src], spark) == 1 and main(["strip", src, src + "/x"], spark) == 1 and main(["scan", src + "no"], spark) == 1 and main([], spark) == 2
    toml = tmp_path / "c.toml"
    toml.write_text('include = ["*.log"]\nallowlist = ["10.0.0.5"]\n[detectors]\ndisable = ["mac"]\n[[custom]]\nname = "n"\ntype = "literal"\nvalue = "x"\n')
    cfg = config.resolve("syslog", str(toml), include=["*.csv"])
    assert cfg.include == ["*.log", "*.txt", "*.csv"] and cfg.allow == {"10.0.0.5"} and cfg.disable == {"mac"} and cfg.custom[0]["type"] == "literal"
    for bad in ({"custom": [{"name": "x"}]}, {"custom": [{"name": "x", "value": "("}]}, {"custom": [{"name": "x", "value": "y", "type": "z"}]}, {"max_bytes": 0}):
        with pytest.raises(ValueError):
            config.resolve(**bad)
    with pytest.raises(ValueError, match="rule 1.*rule 2.*rule 2"):
        config.resolve(custom=[{"name": "a"}, {"value": "(", "type": "regex"}])
    with pytest.raises(KeyError):
        config.resolve("nope")
    out = api.run_scan(spark, src, api.Options(config=str(toml), emit_entities=True))
    assert out["files_total"] == 1 and out["would_replace"] == 0 and out["entities_rows"] == 0
    out = api.run_scan(spark, src, api.Options(emit_entities=True))
    assert out["files_total"] == 2 and out["would_replace"] == 2 and out["entities_rows"] == 2
    assert "10.0.0.6" in (tmp_path / "in/_pii/entities_starter.csv").read_text()
    assert not (tmp_path / "out").exists()


def test_model_pass(spark, tmp_path):
    src = tree(tmp_path / "in", {"a.log": "Jane Roe at 10.0.0.5, Jane Roe"})
    opts = api.Options(provider=flagging.Provider(), client=lambda *_: {"message": {"content": "Jane Roe\nIP_1\nzz zz"}})
    api.run_strip(spark, src, str(tmp_path / "out"), opts)
    assert (tmp_path / "out/a.log").read_text() == "<LLM_1> at <IP_1>, <LLM_1>"

    def broken(*_):
        raise flagging.FlaggingError("down")

    got = api.run_strip(spark, src, str(tmp_path / "out2"), api.Options(provider=flagging.Provider(strict=True), client=broken))
    assert "down" in got["llm_strict_failed"] and (tmp_path / "out2/a.log").read_text() == "Jane Roe at <IP_1>, Jane Roe"


@pytest.mark.parametrize("n", [0, 1, 3000])
def test_model_pass_of_a_cluster_holds_few_documents(spark, monkeypatch, n):
    docs = spark.range(n).selectExpr("'f' || id rel", "id file_ord", "case id % 3 when 0 then 'no' when 1 then 'met Jane Roe' else 'é' end text")

    def client(url, headers, body, timeout):
        if body["messages"][1]["content"].endswith("é"):
            raise flagging.FlaggingError("down")
        return {"message": {"content": "Jane Roe"}}

    want = sorted(tuple(r) for r in flagging.flag(docs, flagging.Provider(), client).collect())
    scratch.shared_dir(spark)
    made, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: made.append(len(data)) or make(self, data, *a, **b))
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(flagging, "PASS_BYTES", 20_000, raising=False)
    assert sorted(tuple(r) for r in flagging.flag(docs, flagging.Provider(), client).collect()) == want and len(want) == n
    assert sum(made) == n and max(made) <= 200


def test_many_replacements_of_the_model_pass_are_not_broadcast(spark, monkeypatch):
    docs = scratch.written(spark.range(500).selectExpr("'f' || id rel", "id file_ord", "'met Jane Roe ' || id text", "0L replacements"), "docs")
    flagged = scratch.written(docs.where("file_ord % 5 > 0").selectExpr("rel", "file_ord", "array('Jane Roe') fragments", "cast(null as string) error"), "flagged")
    entries = scratch.written(spark.createDataFrame([("Jane Roe", "<LLM_1>", "llm")], "original string, alias string, category string"), "entries")
    want = {(f"f{i}", f"met {'<LLM_1>' if i % 5 else 'Jane Roe'} {i}", int(i % 5 > 0)) for i in range(500)}
    for most, kind in ((32 << 20, True), (60_000, False)):  # Parquet has few bytes for them, the driver would have 200 for each
        monkeypatch.setattr(flagging, "MAP_BYTES", most)
        out = flagging.replace_flagged(docs, flagged, entries)
        assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) is kind
        assert {tuple(r) for r in out.select("rel", "text", "replacements").collect()} == want and out.count() == 500


def test_foreign_aliases_and_selftest(spark, tmp_path, capsys):
    src = tree(tmp_path / "in", {"a.log": "<IP_1> was 10.0.0.5"})
    out = api.run_strip(spark, src, str(tmp_path / "out"))
    assert any("form of an alias" in w for w in out["summary"]["warnings"])
    with pytest.raises(ValueError, match="post-pass"):
        raise ValueError("post-pass") if api.run_scan(spark, src, api.Options(post_pass=lambda rel, text: (text, 5)))["would_replace"] == 6 else AssertionError
    assert main(["--selftest"], spark) == 0 and "PASS" in capsys.readouterr().out
    assert main(["verify", str(tmp_path / "none")], spark) == 1


def test_model_gate(monkeypatch):
    for url, ok in (("http://localhost:1", True), ("http://127.0.0.2", True), ("http://[::1]:8", True), ("http://[::ffff:127.0.0.1]", False), ("http://example.com", False)):
        assert flagging.is_local(url) is ok
    with pytest.raises(flagging.FlaggingError):
        flagging.gate(flagging.Provider("anthropic"))
    with pytest.raises(flagging.FlaggingError):
        flagging.check_endpoint("localhost:11434")
    cfg = flagging.Provider("openai", allow_cloud=True, key_env="K_TEST", forget_key=True)
    monkeypatch.setenv("K_TEST", "s")
    assert flagging.load_key(flagging.Provider("openai", key_env="K_TEST")) is None and flagging.load_key(flagging.Provider(key_env="K_TEST")) is None
    assert all(flagging.Provider(p).model and flagging.request(flagging.Provider(p), None, "t")[2]["model"] for p in flagging.ENDPOINTS)
    cfg = flagging.Provider("openai", "https://api.example.com", allow_cloud=True, key_env="K_TEST", forget_key=True)
    assert flagging.load_key(cfg) == "s" and flagging.request(cfg, "s", "t")[1] == {"Authorization": "Bearer s"}
    flagging.forget_key(cfg)
    with pytest.raises(flagging.FlaggingError):
        flagging.load_key(cfg)
    assert flagging.answer_of("anthropic", {"content": [{"type": "text", "text": "a"}, {"type": "x"}]}) == "a"
    assert flagging.answer_of("ollama", {"response": "a"}) == "a" and flagging.answer_of("ollama", {"message": {}}) == "" and flagging.answer_of("openai", {"choices": [{"message": {"content": None}}]}) == ""
    for wrong in (("openai", {}), ("openai", {"choices": []}), ("ollama", []), ("ollama", {"response": 1})):
        with pytest.raises(flagging.FlaggingError):
            flagging.answer_of(*wrong)
    assert flagging.places("AXAXA <XAX_1> XAX", "XAX") == [1, 14]
    assert flagging.places("a <IP_1> IP_1", "IP_1") == [9] and flagging.chosen("ab abc", ["ab", "abc", "..."]) == ["abc"]
