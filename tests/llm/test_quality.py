"""Line rules, frequent lines, and the whole verdict against brute force."""

import pytest

from maskwright.llm import op9_quality

from . import brute


@pytest.mark.parametrize("line, fails", [
    ("Home | About | Contact", True), ("Start · Produkte · Über uns · Kontakt", True), ("Startseite Impressum Kontakt Datenschutz", True), ("Alle Rechte vorbehalten.", True), ("Accepter les cookies", True),
    ("a sentence that has no end at all and goes on", True), ("A sentence ends here.", False), ("One ends. pathetic 19.37.233.111", False), ("Price: 5 | 7, as of May.", False), ("***", True), ("ok", True), ("Kapitel eins", False),
    ("\u6c49\u5b57 \u6ca1\u6709 \u53e5\u53f7", False), ("", False), ("   ", False), ("BUY!! NOW!! IT!!", True), ("a | b | c | d", True), ("x$$$ y%%% z", True),
])
def test_lines(line, fails):
    assert op9_quality.line_fails(line) is fails


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_kept(spark, sf):
    sf = f"/root/testdata/{sf}"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    known = brute.frequent([t for _, t in docs])
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.kept, r.clean_text) for r in op9_quality.quality(rows, with_text=True).collect()}
    want = {d: brute.verdict(t, known, op9_quality.line_fails) for d, t in docs}
    assert {d: k for d, (k, _) in got.items()} == {d: k for d, (k, _) in want.items()}
    assert all(got[d][1] == "\n".join(lines) for d, (_, lines) in want.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good, bad = [d for d in labels if labels[d] == 1], [d for d in labels if labels[d] == 0]
    # short and repetitive ones fail the base rules
    assert sum(got[d][0] for d in good) >= 0.95 * len(good) and sum(got[d][0] for d in bad) <= 0.1 * len(bad)


def test_frequent_lines(spark):
    shared, copied = "Read our other stories today.", "Only copies hold this line."
    texts = [f"This is the opening line number {i}, of some length.\n{shared}\nAnd here it ends, {i} words on from there." for i in range(30)]
    texts += [f"One opening line for all, which is the same.\n{copied}\nIts end differs: {i}."  for i in range(30)] + [shared, None]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in op9_quality.quality(spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    assert all(shared not in got[i].clean_text and got[i].kept and got[i].lost_share == 0 for i in range(30))
    assert all(copied in got[i].clean_text for i in range(30, 60)) and got[60].clean_text == shared and not got[61].kept
