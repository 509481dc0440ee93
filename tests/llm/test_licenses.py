"""Labels of licence notices, long and short."""

import pytest

from maskwright.llm import op4_licenses

SF = "/root/testdata/sf0.01"
FILL = " lorem ipsum dolor sit amet" * 5


@pytest.mark.parametrize("text, labels", [
    ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
    ("Released under the terms of the GNU General Public Licence v2 or later", "gpl"),
    ("distributed under version 2 of the GNU GPL", "gpl"),
    ("licensed under GPL-3.0-or-later", "gpl"),
    ("SPDX-License-Identifier: GPL-2.0-only", "gpl"),
    ("SPDX-License-Identifier: MIT", "mit"),
    ("Available under the MIT licence.", "mit"),
    ("licensed under the GNU Lesser General Public License, version 2.1", "lgpl"),
    ("released under the LGPLv3", "lgpl"),
    ("licensed under the Mozilla Public License, version 2.0", "mpl-2"),
    ("licensed under the Mozilla Public License, version 1.1", ""),
    ("licensed under the Apache License 2.0", "apache-2"),
    ("licensed under the 3-clause BSD license", "bsd"),
    ("under the ISC License", "isc"),
    ("under The Unlicense", "unlicense"),
    ("licensed under CC BY 4.0", "cc-by"),
    ("licensed under CC BY-NC 4.0", "cc-by-nc"),
    ("licensed under CC BY-ND 4.0", ""),
    ("licensed under the Creative Commons Attribution-ShareAlike 4.0 licence", "cc-by-sa"),
    ("licensed under either the MIT license or the GNU General Public License", "gpl,mit"),
    ("The GNU General Public License was written in 1989. A book on the GPL.", ""),
    ("under a tree he read the GNU General Public License", ""),
])
def test_short_notices(text, labels):
    index = op4_licenses.Index(10, {b"license": 5, b"the": 9, b"under": 8})
    for t in (text, FILL + "\n" + text + "\n" + FILL):
        got = index.scan(t)
        assert (got[5], got[6]) == (labels, 1.0 if labels else 0.0)


def test_the_lines_of_the_table(spark):
    lines = {"GNU General Public License, version 3": "gpl", "MIT License": "mit", "Apache License, Version 2.0": "apache-2", "CC BY-NC 4.0": "cc-by-nc"}
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r.labels for r in op4_licenses.op4_license_scan(spark, SF).collect()}
    want = {d: ",".join(sorted({label for line, label in lines.items() if line in t})) for d, t in texts.items()}
    assert got == want and any("gpl" in x for x in got.values())


def changed(words, rng, share):
    """``words`` with about ``share`` of them replaced, left out, or with another put before them."""
    out = []
    for w in words:
        kind = rng.random() / share if share else 9
        out += [] if kind < 1 / 3 else ["other"] if kind < 2 / 3 else ["more", w] if kind < 1 else [w]
    return out


@pytest.mark.parametrize("k", range(len(op4_licenses.TEMPLATES)))
def test_changed_passages(k):
    import random

    label, text, keys = op4_licenses.TEMPLATES[k]
    index, rng = op4_licenses.Index(1000, {w: 900 for w in (b"the", b"of", b"and", b"to", b"in", b"this", b"is", b"a")}), random.Random(k)
    for lead in (0, 1, 500):
        for share in (0, 0.12):
            words = text.split()
            if share:
                # what is no key phrase may change
                for key in keys:
                    words = " ".join(words).replace(key, key.replace(" ", "_")).split()
                words = [x for w in words for x in (w.split("_") if "_" in w else changed([w], rng, share))]
            got = index.scan(" ".join(["lorem"] * lead + words + ["ipsum"] * 50))
            assert label in got[5].split(",") and got[6] >= 0.8
    # without its first key phrase it is no licence of that name by the passage
    assert label not in index._passages(op4_licenses.words_of(text.replace(keys[0], "x")), set(op4_licenses.words_of(text)))


def test_a_changed_grant_and_long_texts():
    index = op4_licenses.Index(1000, {})
    grant = op4_licenses.TEMPLATES[1][1].replace("obtaining a", "who gets a")
    assert index.scan(grant)[5] == "mit" and index.scan("x " * 300_000 + grant + " y" * 300_000)[5] == "mit"
    assert index.scan("Licensed under the GNU General Public License version 3")[5] == "gpl" and index.scan("the software of this license is " * 2000)[5] == ""


def test_whole_table_against_every_place(spark):
    """Labels and scores of a whole table, with the templates tried at each place."""
    from maskwright.llm.op4_licenses import LEAST_SCORE, SHIFT, aligned, holds_in_order

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    texts = dict(docs) | {10_000 + k: f"Some words ahead. {t}. Words behind it." for k, (_, t, _) in enumerate(op4_licenses.TEMPLATES)}
    rows = op4_licenses.licenses(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    index = op4_licenses.Index(1, {})
    for r in rows:
        words = op4_licenses.words_of(texts[r.doc_id])
        best = {}
        if len(words) < 400:
            for label, t, keys in index.templates:
                for at in range(0, max(1, len(words) - len(t) // 2), SHIFT):
                    there = words[at : at + 3 * SHIFT + len(t)]
                    if holds_in_order(there, keys) and aligned(t, there) >= LEAST_SCORE:
                        best[label] = 1
            assert set(best) <= set(r.labels.split(",")), r.doc_id
        assert (r.score > 0) == (r.labels != "")
