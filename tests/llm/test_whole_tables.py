"""The registered queries over whole tables, against brute force."""

import collections

import pytest

from maskwright.llm.queries import QUERIES

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def result(spark, n):
    name = next(k for k in QUERIES if k.startswith(f"op{n}_"))
    return QUERIES[name](spark, SF).collect()


def test_op3(spark, docs):
    got, want = {r.doc_id: r.class_id for r in result(spark, 3)}, brute.classes(docs)
    assert got == want


def test_op4(spark, docs):
    want = {d: brute.licenses(t) for d, t in docs}
    for r in result(spark, 4):
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want[r.doc_id]
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_op5(spark, docs):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = dict(docs)
    for r in result(spark, 5):
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == brute.sha(t.decode(ids, skip_special_tokens=False))


def test_op6(spark, docs):
    want = {d: brute.secrets(t) for d, t in docs}
    for r in result(spark, 6):
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == want[r.doc_id]


def test_op7(spark, docs):
    rows = result(spark, 7)
    want = {d: brute.size_and_crc(t) for d, t in docs}
    assert len(rows) == len(docs) and all((r.size, r.text_crc32) == want[r.doc_id] for r in rows)
    counts = collections.Counter(r.shard for r in rows)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))


def test_op8(spark, docs):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = dict(zip([d for d, _ in docs], brute.contamination([t for _, t in docs], items)))
    rows = result(spark, 8)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want[r.doc_id]


def test_op9(spark, docs):
    want = {d: brute.quality(t) for d, t in docs}
    for r in result(spark, 9):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_op10(spark, docs):
    got = {r.doc_id: (r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in result(spark, 10)}
    assert got == {x[0]: x for x in brute.substrings(docs)}


def test_op2(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import hashlib

    first = {}
    for p in sorted(pages):
        first.setdefault(pages[p], p)
    rows = result(spark, 2)
    assert len(rows) == len(pages)
    for r in rows:
        b = pages[r.page_id]
        again = len(b) >= 100 and first[b] != r.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None)


def test_op1(spark):
    import html
    import re

    for r in result(spark, 1):
        page = spark.read.parquet(f"{SF}/pages.parquet").where(f"page_id = {r.page_id}").first() if r.page_id % 50 == 0 else None
        assert r.n_chars == len(r.text)
        if page:
            body = re.search(r"<article>(.*?)(?:</article>|$)", page.html, re.S)[1]
            want = [" ".join(html.unescape(re.sub(r"<[^>]*>?", " ", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", body)]
            assert r.text.split("\n") == [x for x in want if x]
