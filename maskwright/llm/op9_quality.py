"""Line-first cleaning: rules judge each line, failing lines go, and documents
that lose too much text are rejected.

Most rules look at a line alone: punctuation, navigation, symbols, shouting, stock
phrases of several languages. One looks at all documents and knows no language:
a short line that stands behind many different lines, one for at least
``FREQUENT_SHARE`` of the documents, is boilerplate. Copies of a document don't make
its lines frequent, as a line has the same line before it in all of them. Such lines
go, but count neither as text nor as text lost, and stay where hardly anything else
is. There are at most (lines a document) / ``FREQUENT_SHARE`` of them, whatever the size.

Defined cases: null and empty texts have no words and are rejected
(``base_failed``); repeated rows are judged alike, each giving its own row; an
empty table gives an empty result; a very long text is judged as a whole, a text at
a time; further columns are ignored, whatever their names, and the pipeline form
returns them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import sliced, spread

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
# Line-level boilerplate in English, German, French, Spanish, Italian, Portuguese and Dutch, matched without regard to case.
BOILERPLATE = re.compile(
    r"all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|tutti i diritti riservati|todos os direitos reservados|alle rechten voorbehouden"
    r"|cookie (?:policy|settings|consent)|we use cookies|cookie-(?:einstellungen|richtlinie)|wir verwenden cookies|cookies? (?:akzeptieren|ablehnen|accepteren)|(?:accepter|refuser|gérer) les cookies|(?:aceptar|rechazar) (?:las )?cookies|accetta i cookie|(?:aceitar|rejeitar) cookies"
    r"|privacy policy|terms of (?:use|service)|datenschutzerklärung|allgemeine geschäftsbedingungen|politique de confidentialité|mentions légales|política de privacidad|términos de uso|informativa sulla privacy|política de privacidade|privacybeleid"
    r"|enable javascript|javascript is (?:disabled|required)|javascript aktivieren|activer javascript|activar javascript|lorem ipsum"
    r"|click here|subscribe to our|sign up for|share (?:this|on) |hier klicken|newsletter abonnieren|jetzt anmelden|cliquez ici|abonnez-vous|partager sur|haga clic aquí|suscríbase|compartir en|clicca qui|iscriviti|clique aqui|klik hier",
    re.I,
)
# What ends or parts sentences, in several scripts.
STOPS = re.compile("[.!?…:;。！？；：।؟۔]")
#: Signs that part the links of a navigation line.
PARTED = re.compile(r"\s[|·•»›>/~–—-]\s|[|·•»›]")
MIN_WORDS, MAX_REPEAT_PCT, MAX_LOST, MAX_BOILER_WORDS, MOST_LINKS, LINK_WORDS = 10, 20, 0.5, 25, 12, 3
FREQUENT_SHARE, FREQUENT_LEAST = 0.002, 20

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines_removed long, lost_share double"
)


def line_fails(line: str) -> bool:
    """True for a line of symbols, shouting, navigation or boilerplate.

    A line without any letter or digit fails; so does one where every third
    word carries two or more symbols, where most words end in ``!!``, where
    bars part most words, whose parts between two or more separating signs are as short
    as links, a short one with a stock phrase, and a short one of three words or more
    without a sentence's punctuation anywhere. One or two words fail only if they are
    bare and short.
    """
    words = line.split()
    n = len(words)
    if not n:
        return False
    bars = line.count("|")
    if bars >= 3 and 3 * bars >= n:
        return True
    if 2 * line.count("!!") >= n and n >= 3:
        return True
    if 3 * sum(line.count(2 * s) for s in SYMBOLS) >= n and n >= 2:
        return True
    if n <= MAX_BOILER_WORDS and BOILERPLATE.search(line):
        return True
    if not any(map(str.isalnum, line)):
        return True
    parts = PARTED.split(line) if n <= MOST_LINKS * LINK_WORDS else ()
    if len(parts) > 2 and all(len(p.split()) <= LINK_WORDS for p in parts) and not STOPS.search(line):
        return True
    if n > 2:
        # a script without spaces or case has no words to count
        return n <= MAX_BOILER_WORDS and not STOPS.search(line) and any(c.islower() or c.isupper() for c in line)
    return line.rstrip()[-1] not in ".!?\"'”»)…:;," and len(line) < 12


def line_key(line: str) -> int:
    """What a line counts as: its words, one space between them."""
    return xxhash.xxh3_64_intdigest(" ".join(line.split()).encode("utf-8", "surrogatepass"))


def contexts(text: str | None) -> set[tuple[int, int]]:
    """(line, line before it) of the short lines of a text; a first line has 0 before it."""
    out, before = set(), 0
    for line in (text or "").split("\n"):
        n = len(line.split(None, MAX_BOILER_WORDS))
        if n:
            key = line_key(line)
            if n <= MAX_BOILER_WORDS:
                out.add((key, before))
            before = key
    return out


def frequent_lines(docs: DataFrame) -> frozenset[int]:
    """Keys of the short lines that stand behind many different lines; all documents count."""

    def run(batches):
        for b in sliced(batches):
            pairs: set = set()
            for t in b.column(0).to_pylist():
                pairs |= contexts(t)
            both = np.array(list(pairs), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["line", "before"])

    least = max(FREQUENT_LEAST, -int(-FREQUENT_SHARE * docs.count() // 1))
    pairs = docs.select("text").mapInArrow(run, "line long, before long").distinct()
    rows = pairs.groupBy("line").agg(F.count("*").alias("n")).where(f"n >= {least}").select("line").collect()  # bounded, see above
    return frozenset(r["line"] % 2**64 for r in rows)


def repeat_words(words: list, k: int = 5) -> int:
    """Words inside any ``k``-word window that occurs twice or more; exact ranks, no hashing."""
    n = len(words)
    if n <= k:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    rank, width = a, 1
    while width < k:
        step = min(width, k - width)
        left, right = rank[: n - width - step + 1], rank[step : n - width + 1]  # they overlap or touch
        _, rank = np.unique(left * (int(rank.max()) + 1) + right, return_inverse=True)
        width += step
    counts = np.bincount(rank)
    hit = np.flatnonzero(counts[rank] > 1)
    if not len(hit):
        return 0
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + k, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def judge(text: str | None, frequent: frozenset[int] = frozenset()) -> tuple:
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dups, kept, common, removed, lost, away, left = set(), 0, [], [], 0, 0, 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            if line in seen:
                dups += 1
            else:
                seen.add(line)
        if line_fails(line):
            removed += 1
            lost += len(line) - sum(map(line.count, SPACES))
            continue
        kept.append(line)
        shared = bool(frequent) and len(line.split(None, MAX_BOILER_WORDS)) <= MAX_BOILER_WORDS and line_key(line) in frequent
        common.append(shared)
        if shared:
            away += len(line) - sum(map(line.count, SPACES))
        elif left < MIN_WORDS:
            left += len(line.split(None, MIN_WORDS))
    if away and left >= MIN_WORDS:
        # what all share is no loss: it goes, and the rest is judged; a document of little else keeps it
        kept = [line for line, shared in zip(kept, common) if not shared]
        removed += sum(common)
    else:
        away = 0
    rep = repeat_words(words)
    base = n < MIN_WORDS or 100 * rep > MAX_REPEAT_PCT * n
    share = lost / (word_chars - away) if word_chars > away else 0.0
    return n, word_chars, symbols, dups, rep, base, not base and share <= MAX_LOST, removed, share, "\n".join(kept)


def quality(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """A verdict per row of ``docs``; with ``with_text`` also the cleaned text."""
    docs = spread(docs)
    frequent = frequent_lines(docs)

    def run(batches):
        for b in sliced(batches):
            ids = b.column(0)
            out = [judge(t, frequent) for t in b.column(1).to_pylist()]
            cols = list(zip(*out)) if out else [[]] * 10
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64(), pa.float64(), pa.string()]
            arrays = [ids.cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "lost_share", "clean_text"]
            keep = len(names) if with_text else len(names) - 1
            yield pa.RecordBatch.from_arrays(arrays[:keep], names[:keep])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA + ", clean_text string" * with_text)


def clean(docs: DataFrame) -> DataFrame:
    """Pipeline form: documents kept, without their failing lines, with the columns of ``docs``."""
    docs = spread(docs)
    frequent = frequent_lines(docs)
    names = [f.name for f in docs.schema.fields]
    schema = docs.schema
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def run(batches):
        for b in sliced(batches):
            out = [judge(t, frequent) for t in b.column(at).to_pylist()]
            mask = pa.array([x[6] for x in out], pa.bool_())
            cols = list(b.columns)
            cols[at] = pa.array([x[9] for x in out], pa.string())
            if chars >= 0:
                cols[chars] = pa.array([len(x[9]) for x in out], pa.int64()).cast(b.column(chars).type)
            yield pa.RecordBatch.from_arrays(cols, names).filter(mask)

    return docs.mapInArrow(run, schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
