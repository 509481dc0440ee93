"""Plain one-machine versions of the corpus operators' contracts."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def folded(t):
    return WORD.findall((t or "").translate(LOW))


def plain(t):
    return PLAIN.findall(t or "")


def licenses(text):
    w = folded(text)
    at, labels = [], set()
    for p, label in {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def secrets(text):
    text, spans, counts = text or "", [], []
    rules = [
        (r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ]
    for k, (p, ok) in enumerate(rules):
        found = [(m.start(), k, m.end()) for m in re.finditer(p, text) if ok(m)]
        counts.append(len(found))
        spans += found
    return *counts, sha(",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans)))


def contamination(texts, items, n=10):
    grams = defaultdict(set)
    for item, t in items:
        w = folded(t)
        if w and item is not None:
            for i in range(max(len(w) - n, 0) + 1):
                grams[tuple(w[i : i + n])].add(str(item))
    lens = {len(g) for g in grams}
    for t in texts:
        w, hit, found = folded(t), set(), set()
        for k in lens:
            for i in range(len(w) - k + 1):
                g = grams.get(tuple(w[i : i + k]))
                if g:
                    hit.update(range(i, i + k))
                    found |= g
        yield len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)


def quality(text):
    text = text or ""
    w = plain(text)
    seen, dups = set(), 0
    for line in text.split("\n"):
        if plain(line):
            dups += line in seen
            seen.add(line)
    c = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    rep = {j for i in range(len(w) - 4) if c[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(rep), len(w) < 10 or 100 * len(rep) > 20 * len(w)


def frequent(texts):
    """Lines of up to 25 words that stand behind 20 other lines or more, and behind as many as 0.2 % of the documents."""
    behind = defaultdict(set)
    for t in texts:
        before = None
        for line in (t or "").split("\n"):
            key = " ".join(line.split())
            if key:
                behind[key].add(before)
                before = key
    return {k for k, b in behind.items() if len(b) >= 20 and 1000 * len(b) >= 2 * len(texts) and len(k.split()) <= 25}


def verdict(text, known, fails):
    """(kept, lines left) by the rules' words: ``fails`` judges a line alone, ``known`` are the frequent lines."""
    lines = (text or "").split("\n")
    size = lambda some: sum(len("".join(plain(x))) for x in some)
    good = [x for x in lines if not fails(x)]
    own = [x for x in good if " ".join(x.split()) not in known]
    if sum(len(x.split()) for x in own) < 10:
        own, away = good, 0
    else:
        away = size(good) - size(own)
    whole = size(lines) - away
    return not quality(text)[5] and size([x for x in lines if fails(x)]) <= 0.5 * whole, own


def substrings(rows, n=50):
    least: dict = {}
    for doc, t in rows:
        w = plain(t)
        if doc is not None:
            for i in range(len(w) - n + 1):
                g = hash(tuple(w[i : i + n]))
                least[g] = min(doc, least.get(g, doc))
    for doc, t in rows:
        w = plain(t)
        gone = set()
        if doc is not None:
            for i in range(len(w) - n + 1):
                if least[hash(tuple(w[i : i + n]))] < doc:
                    gone.update(range(i, i + n))
        yield doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


def bag(text, k=5):
    w = plain(text)
    k = min(k, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def classes(rows, least=0.8):
    """doc_id -> smallest doc_id linked to it by chains of similar texts."""
    texts = defaultdict(list)
    for doc, t in rows:
        texts[t or ""].append(doc)
    keys = list(texts)
    bags, where, parent = [bag(t) for t in keys], defaultdict(list), list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, b in enumerate(bags):
        near = Counter()
        for g, c in b.items():
            for j in where[g]:
                near[j] += min(c, bags[j][g])
            where[g].append(i)
        for j, same in near.items():
            if same >= least * (b.total() + bags[j].total() - same):
                parent[root(i)] = root(j)
    low: dict = {}
    for i, t in enumerate(keys):
        low[root(i)] = min([x for x in texts[t] if x is not None] + [low.get(root(i), 1 << 62)])
    return {doc: low[root(i)] for i, t in enumerate(keys) for doc in texts[t]}


def size_and_crc(text):
    b = (text or "").encode()
    return (len(b) if text is not None else 0) + 1, zlib.crc32(b)
