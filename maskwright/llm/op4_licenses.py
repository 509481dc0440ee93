"""Licence scan through a positional index of rare words.

The index has a posting (template, position) for every word of every licence
passage; words are weighed by their inverse document frequency, counted over all
documents. A file that lacks the rarest word of a passage's key phrases is done with.
Of the words that a file shares with a passage, those of highest weight are looked up, and their postings vote for the stretch of places where the template would start:
the file's place less the template's. Stretches overlap, so that words put in or left
out on the way don't part the votes. Where a template has votes enough it is aligned
with the words there, in order, and its mandatory key phrases must stand among them,
in their order, each whole.

Base phrases are templates that are mandatory as a whole. Their rarest word is in
every occurrence, so looking it up everywhere misses none.

Short notices ("licensed under the GNU General Public License, version 3") are
found alike: a licence's name is mandatory as a whole, and what stands before it
must lead in, that is go back over filling words to "under" or to the name of
another licence that is led in itself. They count for ``labels`` and ``score``,
not for the base columns.

Defined cases: null and empty texts have no words; repeated rows are scanned
alike; an empty table gives an empty result; a very long text is scanned whole, at
each of its places; among places of equal score all are kept and the label is listed
once; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import sliced, spread

# A-Z become small, what is not a word character becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

# The base phrases.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Passages of public licences, each with phrases that must be there.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ["permission is hereby granted free of charge", "without restriction"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["permission is hereby granted free of charge", "without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ["apache license version 2 0", "in compliance with the license"]),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license", ["agreed to in writing", "on an as is basis", "limitations under the license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms", "conditions are met"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce", "list of conditions"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details", ["hope that it will be useful", "gnu general public license"]),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("lgpl", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details", ["hope that it will be useful", "gnu lesser general public license"]),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", ["mozilla public license v 2 0"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license v 2 0"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["permission to use copy modify", "with or without fee"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "with or without fee"]),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["free and unencumbered software", "released into the public domain"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["held liable for any damages", "redistribute it freely"]),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software", ["any person or organization", "covered by this license"]),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license which accompanies this distribution", ["accompanying materials", "eclipse public license"]),
    ("wtfpl", "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed", ["verbatim or modified copies", "as long as the name is changed"]),
    ("ofl", "this font software is licensed under the sil open font license version 1 1 this license is copied below and is also available with a faq at", ["font software", "sil open font license"]),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license the license you may not use this file except in compliance with the license", ["common development and distribution license"]),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work", ["to the extent possible under law", "related or neighboring rights"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike"]),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ["creative commons attribution noncommercial sharealike"]),
]
# Names of licences in short notices. A version that the label names must be there.
NOTICES = {
    "mit": ["mit license", "mit x11 license", "expat license", "spdx license identifier mit"],
    "apache-2": ["apache license version 2", "apache license v2", "apache license v 2", "apache license 2", "apache 2", "apache v2", "apache software license version 2", "apache software license 2", "version 2 of the apache license", "version 2 0 of the apache license"],
    "bsd": ["bsd license", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "2 clause bsd", "3 clause bsd", "4 clause bsd", "two clause bsd", "three clause bsd", "new bsd", "simplified bsd", "modified bsd", "revised bsd"],
    "gpl": ["gnu general public license", "gpl", "gplv1", "gplv2", "gplv3", "gpl2", "gpl3"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "lesser gpl", "lgpl", "lgplv2", "lgplv3", "lgpl2", "lgpl3"],
    "mpl-2": ["mozilla public license version 2", "mozilla public license v2", "mozilla public license v 2", "mozilla public license 2", "mpl 2", "mpl v2", "mpl v 2", "mplv2", "mpl2", "version 2 of the mozilla public license", "version 2 0 of the mozilla public license"],
    "isc": ["isc license", "spdx license identifier isc"],
    "unlicense": ["unlicense"],
    "agpl": ["gnu affero general public license", "affero general public license", "agpl", "agplv3", "agpl3"],
    "epl": ["eclipse public license", "epl 1", "epl 2"],
    "bsl-1": ["boost software license"],
    "zlib": ["zlib license"],
    "artistic-2": ["artistic license 2", "artistic license version 2"],
    "ofl": ["sil open font license", "open font license"],
    "eupl": ["european union public licence", "eupl"],
    "cddl": ["common development and distribution license", "cddl"],
    "cc0": ["cc0", "creative commons zero"],
    "cc-by-nc-sa": ["creative commons attribution noncommercial sharealike", "cc by nc sa"],
    "cc-by": ["creative commons attribution", "cc by"],
    "cc-by-sa": ["creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa"],
    "cc-by-nc": ["creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc"],
}
LEAD_IN = frozenset(b"under identifier".split())
FILLING = frozenset(b"the a an terms and conditions of either or both any later version versions v gnu license licence licenses licences international unported generic".split())
LONGEST_LEAD = 16
# An attribution licence with one of these behind its name is another licence.
OTHER_CC = frozenset(b"nc nd sa noncommercial non noderivs noderivatives no sharealike share".split())
#: Of the words that a file shares with a passage, so many of highest weight are looked up.
FILE_WORDS = 24
#: Words that may be put in or left out ahead of a place; share of the weight looked up that must vote, and of a passage's words that must align.
SHIFT, LEAST_VOTE, LEAST_SCORE = 16, 0.5, 0.8

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


def _phrases() -> list[tuple[str, list[bytes]]]:
    return [(label, words_of(p)) for p, label in PHRASES.items()]


def _templates() -> list[tuple[str, list[bytes], list[list[bytes]]]]:
    return [(label, words_of(text), list(map(words_of, keys))) for label, text, keys in TEMPLATES]


def holds_in_order(words: list[bytes], phrases: list[list[bytes]]) -> bool:
    """Whether each phrase stands whole among ``words``, behind the one before it."""
    at = 0
    for p in phrases:
        at = next((i + len(p) for i in range(at, len(words) - len(p) + 1) if words[i : i + len(p)] == p), -1)
        if at < 0:
            return False
    return True


def aligned(template: list[bytes], words: list[bytes]) -> float:
    """The share of the template's words that stand among ``words`` in its order."""
    blocks = SequenceMatcher(None, template, words, autojunk=False).get_matching_blocks()
    return sum(b.size for b in blocks) / len(template)


def _notices() -> list[tuple[str, list[bytes]]]:
    """Names in short notices, in both spellings of the word licence."""
    both = {(label, n) for label, names in NOTICES.items() for name in names for n in (name, name if name.startswith("spdx") else name.replace(" license", " licence"))}
    return [(label, words_of(n)) for label, n in sorted(both)]


def led_in(words: list[bytes], at: int, ends: set[int]) -> bool:
    """Whether what stands before ``at`` leads in a licence; ``ends`` are the places behind those that are led in."""
    for i in range(at, max(at - LONGEST_LEAD, 0), -1):
        w = words[i - 1]
        if w in LEAD_IN or i in ends and i < at:
            return True
        if w not in FILLING and not w.isdigit():
            return False
    return False


def frequencies(docs: DataFrame) -> tuple[int, dict[bytes, int]]:
    """The number of documents, and for each word of a template that of those that hold it; all documents count."""
    vocab = frozenset(w for _, p in _phrases() for w in p) | frozenset(w for _, t, _ in _templates() for w in t) | frozenset(w for _, p in _notices() for w in p)

    def run(batches):
        for b in sliced(batches):
            seen: Counter = Counter()
            texts = b.column(0).to_pylist()
            for t in texts:
                seen.update(vocab.intersection(words_of(t)))
            keys = list(seen)
            yield pa.RecordBatch.from_arrays([pa.array([b"", *keys], pa.binary()), pa.array([len(texts), *(seen[k] for k in keys)], pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row for each word of the templates
    got = {bytes(r["word"]): r["n"] for r in rows}
    return got.pop(b"", 0), got


class Index:
    def __init__(self, n_docs: int, df: dict[bytes, int]):
        self.idf = lambda w: math.log((1 + n_docs) / (1 + df.get(w, 0)))
        self.phrases, self.templates = _phrases(), _templates()
        self.notices = _notices()
        self.base, self.names = self._by_rarest(self.phrases), self._by_rarest(self.notices)
        # a passage can only be where all words of its key phrases are, so the rarest of them must be
        self.needs = [frozenset(w for key in keys for w in key) for _, _, keys in self.templates]
        self.places = [self._places(words) for _, words, _ in self.templates]
        self.rare = frozenset(max(words, key=lambda w: (self.idf(w), w)) for words in self.needs)
        self.keys = frozenset(self.base) | self.rare | frozenset(self.names)

    @staticmethod
    def _places(words: list[bytes]) -> dict[bytes, list[int]]:
        out: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            out[w].append(i)
        return out

    def _by_rarest(self, phrases: list[tuple[str, list[bytes]]]) -> dict[bytes, list[tuple[int, int]]]:
        out: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for k, (_, words) in enumerate(phrases):
            at = max(range(len(words)), key=lambda i: (self.idf(words[i]), words[i]))
            out[words[at]].append((k, at))
        return out

    def _noticed(self, words: list[bytes], named: list[tuple[int, int]]) -> set[str]:
        """Labels of the names (start, notice) that are led in, from left to right."""
        labels, ends = set(), set()
        for start, k in sorted(named):
            label, p = self.notices[k]
            end = start + len(p)
            if label == "cc-by" and end < len(words) and words[end] in OTHER_CC:
                continue
            if p[0] == b"spdx" or led_in(words, start, ends):
                labels.add(label)
                ends.add(end)
        return labels

    def _passages(self, words: list[bytes], present: set[bytes]) -> dict[str, float]:
        """label -> score of the templates that stand in ``words``; ``present`` are the different ones."""
        postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        needed: dict[int, float] = {}
        for k, places in enumerate(self.places):
            if self.needs[k] <= present:
                rarest = sorted(places.keys() & present, key=lambda w: (-self.idf(w), w))[:FILE_WORDS]
                needed[k] = LEAST_VOTE * sum(self.idf(w) * len(places[w]) for w in rarest)
                for w in rarest:
                    postings[w] += [(k, i) for i in places[w]]
        votes: dict[tuple[int, int], dict[int, float]] = defaultdict(dict)
        for i, w in enumerate(words) if needed else ():
            if w in postings:
                for k, at in postings[w]:
                    stretch = (i - at) // SHIFT
                    # stretches are two SHIFTs wide and overlap by half
                    for part in (stretch - 1, stretch):
                        votes[k, part][at] = self.idf(w)
        best: dict[str, float] = {}
        for (k, part), own in votes.items():
            label, t, keys = self.templates[k]
            if sum(own.values()) < needed[k]:
                continue
            start = part * SHIFT
            there = words[max(0, start) : max(0, start + 2 * SHIFT + len(t) + SHIFT)]
            if holds_in_order(there, keys):
                score = aligned(t, there)
                if score >= LEAST_SCORE:
                    best[label] = max(best.get(label, 0.0), score)
        return best

    def scan(self, text: str | None) -> tuple:
        words = words_of(text)
        n = len(words)
        if self.keys.isdisjoint(words):
            return n, 0, None, None, "", "", 0.0
        starts, labels, named = [], set(), []
        base, names, keys = self.base, self.names, self.keys
        for i, w in enumerate(words):
            if w in keys:
                for k, at in base.get(w, ()):
                    p = self.phrases[k][1]
                    if i >= at and words[i - at : i - at + len(p)] == p:
                        starts.append(i - at)
                        labels.add(self.phrases[k][0])
                for k, at in names.get(w, ()):
                    p = self.notices[k][1]
                    if i >= at and words[i - at : i - at + len(p)] == p:
                        named.append((i - at, k))
        own = labels | self._noticed(words, named)
        score = 1.0 if own else 0.0
        if not self.rare.isdisjoint(words):
            found = self._passages(words, set(words))
            own |= found.keys()
            score = max([score, *found.values()])
        return n, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(own)), score


def licenses(docs: DataFrame) -> DataFrame:
    docs = spread(docs)
    n_docs, df = frequencies(docs)

    def run(batches):
        index = Index(n_docs, df)
        for b in sliced(batches):
            cols = list(zip(*(index.scan(t) for t in b.column(1).to_pylist()))) or [[]] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
