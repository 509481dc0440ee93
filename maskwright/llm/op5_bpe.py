"""BPE encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word the encoding's last token is unique. Candidates for it
are the vocabulary's tokens that are suffixes of the prefix, which an automaton
over the tokens lists for all prefixes in one pass; a candidate is right if it
may stand behind the last token of the prefix before it. Whether two tokens may
stand side by side is found from the merges across their border alone. Following
the stored tokens back from the end gives the ids.

Defined cases: a null or empty text has no tokens; repeated rows are encoded
alike; an empty table gives an empty result; a very long text is encoded in time that
grows with it; other columns are ignored, whatever their names. Text that spells a
special token becomes that token, as in the public library.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._common import sliced, spread

END, MARK = "</w>", "\ue000"
CACHE_WORDS, CACHE_PAIRS = 300_000, 400_000
LATIN_END = 0x250  # up to here the library's letters, numbers and spaces are Python's, whatever the Unicode version
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class WordBpe:
    """Reads a tokenizers file of a BPE with word ends; encodes by itself, normalises with the library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["end_of_word_suffix"] != END or spec["decoder"] is not None:
            raise ValueError("a BPE with word ends and without a decoder is expected")
        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.on_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        vocab: dict[str, int] = model["vocab"]
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        # Byte-level alphabet: printable Latin-1 stands for itself, the rest from U+0100 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.table = [self.byte[b] for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}  # token: (rank of its merge, left, right)
        for r, (a, b) in enumerate(model["merges"]):
            left, right, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[left, right] = r
            self.made.setdefault(whole, (r, left, right))
        self.matches = ahocorasick.Automaton()
        self.size = {}
        for t, i in vocab.items():
            ended = t.endswith(END) and len(t) > len(END)
            body = t[: -len(END)] if ended else t
            self.size[i] = len(body)
            self.matches.add_word(body + MARK if ended else body, i)
        self.matches.make_automaton()
        letters, numbers, spaces = self._latin()
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for sign, chars in ((r"\p{L}", letters), (r"\p{N}", numbers), (r"\s", spaces)):
            pattern = pattern.replace(sign, chars)
        self.cut_latin = re.compile(pattern).findall
        self.beyond_latin = re.compile(f"[^\\x00-{chr(LATIN_END - 1)}]").search
        self.ids, self.texts = _Known(self._ids_of), _Known(self._text_of)
        self.pairs: dict[int, bool] = {}  # by both ids in one number

    def may_follow(self, a: int, b: int) -> bool:
        """Whether merging the letters of ``a`` and ``b`` together gives just these two tokens.

        Undo, from the border outwards, whichever token was made last; at each
        point no merge across the border may come before the one undone.
        """
        x, y, limit, ok = a, b, None, None
        while ok is None:
            r = self.rank.get((x, y))
            if r is not None and (limit is None or r < limit[0] or r == limit[0] and limit[1]):
                ok = False
                break
            mx, my = self.made.get(x), self.made.get(y)
            if mx is None and my is None:
                ok = True
            elif my is None or mx is not None and mx[0] > my[0]:
                limit, x = (mx[0], False), mx[2]
            else:
                # a merge of equal rank on the left side is made first
                limit, y = (my[0], True), my[1]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, already in the byte-level alphabet.

        Matches come by their ends, at each end the longest first, so the first that may stand there is the one.
        """
        n, size, pairs = len(word), self.size, self.pairs
        last = [-1] * (n + 1)
        for end, token in self.matches.iter(word + MARK):
            # the last letter only stands with the word's end, whose matches end one place on
            at = end + 1 if end + 1 < n else n if end == n else 0
            if at and last[at] < 0:
                before = at - size[token]
                left = last[before]
                if before == 0:
                    last[at] = token
                elif left >= 0:
                    ok = pairs.get(left << 32 | token)
                    if ok is None:
                        ok = self.may_follow(left, token)
                    if ok:
                        last[at] = token
        out, at = [], n
        while at > 0:
            out.append(last[at])
            at -= size[last[at]]
        out.reverse()
        return out

    @staticmethod
    def _latin() -> tuple[str, str, str]:
        """Letters, numbers and spaces of the Latin blocks, as the inside of a character class."""
        chars = list(map(chr, range(LATIN_END)))
        kind = lambda first: "".join(f"\\u{ord(c):04x}" for c in chars if unicodedata.category(c)[0] == first)
        return kind("L"), kind("N"), "\\t-\\r \\x85\\xa0"

    def _ids_of(self, piece: str) -> bytes:
        """A piece's ids as little-endian 32-bit integers."""
        return _packed(self.encode_word("".join([self.table[b] for b in piece.encode()])))

    def _text_of(self, piece: str) -> str:
        """What a piece's ids decode to."""
        return self.decode(ids_in(self.ids[piece]))

    def encode_and_decode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit integers, and what they decode to. Pieces met before are looked up."""
        ids, back = [], []
        for part in self.on_special.split(text):
            if part in self.special:
                ids.append(_packed((self.special[part],)))
                back.append(part)
            elif part:
                part = part.lower() if part.isascii() else self.normalize(part)
                if self.beyond_latin(part):
                    # the library's letters and numbers may be of another Unicode version
                    for mapped, _ in self.cut(part):
                        word = self.encode_word(mapped)
                        ids.append(_packed(word))
                        back.append(self.decode(word))
                else:
                    found = self.cut_latin(part)
                    ids += map(self.ids.__getitem__, found)
                    back += map(self.texts.__getitem__, found)
        return b"".join(ids), " ".join(back)

    def forget(self) -> None:
        """Give back what known words take."""
        for known in (self.ids, self.texts, self.pairs):
            known.clear()

    def encode(self, text: str) -> tuple[int, ...]:
        return ids_in(self.encode_and_decode(text)[0])

    def decode(self, ids) -> str:
        text = self.text
        return " ".join([text[i] for i in ids])


class _Known(dict):
    """Values by piece, made when first asked for; forgotten when there are too many."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str):
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[piece] = value = self.make(piece)
        return value


def _packed(ids) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def ids_in(data: bytes) -> tuple[int, ...]:
    return struct.unpack(f"<{len(data) // 4}I", data)


_loaded: dict[str, WordBpe] = {}


def tokenizer(path: str) -> WordBpe:
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Digests per document; with ``with_ids`` also the ids and the decoded text. ``path`` is the file's place on every executor."""

    def run(batches):
        bpe = tokenizer(path)
        for b in sliced(batches):
            n, one, two, all_ids, texts = [], [], [], [], []
            for t in b.column(1).to_pylist():
                ids, back = bpe.encode_and_decode(t or "")
                n.append(len(ids) // 4)
                one.append(hashlib.sha256(ids).hexdigest())
                two.append(hashlib.sha256(back.encode()).hexdigest())
                if with_ids:
                    all_ids.append(ids_in(ids))
                    texts.append(back)
            arrays = [b.column(0), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(texts, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(arrays, names)
        # a worker lives on, and what runs in it next may need the room
        bpe.forget()

    return spread(docs).selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA + ", ids array<long>, decoded string" * with_ids)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary_path())
