"""Secret scan through a trigram inverted index, in DataFrame functions only.

Each rule's regular expression is read on the driver and turned into a Boolean
query: an OR over branches of an AND over trigrams that every match must hold
(in lower case, so that a rule in either case needs one query). The index has a
posting for each text that holds a trigram of any rule. Intersecting postings
gives, per text, the rules that can match; only those are run on it. A rule
without mandatory trigrams is run on every text.

A text is known in the index by a 64-bit hash of itself. Texts that share it
share their postings, which can only add candidates, never lose one.

Defined cases: a null or empty text has no spans; repeated rows are scanned
alike; an empty table gives an empty result; a very long text is one row, searched
as others are; other columns are ignored, and the pipeline form returns them
unchanged, whatever their names.
"""

from __future__ import annotations

import re
from re import _parser as sre
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, joined_near, own_name, spread


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read by java.util.regex; ``least`` is the fewest characters of ``group`` in a kept match."""

    kind: str
    pattern: str
    least: int = 1
    group: int = 0


# The base kinds first, in the order in which ties are listed.
BASE = [
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
]
ADDED = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,32}PRIVATE KEY-----"),
]
RULES = BASE + ADDED
CANDIDATE_LIMIT = 4_000_000  # rows of 12 bytes, which are broadcast
MOST_EXACT = 24


def mandatory(pattern: str) -> list[frozenset[str]]:
    """Branches of lower-case trigrams; a match holds all trigrams of at least one branch. No branches: no such trigrams."""

    def grams(text: str) -> frozenset[str]:
        return frozenset(text[i : i + 3] for i in range(len(text) - 2))

    def both(a: list, b: list) -> list:
        return [x | y for x, y in product(a, b)]

    def walk(parts) -> tuple[list[str] | None, list[frozenset[str]]]:
        """(the exact strings matched, if few; the query)."""
        exact: list[str] | None = [""]
        run, query = [""], [frozenset()]

        def close():
            nonlocal run, query
            query, run = both(query, sorted({grams(x) for x in run}, key=sorted)), [""]

        for op, arg in parts:
            name = str(op)
            few: list[str] | None = None
            q = [frozenset()]
            if name == "LITERAL":
                few = [chr(arg).lower()]
            elif name == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
                few = sorted({chr(v).lower() for _, v in arg})
            elif name == "SUBPATTERN":
                few, q = walk(arg[3])
            elif name == "BRANCH":
                sides = [walk(x) for x in arg[1]]
                if all(e is not None for e, _ in sides):
                    few = sorted({x for e, _ in sides for x in e})
                q = [b for _, s in sides for b in s]
            elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
                low, high, inner = arg
                e, s = walk(inner)
                if low == high == 1:
                    few, q = e, s
                elif low == 0 and high == 1 and e is not None:
                    few = sorted({"", *e})
                elif low >= 1:
                    q = s
            elif name == "AT":
                few = [""]
            if few is not None and len(few) * len(run) <= MOST_EXACT:
                run = sorted({a + b for a, b in product(run, few)})
                exact = sorted({a + b for a, b in product(exact, few)}) if exact is not None else None
                if exact is not None and len(exact) > MOST_EXACT:
                    exact = None
            else:
                close()
                exact = None
                query = both(query, q)
        close()
        return exact, query

    found = walk(sre.parse(pattern))[1]
    return [] if frozenset() in found else found


def vocabulary(rules: list[Rule]) -> list[str]:
    return sorted({t for r in rules for b in mandatory(r.pattern) for t in b})


def _key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def build_index(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """Postings (gram, key): the texts that hold a trigram of the rules' queries."""
    vocab = vocabulary(rules)
    numbered = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("i")) for i, t in enumerate(vocab)))
    # bound once for each row: as a plain column the folded text would be made anew for every trigram
    held = F.flatten(F.transform(F.array(F.lower("text")), lambda low: F.filter(numbered, lambda v: low.contains(v["t"]))))
    # a plain explode would have Catalyst look for all trigrams once more, for a filter on the array's size
    return docs.select(_key().alias("key"), F.explode_outer(held["i"]).alias("gram")).where("gram is not null")


def candidates(index: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """(key, may): per text a bit for each rule whose query its postings satisfy."""
    vocab = {t: i for i, t in enumerate(vocabulary(rules))}
    words = [F.expr(f"bit_or(if(gram div 60 = {w}, shiftleft(1L, cast(gram % 60 as int)), 0L)) b{w}") for w in range(len(vocab) // 60 + 1)]
    per = index.groupBy("key").agg(*words)
    may = F.lit(0)
    for r, rule in enumerate(rules):
        branches = mandatory(rule.pattern)
        if branches:
            anyof = F.lit(False)
            for b in branches:
                need = [0] * len(words)
                for t in b:
                    need[vocab[t] // 60] |= 1 << vocab[t] % 60
                anyof = anyof | reduce(lambda x, y: x & y, (F.col(f"b{w}").bitwiseAND(F.lit(m)) == F.lit(m) for w, m in enumerate(need) if m))
            may = may + F.when(anyof, F.lit(1 << r)).otherwise(0)
    return per.select(F.col("key").alias("ckey"), may.cast("int").alias("may")).where("may > 0")


def _spans(rule: Rule, order: int) -> Column:
    """Array of (s, e, o, kind) of the rule's kept matches in ``text``; leftmost, not overlapping, code points."""
    pattern = rule.pattern if rule.group or rule.least < 2 else _longer(rule)
    lit = F.lit(pattern)
    whole = F.regexp_extract_all("text", lit, F.lit(0))
    part = F.regexp_extract_all("text", lit, F.lit(rule.group)) if rule.group else whole
    gaps = F.split("text", pattern, -1)
    lens = F.arrays_zip(F.transform(gaps, F.length).alias("p"), F.transform(whole, F.length).alias("m"), F.transform(part, F.length).alias("g"))
    none = F.expr("cast(array() as array<struct<s:int,e:int,o:int,kind:string>>)")

    def step(a: Column, x: Column) -> Column:
        start, end = a["at"] + x["p"], a["at"] + x["p"] + F.coalesce(x["m"], F.lit(0))
        one = F.array(F.struct(start.alias("s"), end.alias("e"), F.lit(order).alias("o"), F.lit(rule.kind).alias("kind")))
        # the last gap has no match behind it
        return F.struct(end.alias("at"), F.when(F.coalesce(x["g"], F.lit(0)) < rule.least, a["out"]).otherwise(F.concat(a["out"], one)).alias("out"))

    found = F.aggregate(lens, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda a: a["out"])
    return F.when(F.col("text").rlike(pattern), found)


def _longer(rule: Rule) -> str:
    """A run shorter than ``least`` never ends inside a longer one here, so the bound may stand in the pattern."""
    assert rule.pattern.endswith("+")
    head = re.sub(r"\[[^\]]*\]\+$", "", rule.pattern)
    return rule.pattern[:-1] + f"{{{rule.least - len(head)},}}"


def scan(docs: DataFrame, rules: list[Rule] = RULES, limit: int = CANDIDATE_LIMIT, out: str = "spans") -> DataFrame:
    """``docs`` with a column ``out``, a new name: array of (s, e, o, kind) by start, then kind in the rules' order."""
    scratch = Scratch(docs.sparkSession, "secrets")
    names = docs.columns
    if out in names:
        raise ValueError(f"{out} is a column already")
    index = scratch.save(build_index(docs, rules), "index")
    ckey, may = own_name("ckey", names), own_name("may", names)
    cand = scratch.save(candidates(index, rules).select(F.col("ckey").alias(ckey), F.col("may").alias(may)), "candidates")
    scratch.drop("index")
    none = F.expr("cast(array() as array<struct<s:int,e:int,o:int,kind:string>>)")

    def searched(rows: DataFrame) -> DataFrame:
        parts = []
        for r, rule in enumerate(rules):
            found = _spans(rule, r)
            if mandatory(rule.pattern):
                found = F.when(F.col(may).bitwiseAND(F.lit(1 << r)) != 0, found)
            parts.append(F.coalesce(found, none))
        return rows.withColumn(out, F.array_sort(F.concat(*parts))).select(*(F.col(f"`{c}`") for c in names), F.col(out))

    # texts meet their candidates by key; empty ones, which have none, need none
    key = own_name("key", names)
    rows = docs.withColumn(key, F.when(F.octet_length("text") > 0, _key()))
    return searched(joined_near(rows, cand, key, ckey, limit))


def listed(only_base: bool = False) -> Column:
    spans = F.filter("spans", lambda x: x["o"] < len(BASE)) if only_base else F.col("spans")
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def redact(docs: DataFrame, rules: list[Rule] = RULES, mark: str = "<secret>", limit: int = CANDIDATE_LIMIT) -> DataFrame:
    """Pipeline form: the same rows and columns with every span replaced by ``mark``; spans that touch or overlap give one mark."""
    names = docs.columns
    out = own_name("spans", names)
    rows = scan(docs, rules, limit, out)
    merged = (
        f"aggregate(`{out}`, named_struct('at', 0, 'out', cast(array() as array<string>)), (a, x) -> "
        f"if(x.e <= a.at, a, named_struct('at', x.e, 'out', if(x.s <= a.at and size(a.out) > 0, a.out, concat(a.out, array(substring(text, a.at + 1, x.s - a.at), '{mark}'))))), "
        "a -> concat(array_join(a.out, ''), substring(text, a.at + 1, length(text))))"
    )
    hit = F.size(out) > 0
    rows = rows.withColumn("text", F.when(hit, F.expr(merged)).otherwise(F.col("text")))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        rows = rows.withColumn("n_chars", F.when(hit, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return rows.drop(out)


def secrets(docs: DataFrame, rules: list[Rule] = RULES, limit: int = CANDIDATE_LIMIT) -> DataFrame:
    rows = scan(spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text"), rules, limit)
    count = lambda o: F.size(F.filter("spans", lambda x: x["o"] == o)).cast("long")
    return rows.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(True), 256).alias("base_sha256"), listed().alias("spans"),
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
