"""The registered queries over the driver's tables, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry
from ..operators import aliases, audit, custody, flagging, report, rewrite
from ..operators.scratch import shared_dir, written
from ..operators.spans import occurrences, with_spans
from ..sources import config, filetree
from . import sqlfunctions
from .logs import CTES, FOLDED, KINDS, LOGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return spark.sql(LOGS.replace("from orders", "from {orders}"), orders=orders).select("id", F.col("txt").alias("text"))


def found(df: DataFrame, detectors=None, keys=("id",), allow=frozenset()) -> DataFrame:
    detectors = registry.active() if detectors is None else detectors
    return occurrences(with_spans(df, detectors, "text", allow), list(keys))


def octets(k: str) -> str:
    """An address for each number, in both dialects."""
    return f"'10.' || cast(floor({k} / 65536) as bigint) % 256 || '.' || cast(floor({k} / 256) as bigint) % 256 || '.' || {k} % 256"


def picked(k: str, *choices: str) -> str:
    return f"case {k} % {len(choices)} " + " ".join(f"when {i} then {c}" for i, c in enumerate(choices)) + " end"


# --- detectors -------------------------------------------------------------

def _detect(category: str):
    def run(spark, sf_dir):
        dets = registry.active(enable={"phone"})
        return found(logs(spark, sf_dir), dets).where(F.col("category") == category).select("id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "value")

    run.__name__ = f"detect_{category}"
    return query(f"with logs as ({LOGS}) select id, cast(length(pre) as bigint) s, cast(length(pre) + length(val) as bigint) e, val as value from logs where cat = '{category}'")(run)


for _k in KINDS:
    if _k[0]:
        _detect(_k[0])


@query(f"with logs as ({LOGS}) select cat category, count(*) n from logs where cat <> '' group by cat")
def detector_counts(spark, sf_dir):
    return found(logs(spark, sf_dir), registry.active(enable={"phone"})).groupBy("category").agg(F.count("*").alias("n"))


@query(f"with logs as ({LOGS}) select count(*) n_on, 0 n_off from logs where cat = 'phone'")
def phone_optin(spark, sf_dir):
    rows = logs(spark, sf_dir)
    on = found(rows, registry.active(enable={"phone"})).where("category = 'phone'").agg(F.count("*").alias("n_on"))
    off = found(rows).where("category = 'phone'").agg(F.count("*").cast("int").alias("n_off"))
    return on.crossJoin(off)  # two rows of one


@query("select doc_id, count(*) n from (select doc_id, unnest(regexp_extract_all(text, '[0-9.]+')) run from documents) where regexp_full_match(run, '((25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])[.]){3}(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])') group by doc_id")
def documents_ipv4(spark, sf_dir):
    dets = [d for d in registry.BUILTIN if d.category == "ipv4"]
    return found(table(spark, sf_dir, "documents").select("doc_id", "text"), dets, ("doc_id",)).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("select page_id, 0::bigint s, cast(length(url) as bigint) e, url as value from pages where regexp_full_match(url, '(https?|ftp)://[^ ]*[^ .,;:!?]')")
def pages_url(spark, sf_dir):
    got = found(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("text")), keys=("page_id",))
    return got.where("category = 'url'").select("page_id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "value")


@query("select role, count(*) texts, count(*) filter (where regexp_matches(text, '[0-9]\\.[0-9]|@|://|AKIA|eyJ|[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]')) n from conversations group by role")
def conversations_spans(spark, sf_dir):
    rows = with_spans(table(spark, sf_dir, "conversations").select("role", "text"), registry.active())
    return rows.groupBy("role").agg(F.count("*").alias("texts"), F.count_if(F.size("spans") > 0).alias("n"))


_MARKS = ("'\u0e17\u0e35\u0e48'", "'e\u0301'", "'a\u203f'", "'\u0915\u200d'", "'x\u001f'")


@query(f"with logs as ({LOGS}) select id, cat category, cast(length(lead) + length(pre) + 1 as bigint) s, val as value from (select *, {picked('id', *_MARKS)} lead from logs where cat not in ('', 'phone') and cat <> 'credit_card')")
def detect_after_marks(spark, sf_dir):
    """Values behind words that end in a combining mark, a connector, a joiner or a separator."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = spark.sql(LOGS.replace("from orders", "from {orders}"), orders=rows).where("cat not in ('', 'phone', 'credit_card')")
    rows = rows.selectExpr("id", f"{picked('id', *_MARKS)} || ' ' || txt text")
    return found(rows).select("id", "category", F.col("s").cast("long").alias("s"), "value")


_BORDER = ("'\u0e48'", "'\u0301'", "'\u203f'", "'_'", "'x'", "'\u001f'")


@query(f"select o_orderkey id, 'AKIA' || lpad('' || o_orderkey, 16, '0') as value from orders where o_orderkey % {len(_BORDER)} not in (3, 4)")
def key_borders(spark, sf_dir):
    """A key right behind a mark or connector is found; behind a letter or an underscore it is none."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", f"'k' || {picked('o_orderkey', *_BORDER)} || 'AKIA' || lpad('' || o_orderkey, 16, '0') || ' set' text")
    return found(rows).where("category = 'aws_key'").select("id", "value")


def _runs(name: str, pattern: str, category: str, test: str) -> str:
    """SQL for the maximal runs of some characters in documents, with their places, that pass a test."""
    return f"""
{name}_cut as (select doc_id, regexp_extract_all(text, '{pattern}') m, regexp_split_to_array(text, '{pattern}') g from documents where regexp_matches(text, '{pattern}')),
{name}_at as (select doc_id, m[i] v, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) s from (select *, unnest(range(1, len(m) + 1)) i from {name}_cut)),
{name} as (select doc_id, cast(s as integer) s, cast(s + length(v) as integer) e, '{category}' category, v from {name}_at where {test})"""


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_NUMBER = "list_transform(string_split(v, ''), lambda x: cast(x as integer))"
_SUM = f"list_sum(list_transform({_NUMBER}, lambda x, i: case when (len({_NUMBER}) - i) % 2 = 1 then case when x > 4 then 2 * x - 9 else 2 * x end else x end)) % 10 = 0"
#: In these texts a value is a run of its characters, and no two values overlap.
_DOCUMENT_SPANS = "with " + ",".join([
    _runs("mails", "[A-Za-z0-9_.%+@-]+", "email", "regexp_full_match(v, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}')"),
    _runs("addresses", "[0-9.]+", "ipv4", f"regexp_full_match(v, '({_OCTET}[.]){{3}}{_OCTET}')"),
    _runs("cards", "[0-9]+", "credit_card", f"case when length(v) between 13 and 19 then {_SUM} else false end"),
]) + ", found as (select * from mails union all select * from addresses union all select * from cards) "


@query(_DOCUMENT_SPANS + "select doc_id, s, e, category from found")
def documents_spans(spark, sf_dir):
    return found(table(spark, sf_dir, "documents").select("doc_id", "text"), keys=("doc_id",)).select("doc_id", "s", "e", "category")


# --- tests on matches and the overlap claim --------------------------------

_CARD = "'4111 1111 1111 ' || lpad('' || (o_orderkey % 10000), 4, '0')"
_LUHN = " + ".join(f"(case when {i} % 2 = 0 and 2 * d{i} > 9 then 2 * d{i} - 9 when {i} % 2 = 0 then 2 * d{i} else d{i} end)" for i in range(16))
_DIGITS = ", ".join(f"cast(substr(replace(card, ' ', ''), {i + 1}, 1) as integer) d{i}" for i in range(16))


@query(f"select id, card as value from (select id, card, {_DIGITS} from (select o_orderkey id, {_CARD} card from orders)) where ({_LUHN}) % 10 = 0")
def luhn_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", f"'card ' || {_CARD} || ' paid' text")
    return found(rows).where("category = 'credit_card'").select("id", "value")


@query("select o_orderkey id, '10.0.' || (o_orderkey % 256) || '.1' as value from orders where o_orderkey % 4 in (0, 3)")
def version_context_filter(spark, sf_dir):
    lead = "case o_orderkey % 4 when 0 then 'host ' when 1 then 'Firmware version: ' when 2 then 'running v' else 'version' || chr(10) end"
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", f"{lead} || '10.0.' || (o_orderkey % 256) || '.1 ok' text")
    return found(rows).where("category = 'ipv4'").select("id", "value")


_CLAIMS = [
    # category, before, value, after
    ("url", "'see '", "'https://host' || o_custkey || '.corp/x?ip=1.2.3.4'", "' ok'"),
    ("credit_card", "''", "'4111 1111 1111 1111'", "''"),
    ("email", "'mail '", "'jane' || o_custkey || '@x.co.uk'", "' now'"),
    ("ipv4", "''", octets("o_orderkey"), "''"),
    ("private_key", "'a '", "'-----BEGIN PRIVATE KEY-----' || chr(10) || '10.0.0.1 jane@x.org' || o_custkey || chr(10) || '-----END PRIVATE KEY-----'", "' b'"),
]
_CLAIM = ", ".join(f"{picked('o_orderkey', *(c[i] for c in _CLAIMS))} {name}" for i, name in ((1, "pre"), (2, "val"), (3, "post")))
_CLAIM_CAT = picked("o_orderkey", *(f"'{c[0]}'" for c in _CLAIMS))


@query(f"select id, cast(length(pre) as bigint) s, cast(length(pre) + length(val) as bigint) e, category, val as value from (select o_orderkey id, {_CLAIM}, {_CLAIM_CAT} category from orders)")
def overlap_claim(spark, sf_dir):
    rows = spark.sql(f"select o_orderkey id, {_CLAIM} from {{orders}}", orders=table(spark, sf_dir, "orders")).selectExpr("id", "pre || val || post text")
    return found(rows).select("id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"), "category", "value")


_EDGES = ("'from ' || %s || '.'" % octets("o_orderkey"), "'mail a' || o_custkey || '@b.com.'", "'fe80::1ff:' || printf('%x', o_custkey) || ':890a'", "'lo ::1 up'", "'std::cout' || o_custkey", "'1.2.3.de'", "'4111 1111 1111 1111 123'")


@query("select o_orderkey id, " + picked("o_orderkey", "null", "'fqdn'", "'ipv6'", "null", "'ipv6'", "'fqdn'", "null") + " category, " + picked("o_orderkey", "null", "'b.com'", "'::1ff:' || printf('%x', o_custkey) || ':890a'", "null", "'::'", "'1.2.3.de'", "null") + " as value from orders where o_orderkey % 7 in (1, 2, 4, 5)")
def edge_matches(spark, sf_dir):
    """What the patterns leave at the edges of values: a full stop behind an address, the head of a shortened address."""
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", f"{picked('o_orderkey', *_EDGES)} text")
    return found(rows).select("id", "category", "value")


@query(f"with logs as ({LOGS}) select cat category, min(length(val)) shortest, max(length(val)) longest, cast(sum(length(val)) as bigint) total from logs where cat not in ('', 'phone') group by cat")
def span_lengths(spark, sf_dir):
    n = (F.col("e") - F.col("s")).cast("long")
    return found(logs(spark, sf_dir)).groupBy("category").agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.sum(n).alias("total"))


@query(f"with logs as ({LOGS}) select cat category, count(*) n from logs where cat not in ('', 'phone', 'credit_card') and not (cat = 'mac' and val = 'de:ad:be:ef:01:11') group by cat")
def allowlist_anti(spark, sf_dir):
    allow = frozenset({"4111 1111 1111 1111", "de:ad:be:ef:01:11"})
    return found(logs(spark, sf_dir), allow=allow).groupBy("category").agg(F.count("*").alias("n"))


@query("select o_orderkey id, case when o_orderkey % 2 = 0 then 'Falcon' else 'FALCON' end as value, '<DENY_1>' as alias from orders")
def denylist_literal(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", "'project ' || case when o_orderkey % 2 = 0 then 'Falcon' else 'FALCON' end || ' starts' text")
    occ = written(found(rows, registry.active(denylist=["falcon"])).withColumn("file_ord", F.col("id")).withColumn("rel", F.lit("x")), "occ")
    return occ.join(_number(spark, occ).select("ckey", "alias"), "ckey").select("id", "value", "alias")


@query("select o_orderkey id, '' || o_orderkey as value, 'ticket no' as category from orders")
def custom_regex(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", "'case TKT-' || o_orderkey || ' open' text")
    return found(rows, registry.active(custom=[{"name": "ticket no", "value": r"TKT-(?P<pii>\d+)"}])).select("id", "value", "category")


@query("select case when o_orderkey % 2 = 0 then 'asset.A(1' else 'ASSET.a(1' end as original, count(*) n from orders group by 1")
def custom_literal(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", "'on ' || case when o_orderkey % 2 = 0 then 'asset.A(1' else 'ASSET.a(1' end || ' ok' text")
    occ = written(found(rows, registry.active(custom=[{"name": "asset", "type": "literal", "value": "asset.a(1"}])).withColumn("file_ord", F.col("id")).withColumn("rel", F.lit("x")), "occ")
    return _number(spark, occ).select("original", F.col("count").alias("n"))


@query(f"with logs as ({LOGS}) select cat category, count(*) n from logs where cat not in ('', 'phone', 'credit_card', 'windows_user_path', 'windows_sid') group by cat")
def profile_network_gear(spark, sf_dir):
    cfg = config.resolve("network-gear")
    return found(logs(spark, sf_dir), registry.active(cfg.disable, cfg.enable)).groupBy("category").agg(F.count("*").alias("n"))


# --- aliases and rewriting -------------------------------------------------

def _number(spark, occ, entities=None):
    return aliases.assign(occ, aliases.empty_entries(spark), aliases.empty_entities(spark) if entities is None else entities)


def _seen_in(docs):
    return occurrences(docs, ["id"]).withColumn("file_ord", F.col("id")).withColumn("rel", F.expr("'f' || id % 3"))


def _masked(spark, sf_dir):
    docs = written(with_spans(logs(spark, sf_dir), registry.active()), "spans")
    return docs, written(_number(spark, _seen_in(docs)), "entries")


_TEXT = "case when logs.cat in ('', 'phone') then txt else pre || {new} || substr(txt, length(pre) + length(val) + 1) end"
_JOIN = f" from logs left join named on named.cat = logs.cat and named.k = case when logs.cat in ({FOLDED}) then lower(logs.val) else logs.val end"


@query(CTES + f"select id, {_TEXT.format(new='alias')} text, case when logs.cat in ('', 'phone') then 0::bigint else 1::bigint end replacements {_JOIN}")
def tokenize_text(spark, sf_dir):
    docs, entries = _masked(spark, sf_dir)
    return rewrite.pseudonymise(docs, entries).select("id", "text", "replacements")


@query(CTES + "select alias, n, k as folded, cat category from named")
def alias_numbering(spark, sf_dir):
    return _masked(spark, sf_dir)[1].select("alias", "n", F.element_at(F.split("ckey", "\0"), 3).alias("folded"), "category")


@query(CTES + "select alias, original from named")
def alias_first_seen(spark, sf_dir):
    return _masked(spark, sf_dir)[1].select("alias", "original")


@query(CTES + "select alias, cnt from named")
def alias_counts(spark, sf_dir):
    return _masked(spark, sf_dir)[1].select("alias", F.col("count").alias("cnt"))


@query(CTES + ", w as (select al.alias, 'f' || occ.id % 3 rel, min(occ.id) met from occ join al on al.cat = occ.cat and al.k = occ.k group by 1, 2) select alias, string_agg(rel, ',' order by met) files from w group by alias")
def alias_files(spark, sf_dir):
    docs, entries = _masked(spark, sf_dir)
    met = aliases.sightings(_seen_in(docs), aliases.empty_sightings(spark))
    rows = entries.select("alias", "ckey").join(met, "ckey")
    return rows.groupBy("alias").agg(F.array_join(F.array_sort(F.collect_list(F.struct("ord", "rel")))["rel"], ",").alias("files"))


@query(CTES + "select cat category, count(*) unique_values, cast(sum(cnt) as bigint) occurrences from named group by cat")
def category_summary(spark, sf_dir):
    return aliases.categories(_masked(spark, sf_dir)[1])


@query(CTES + "select prefix counter, max(n) top from named group by prefix")
def counter_tops(spark, sf_dir):
    return aliases.counters(_masked(spark, sf_dir)[1])


@query(f"with logs as ({LOGS}) select id % 3 grp, cast(sum(case when cat in ('', 'phone') then 0 else 1 end) as bigint) replacements from logs group by 1")
def per_doc_replacements(spark, sf_dir):
    docs, entries = _masked(spark, sf_dir)
    return rewrite.pseudonymise(docs, entries).groupBy((F.col("id") % 3).alias("grp")).agg(F.sum("replacements").alias("replacements"))


@query(CTES + f"select id, {_TEXT.format(new='original')} text {_JOIN}")
def reverse_roundtrip(spark, sf_dir):
    docs, entries = _masked(spark, sf_dir)
    masked = written(rewrite.pseudonymise(docs, entries).drop("replacements"), "masked")
    return rewrite.reverse(masked, entries).select("id", "text")


@query(CTES + "select id % 2 = 0 masked, count(*) filter (where id % 2 = 1) leaks, bool_and(id % 2 = 0) clean from occ group by 1")
def verify_verdict(spark, sf_dir):
    """Masked and unmasked lines searched again: a verdict for each."""
    docs, entries = _masked(spark, sf_dir)
    both = rewrite.pseudonymise(docs.where("id % 2 = 0"), entries).select("id", "text").unionByName(docs.where("id % 2 = 1").select("id", "text"))
    left = audit.leaks(both.selectExpr("cast(id as string) rel", "text"), registry.active()).groupBy((F.col("file").cast("long") % 2 == 0).alias("m")).agg(F.count("*").alias("n"))
    parts = both.select((F.col("id") % 2 == 0).alias("masked")).distinct().join(left, F.col("masked") == F.col("m"), "left")
    return parts.select("masked", F.coalesce("n", F.lit(0)).alias("leaks"), F.col("n").isNull().alias("clean"))


@query(CTES + f"select id, {_TEXT.format(new='alias')} text {_JOIN} where id % 3 > 0 union all select id % 3 id, null text from logs where id % 3 = 0 and id < 300")
def tokenize_odd_keys(spark, sf_dir):
    """Rows with a null or repeated key are each rewritten from their own text."""
    docs, entries = _masked(spark, sf_dir)
    odd = docs.where("id % 3 > 0").unionByName(docs.where("id % 3 = 0 and id < 300").withColumn("id", F.col("id") % 3).withColumn("text", F.lit(None).cast("string")).withColumn("spans", F.lit(None).cast(docs.schema["spans"].dataType)))
    return rewrite.pseudonymise(odd, entries).select("id", "text")


_DOCUMENT_ALIASES = """,
keyed as (select *, case category when 'email' then lower(v) else v end k, case category when 'email' then 'EMAIL' when 'ipv4' then 'IP' else 'CC' end prefix from found),
firsts as (select prefix, k, min(struct_pack(d := doc_id, at := s)) f from keyed group by all),
aliases as (select *, '<' || prefix || '_' || row_number() over (partition by prefix order by f) || '>' alias from firsts),
put as (select keyed.doc_id, s, e, alias, lag(e, 1, 0) over (partition by keyed.doc_id order by s) before from keyed join aliases using (prefix, k)),
done as (select p.doc_id, string_agg(substr(text, before + 1, s - before) || alias, '' order by s) || substr(any_value(text), max(e) + 1) masked, count(*) n from put p join documents d on d.doc_id = p.doc_id group by p.doc_id)
"""


@query(_DOCUMENT_SPANS + _DOCUMENT_ALIASES + "select doc_id, coalesce(masked, text) text, coalesce(n, 0) replacements from documents left join done using (doc_id)")
def tokenize_documents(spark, sf_dir):
    """The whole of ``documents`` detected, numbered and rewritten."""
    docs = written(with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), registry.active()), "spans")
    occ = occurrences(docs, ["doc_id"]).withColumn("file_ord", F.col("doc_id")).withColumn("rel", F.lit("documents"))
    return rewrite.pseudonymise(docs, written(_number(spark, occ), "entries"))


@query(f"with logs as ({LOGS}) select 'f' || id file, cat category, cast(1 as bigint) line from logs where cat not in ('', 'phone')")
def verify_leaks(spark, sf_dir):
    return audit.leaks(logs(spark, sf_dir).selectExpr("'f' || id rel", "text"), registry.active()).select("file", "category", "line")


@query("select o_orderkey id, cast(1 + o_orderkey % 5 as bigint) line from orders")
def leak_line_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", "repeat('x' || chr(10), cast(o_orderkey % 5 as int)) || 'oops raw 192.168.1.50 here' text")
    return found(rows).select("id", "line")


@query(CTES + ", r as (select named.*, named.first_id % 2 half from named) select alias, cnt, n from r")
def vault_second_run(spark, sf_dir):
    """Two runs with one dictionary give the aliases of one; the first has the smaller half of the lines."""
    docs = written(with_spans(logs(spark, sf_dir), registry.active()), "spans")
    occ = written(occurrences(docs, ["id"]).withColumn("file_ord", F.col("id")).withColumn("rel", F.lit("x")), "occ")
    middle = F.lit(occ.agg(F.percentile_approx("id", 0.5)).first()[0])
    first = written(_number(spark, occ.where(F.col("id") <= middle)), "first")
    return aliases.assign(occ.where(F.col("id") > middle), first, aliases.empty_entities(spark)).select("alias", F.col("count").alias("cnt"), "n")


# --- entities --------------------------------------------------------------

_KIND = picked("k", "'device'", "'person'", "'Printer 3'", "'3'")
_LABEL = picked("k", "'DEV'", "'USR'", "'PRIN'", "'ENT'")
_PAD = "case when n < 10000 then lpad('' || n, 4, '0') else '' || n end"
#: Each customer is an entity with an address and a host name; lines name one customer each, every third in other case.
_LINES = f"select o_orderkey id, o_custkey k, {octets('o_custkey')} ip, (case when o_orderkey % 3 = 0 then 'srv-' else 'SRV-' end) || o_custkey host from orders"
_ENTITIES = f"""
with ent as (select k, {octets('k')} ip, prefix || {_PAD} label from (select k, prefix, row_number() over (partition by prefix order by k) n from (select c_custkey k, {_LABEL} prefix from (select c_custkey, c_custkey k from customer)))),
lines as ({_LINES}), seen as (select k, ip, count(*) n, min(id) first_id from lines group by k, ip),
past as (select k, '<IP_' || row_number() over (order by first_id) || '>' alias from seen)
"""


def _entity_run(spark, sf_dir):
    """A first run without the operator's table, then the table, then a second run: (lines with spans, entries, entities)."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey k").selectExpr("k", f"{_KIND} type", f"{octets('k')} ip").orderBy("k").collect()  # an operator's table
    rows = [{"id": f"c{r['k']}", "type": r["type"], "pretty_name": f"Customer {r['k']}", "identifiers": [r["ip"], f"SRV-{r['k']}"], "notes": ""} for r in rows]
    lines = spark.sql(_LINES.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders")).selectExpr("id", "'from ' || ip || ' by ' || host || ' ok' text")
    placed = lambda docs: occurrences(docs, ["id"]).withColumn("file_ord", F.col("id")).withColumn("rel", F.lit("a.log"))
    first = written(_number(spark, placed(with_spans(lines, registry.active()))), "first")
    ents = written(aliases.register_entities(spark, rows, aliases.empty_entities(spark)), "entities")
    linked = written(aliases.link_entities(aliases.identifier_rows(spark, rows), first, ents), "linked")
    docs = written(with_spans(lines, registry.active() + registry.for_entities(rows)), "spans")
    return docs, written(aliases.assign(placed(docs), linked, ents), "after"), ents


@query(_ENTITIES + "select 'c' || k entity_id, label from ent")
def entity_labels(spark, sf_dir):
    return _entity_run(spark, sf_dir)[2].select("entity_id", "label")


@query(_ENTITIES + "select '<' || label || '.IP_1>' alias, ent.ip original, coalesce(n, 0) cnt from ent left join seen on seen.k = ent.k union all select '<' || label || '.HOST_1>', 'SRV-' || ent.k, coalesce(n, 0) from ent left join seen on seen.k = ent.k")
def entity_aliases(spark, sf_dir):
    return _entity_run(spark, sf_dir)[1].where("entity_id is not null").select("alias", "original", F.col("count").alias("cnt"))


@query(_ENTITIES + "select id, 'from <' || label || '.IP_1> by <' || label || '.HOST_1> ok' text from lines join ent on ent.k = lines.k")
def entity_tokenize(spark, sf_dir):
    docs, after, _ = _entity_run(spark, sf_dir)
    return rewrite.pseudonymise(docs, after).select("id", "text")


@query(_ENTITIES + "select alias, '<' || label || '.IP_1>' superseded_by from past join ent on ent.k = past.k")
def supersession(spark, sf_dir):
    return _entity_run(spark, sf_dir)[1].where("superseded_by is not null").select("alias", "superseded_by")


@query(_ENTITIES + "select label, '<' || label || '.HOST_1>,<' || label || '.IP_1>' aliases, coalesce(alias, '') superseded from ent left join past on past.k = ent.k")
def legend(spark, sf_dir):
    _, after, ents = _entity_run(spark, sf_dir)
    return aliases.legend(after, ents).select("label", F.array_join("aliases", ",").alias("aliases"), F.array_join("superseded_aliases", ",").alias("superseded"))


_CLASSED = "'ipv4', 'ipv6', 'mac', 'email', 'uuid', 'url', 'fqdn'"


@query(f"with logs as ({LOGS}) select id, case when cat = '' then 'ipv4' when cat in ({_CLASSED}) then cat else 'host' end category, case when cat = '' then 'IP' when cat in ({_CLASSED}) then prefix else 'HOST' end prefix from logs")
def classify_identifier(spark, sf_dir):
    rows = spark.sql(LOGS.replace("from orders", "from {orders}"), orders=table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"))
    got = rows.select("id", aliases.classified(F.col("val")).alias("c"))
    return got.select("id", "c.category", "c.prefix")


@query(CTES + "select distinct original from named where cat in ('ipv4', 'ipv6', 'mac', 'email', 'fqdn', 'host')")
def starter_entities(spark, sf_dir):
    return aliases.starter_rows(_masked(spark, sf_dir)[1])


# --- supersession chains ---------------------------------------------------

#: Ten aliases for each ten orders: a chain of four, one to nowhere, a ring of two with one before it, one to itself, one without pointer.
_AHEAD = {0: 1, 1: 2, 2: 3, 5: 6, 6: 5, 7: 5, 8: 8}
_POINTER = "case o_orderkey % 10 " + " ".join(f"when {a} then '<P_' || (o_orderkey - {a} + {b}) || '>'" for a, b in _AHEAD.items()) + " when 4 then '<GONE_' || o_orderkey || '>' end"


@query("select '<P_' || o_orderkey || '>' alias, case o_orderkey % 10 when 4 then '<GONE_' || o_orderkey || '>' when 7 then '<P_' || (o_orderkey - 2) || '>' else '<P_' || (o_orderkey - o_orderkey % 10 + 3) || '>' end terminal from orders where o_orderkey % 10 in (0, 1, 2, 4, 7)")
def canonical_closure(spark, sf_dir):
    return rewrite.canonical(table(spark, sf_dir, "orders").selectExpr("'<P_' || o_orderkey || '>' alias", f"{_POINTER} superseded_by"))


@query("select o_orderkey id, 'a <IP_1' || o_custkey || '> b <DEV0001.IP_' || o_custkey || '> c <IP_x' || o_custkey || '>' text, cast(1 as bigint) replacements from orders")
def reconcile_text(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", "'a <IP_1' || o_custkey || '> b <IP_' || (2000000 + o_custkey) || '> c <IP_x' || o_custkey || '>' text")
    moved = table(spark, sf_dir, "customer").selectExpr("'<IP_' || (2000000 + c_custkey) || '>' alias", "'<DEV0001.IP_' || c_custkey || '>' superseded_by")
    return rewrite.reconcile(rows, written(rewrite.canonical(moved), "closure")).select("id", "text", "replacements")


# --- files, custody, reports -----------------------------------------------

#: A path and a size for each document.
_PATH = picked("doc_id", "'a.log'", "'b.txt'", "'d/e' || doc_id || '.log'", "'d/.hidden' || doc_id || '.log'", "'_under' || doc_id || '.log'", "'x/keep' || doc_id || '.csv'", "'x/skip' || doc_id || '.log'", "'p' || doc_id || '.PNG'", "'c/' || doc_id || '/t.pcap'", "'d.tar/x' || doc_id", "lang || '/decode.json'")


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_PATH} rel", "n_chars size")


@query(f"select doc_id, rel from (select doc_id, {_PATH} rel from documents) where rel like '%.log' and rel not like 'x/%'")
def glob_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(filetree.included(F.col("rel"), ["*.log"], ["x/*"])).select("doc_id", "rel")


@query(f"select rel, row_number() over (order by string_split(rel, '/')) ord from (select distinct {_PATH} rel from documents)")
def file_order(spark, sf_dir):
    rows = _paths(spark, sf_dir).select("rel").distinct().withColumn("parts", filetree.file_order(F.col("rel"))).withColumn("all", F.lit(0))
    return aliases.numbered(rows, "all", ["parts"], "ord").select("rel", "ord")


@query(f"select doc_id, case when n_chars > 2000 then 'oversize' when doc_id % 11 in (7, 8) then 'binary' end status from documents")
def status_gate(spark, sf_dir):
    return _paths(spark, sf_dir).select("doc_id", filetree.status_gate(F.col("rel"), F.col("size"), 2000).alias("status"))


_ENCODED = ("utf-8", "utf-8-sig", "utf-16", "utf-32", "cp1252", "binary", "undecodable", "undecodable")


@query("select doc_id, " + picked("doc_id", *(["'processed'"] * 5 + ["'binary'", "'undecodable'", "'undecodable'"])) + " status, " + picked("doc_id", *(f"'{e}'" for e in _ENCODED[:5]), "null", "null", "null") + " encoding, length(coalesce(text, '')) + 8 chars from documents")
def decode_encodings(spark, sf_dir):
    """Documents as bytes in several encodings, some with a zero byte or a bad tail, surveyed and decoded by tasks."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                kind, text = _ENCODED[doc % 8], "caf\u00e9 st " + (text or "")
                raw = text.encode(kind, "replace") if doc % 8 < 5 else ("a\0" + text).encode() if kind == "binary" else (b"\xef\xbb\xbf" if doc % 8 == 7 else b"") + text.encode() + b"\xff\x81"
                status, encoding, _ = filetree.survey(raw[i : i + 1000] for i in range(0, len(raw), 1000))
                out.append((doc, status, encoding, len(raw.decode(encoding)) if encoding else len(text)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string(), pa.int64()))], ["doc_id", "status", "encoding", "chars"])

    return table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, status string, encoding string, chars long")


@query(f"select rel file from (select {_PATH} rel from documents) where rel like '%/decode.json'")
def stray_sidecars(spark, sf_dir):
    return audit.stray(_paths(spark, sf_dir))


@query("select 'd' || doc_id file, case when doc_id % 3 = 0 then 'binary' else 'processed' end status, case when doc_id % 3 = 0 then '' else 'utf-8' end encoding, case when doc_id % 3 = 0 then 0 else doc_id % 7 end replacements, sha256(coalesce(text, '')) source_sha256, case when doc_id % 5 = 0 then '' else sha256(lang) end output_sha256, 'now' as timestamp from documents")
def manifest_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stats = docs.select(F.expr("'d' || doc_id rel"), F.expr("case when doc_id % 3 = 0 then 'binary' else 'processed' end status"), F.lit("utf-8").alias("encoding"), F.expr("doc_id % 7 replacements"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("source_sha256"))
    made = docs.where("doc_id % 5 > 0").select(F.expr("'d' || doc_id rel"), F.sha2(F.col("lang").cast("binary"), 256).alias("output_sha256"))
    return custody.manifest_rows(stats, made, "now")


@query("select sha256(string_agg(f || chr(0) || sha256(text) || chr(0) || sha256(upper(f)) || chr(0), '' order by f)) run_digest, count(*) file_count from (select 'd' || doc_id f, text from documents)")
def run_digest(spark, sf_dir):
    f = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    rows = table(spark, sf_dir, "documents").select(f.alias("file"), F.sha2(F.col("text").cast("binary"), 256).alias("source_sha256"), F.sha2(F.upper(f).cast("binary"), 256).alias("output_sha256"))
    return custody.run_digest(rows)


@query(f"with logs as ({LOGS}) select count(*) files_total, count(*) filter (where id % 5 <> 0) files_processed, count(*) filter (where id % 5 = 0) files_copied, cast(sum(case when id % 5 <> 0 then id % 3 else 0 end) as bigint) replacements, cast(sum(id) as bigint) bytes_total from logs")
def run_totals(spark, sf_dir):
    stats = logs(spark, sf_dir).selectExpr("case when id % 5 = 0 then 'binary' else 'processed' end status", "id % 3 replacements", "id size")
    return report.totals(stats)


_FILE = "'d' || cast(floor(id / 4000) as bigint) % 3 || '/f' || lpad('' || cast(floor(id / 1000) as bigint), 6, '0') || '.log'"


def _file_sql(new: str, *select: str) -> str:
    """Lines of a thousand orders make a file; files are numbered in the order of their paths, which is not that of the orders."""
    place = lambda k: f"{_FILE.replace('id /', k + ' /')} || lpad('' || {k}, 12, '0')"
    named = CTES.replace("min(id) first_id", f"min_by(id, {place('id')}) first_id").replace("order by first_id", f"order by {place('first_id')}")
    return named + f"select {_FILE} file, {', '.join(select)} from (select id, case when logs.cat in ('', 'phone') then 0 else 1 end hit, {_TEXT.format(new=new)} text {_JOIN}) group by 1"


def _tree(spark, sf_dir) -> tuple[str, str]:
    """The lines as files in the shared folder, which must be one that plain paths reach; and a folder beside them."""
    import os
    import uuid

    root = f"{shared_dir(spark).removeprefix('file://').removeprefix('file:')}/tree-{uuid.uuid4().hex}"
    files = logs(spark, sf_dir).selectExpr("id", "text", f"{_FILE} rel").groupBy("rel").agg(F.array_join(F.array_sort(F.collect_list(F.struct("id", "text")))["text"], "\n").alias("text"))
    rows = files.select("rel", F.lit(0).alias("chunk"), F.lit(True).alias("whole"), F.lit("utf-8").alias("encoding"), "text")
    filetree.write_mirror(rows, "", f"{root}/in").count()
    os.makedirs(f"{root}/in", exist_ok=True)
    return f"{root}/in", f"{root}/out"


@query(_file_sql("alias", "'processed' status", "cast(sum(hit) as bigint) replacements", "sha256(string_agg(text, chr(10) order by id)) output_sha256"))
def strip_tree(spark, sf_dir):
    """A whole run over a tree of files: listed, read, masked, written, verified; its manifest."""
    import json

    from . import api

    src, dst = _tree(spark, sf_dir)
    out = api.run_strip(spark, src, dst)
    if out["verify"] != "PASS":
        raise RuntimeError("values are left")
    with open(out["manifest"], encoding="utf-8") as f:
        rows = [(r["file"], r["status"], r["replacements"], r["output_sha256"]) for r in json.load(f)["files"]]
    return spark.createDataFrame(rows, "file string, status string, replacements long, output_sha256 string")


@query(_file_sql("original", "sha256(string_agg(text, chr(10) order by id)) sha256"))
def strip_and_restore(spark, sf_dir):
    """The masked tree of a run with a vault, put back by the vault's own dictionary; hashes of the files restored."""
    from ..sources.vault import Vault
    from . import api

    src, dst = _tree(spark, sf_dir)
    api.run_strip(spark, src, dst, api.Options(project=f"{dst}-vault"))
    docs = rewrite.reverse(filetree.read_documents(filetree.list_files(spark, dst)), Vault(f"{dst}-vault").load(spark).entries)
    return docs.select(F.col("rel").alias("file"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


# --- model pass --------------------------------------------------------------

_ANSWER = picked("o_orderkey", "'Jane ' || o_custkey || chr(10) || chr(10) || ' none ' || chr(10) || 'ACME' || chr(10) || 'Jane ' || o_custkey", "'NONE'", "'  x y ' || o_custkey || '  ' || chr(13) || chr(10) || 'none'")


@query("select o_orderkey id, cast(" + picked("o_orderkey", "2", "0", "1") + " as bigint) n, " + picked("o_orderkey", "'Jane ' || o_custkey", "null", "'x y ' || o_custkey") + ' as "first" from orders')
def llm_candidate_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", f"{_ANSWER} answer")
    got = rows.select("id", flagging.parsed(F.col("answer")).alias("c"))
    return got.select("id", F.size("c").cast("long").alias("n"), F.get("c", F.lit(0)).alias("first"))


@query("select o_orderkey id, 'met <LLM_1> at <IP_1> of <LLM_1> today' text from orders")
def llm_apply(spark, sf_dir):
    docs = table(spark, sf_dir, "orders").selectExpr("'f' || o_orderkey rel", "o_orderkey file_ord", "'met Jane Roe at <IP_1> of Jane Roe today' text", "0L replacements")

    def client(url, headers, body, timeout):
        return {"message": {"content": "Jane Roe\nIP_1\n<IP_1>\nab\nJane"}}

    flagged = written(flagging.flag(docs, flagging.Provider(), client), "flagged")
    entries = written(_number(spark, flagging.occurrences(flagged)), "entries")
    return flagging.replace_flagged(docs, flagged, entries).select(F.col("file_ord").alias("id"), "text")


_SHAPES = ("'<IP_' || o_orderkey || '>'", "'<DEV0001.IP_' || o_orderkey || '>'", "'<PRIVATE_KEY_' || o_orderkey || '>'", "'IP_' || o_orderkey", "'<ip_' || o_orderkey || '>'", "'<IP_' || o_orderkey || '> '", "'<IP_' || o_orderkey || '>' || chr(10)")


@query(f"select o_orderkey id, {picked('o_orderkey', *_SHAPES)} alias, o_orderkey % 7 < 3 is_alias from orders")
def alias_predicate(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey id", f"{picked('o_orderkey', *_SHAPES)} alias")
    return rows.select("id", "alias", aliases.is_alias(F.col("alias")).alias("is_alias"))


# --- SQL functions -------------------------------------------------------------

@query(f"with logs as ({LOGS}) select id, cat category, val as value from logs where cat not in ('', 'phone')")
def sql_spans(spark, sf_dir):
    """The search as a SQL function, exploded."""
    sqlfunctions.register(spark, registry.active())
    return spark.sql("select id, x.category, x.value from (select id, explode(mask_spans(text)) x from {logs})", logs=logs(spark, sf_dir))


@query(f"with logs as ({LOGS}) select id, cat category, val as value from logs where cat not in ('', 'phone')")
def sql_table_function(spark, sf_dir):
    """The search as a table function beside each row."""
    sqlfunctions.register(spark, registry.active())
    return spark.sql("select l.id, t.category, t.value from {logs} l, lateral mask_find(l.text) t", logs=logs(spark, sf_dir))


@query(CTES + f"select id, {_TEXT.format(new='alias')} text {_JOIN}")
def sql_tokenize(spark, sf_dir):
    """Rewriting as a SQL function that knows a dictionary."""
    entries = _masked(spark, sf_dir)[1]
    sqlfunctions.register(spark, registry.active(), entries)
    return spark.sql("select id, mask_text(text) text from {logs}", logs=logs(spark, sf_dir))


# --- streaming -----------------------------------------------------------------

@query(CTES + 'select alias, cat category, cnt as "count" from named')
def stream_vault_batches(spark, sf_dir):
    """Log lines as a stream into one dictionary; the dictionary after the last batch."""
    import uuid

    from ..streaming.incremental import Sink, run_available

    schema = table(spark, sf_dir, "orders").schema
    sink = Sink(spark, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", registry.active(), key="id")
    # a pattern, as a stream's path itself must be a folder
    orders = spark.readStream.schema(schema).parquet(f"{sf_dir}/orders.parque[t]").select("o_orderkey", "o_custkey")
    run_available(spark.sql(LOGS.replace("from orders", "from {orders}"), orders=orders).select("id", F.col("txt").alias("text")), sink)
    return sink.dictionary().select("alias", "category", "count")
