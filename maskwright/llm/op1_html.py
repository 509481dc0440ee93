"""Main text of web pages by equivalence-class template deduction.

A page is a sequence of tokens: its tags and its text blocks, each with the path
at which it stands. Over the pages of one host each token has an occurrence
vector, how often it is on which page. Tokens with equal vectors form an
equivalence class; a class is valid if it has several tokens and is on enough of
the host's pages. Its tokens are in the order in which pages have them. Valid classes
are nested into the host's template page by page: a class opens at its first token
and closes at its last, each token between moves it on to its next gap, and classes
that open in a gap lie in it. What stands in a gap and is no token at its place is a
slot, known by the classes and gaps around it. Where the template marks an article
(``article``, ``main``), the slots below that mark are the main text, elsewhere all
slots are. Below a mark only a token at its place is template; elsewhere a token of a
valid class is so wherever it stands, as menus may be in any order.

Vectors are never built: a class is known by the sum of hashes of (page, count), in
which repeated rows do not cancel out. It is summed up per host and token before any shuffle, so that a host
with a third of all pages is no hot group.

Text below such a mark is counted apart, over the host's distinct articles and not
over its pages, which may well be copies of one article. What is on enough of the
articles and in a valid class is template there too, unless it is over three
quarters of an article's text, as with near copies: then it stays. An article that stands elsewhere than the template's, a
teaser say, only counts on a page that has none at the template's place or whose
host has no template: such pages are read by their own marks. Elements for navigation,
forms, notices, adverts and comments, by tag or by class name, are left out in any
case, unless they wrap the page: an element around the main text is no such element,
see ``_wrappers``. A head ends with the first text or element of the body.

Defined cases: a null or empty html has an empty text; a host with few pages, or
a null url, has no template; repeated rows are extracted alike; an empty table
gives an empty result; a very long page is read in one go, in time that grows with it,
one page at a time; other columns are ignored, whatever their names; broken markup is
read as far as it goes.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import Scratch, joined_near, sliced, small_side, spread

LEAST_PAGES, LEAST_SHARE, LEAST_CLASS, BROADCAST_ROWS, BROADCAST_HOSTS, KNOWN = 4, 0.5, 2, 20_000, 1_000_000, 1_000

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>?|<[!?][^>]*>?|[^<]+|<""", re.S)
# HTML elements by their part in a page.
RAW = frozenset("script style noscript template svg math iframe object select textarea title canvas audio video".split())
AWAY = frozenset("nav footer aside form button dialog menu".split())
VOID = frozenset("head area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|banner|promo(?:tion)?|sidebar|menu|nav|navbar|navigation|breadcrumbs?|footer|comments?|comment-list|replies|respond|disqus|cookies?|consent|gdpr|notices?|alert|popup|modal|newsletter|subscribe|share|sharing|social|related|recommended|widget|login|signup|search)(?:$|[\s_-])",
    re.I,
)
MASTHEAD = re.compile(r"(?:^|[\s_-])(?:header|masthead|site-header|topbar)(?:$|[\s_-])", re.I)
ATTR = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)""", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
HIDDEN = re.compile(r"""(?:\s|^)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)


# Class names of a wrapper's state, as has-sidebar or page-without-comments.
STATE = re.compile(r"(?:^|[_-])(?:has|have|no|not|with|without|show|hide|is)[_-]", re.I)


def _marked(value: str) -> bool:
    return bool(MARKED.search(value)) and any(MARKED.search(x) for x in value.split() if not STATE.search(x))


def _own_word(attrs: str) -> bool:
    """Whether a whole class, id or role is such a word."""
    return any((m := MARKED.search(x)) and len(m[0]) == len(x) for v in ATTR.findall(attrs) for x in v.strip("\"'").split())


def _left_out(tag: str, attrs: str, inside: bool) -> bool:
    if tag in AWAY or tag == "header" and not inside:
        return True
    if "=" in attrs or "hidden" in attrs:
        for value in ATTR.findall(attrs):
            value = value.strip("\"'")
            if _marked(value) or value.lower() in ROLES or not inside and MASTHEAD.search(value):
                return tag not in ("html", "body", "article", "main")
        return bool(HIDDEN.search(attrs)) and tag not in ("html", "body")
    return False


class _Away:
    """An element that is left out, and what is below it."""

    __slots__ = ("tag", "plain", "main", "article", "titled", "h1", "size", "linked")

    def __init__(self, tag: str, attrs: str):
        self.tag, self.plain = tag, tag == "form" or tag not in AWAY and tag != "header" and not _own_word(attrs)
        self.main = self.article = self.titled = self.h1 = False
        self.size = self.linked = 0


def _wrappers(blocks: list[tuple[str, str, bool, tuple[_Away, ...]]]) -> frozenset[_Away]:
    """The left-out elements that stay, as they wrap the main text.

    Such are those with a ``main`` or an article with a ``h1`` below; where no marked
    text is left, those with an article below that is no comment or the like; and where
    there is none either, those with more than half of the page's text, most of it no
    links, that have a ``h1`` or, named by no whole word, leave hardly any text.
    """
    known = {a for b in blocks for a in b[3]}
    if not known:
        return frozenset()
    stay = {a for a in known if a.main or a.titled}

    def left(inside: bool) -> int:
        return sum(len(t) for _, t, i, away in blocks if (i or not inside) and stay.issuperset(away))

    if not left(True):
        stay |= {a for a in known if a.article and (a.tag == "form" or a.tag not in AWAY)}
        if not left(True):
            total, rest = sum(len(b[1]) for b in blocks), left(False)
            for a in known:
                if 2 * a.size > total and 2 * a.linked < a.size and (a.tag == "form" or a.tag not in AWAY and a.tag != "header"):
                    if a.h1 or a.plain and 10 * rest < total:
                        stay.add(a)
    return frozenset(stay)


def parse(html: str) -> tuple[list[tuple[str, str, bool, bool]], list[str]]:
    """(blocks, tags): each block (path, text, in an article, left out), in page order; each tag's path."""
    return parse_in_order(html)[:2]


def parse_in_order(html: str) -> tuple[list[tuple[str, str, bool, bool]], list[str], list[int]]:
    """``parse`` and the page's order: a block by its number, a tag by -1 less its number."""
    blocks, tags, parts, order = [], [], [], []
    stack: list[tuple[str, tuple[_Away, ...], bool]] = []  # tag, left out by, in an article
    skip, link = "", False

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                _, away, inside = stack[-1] if stack else ("", (), False)
                order.append(len(blocks))
                blocks.append(("/".join(t for t, _, _ in stack if t not in INLINE), text, inside, away))
                for a in away:
                    a.size += len(text)

    for m in TOKEN.finditer(html):
        tag = m[2]
        if tag is None:
            if not skip and m[0][:2] not in ("<!", "<?"):
                parts.append(unescape(m[0]) if "&" in m[0] else m[0])
                if link and stack:
                    for a in stack[-1][1]:
                        a.linked += len(parts[-1])
            continue
        tag, closing = tag.lower(), bool(m[1])
        if skip:
            if closing and tag == skip:
                skip = ""
            continue
        if not closing and tag in RAW:
            if not m[3].endswith("/"):
                skip = tag
            if tag not in INLINE:
                flush()
            continue
        if tag in INLINE:
            if tag == "a":
                link = not closing
            if tag == "br" or tag == "img":
                parts.append(" ")
            elif not closing and _left_out(tag, m[3], bool(stack) and stack[-1][2]):
                flush()
                top = stack[-1] if stack else ("", (), False)
                stack.append((tag, (*top[1], _Away(tag, m[3])), top[2]))
            elif closing and stack and stack[-1][0] == tag:
                flush()
                stack.pop()
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
            stack.pop()
        _, away, inside = stack[-1] if stack else ("", (), False)
        if away and tag in ("article", "main", "h1"):
            real = tag == "article" and not any(_marked(v.strip("\"'")) for v in ATTR.findall(m[3]))
            in_article = tag == "h1" and any(t == "article" for t, _, _ in stack)
            for a in away:
                a.main, a.article, a.h1 = a.main or tag == "main", a.article or real, a.h1 or tag == "h1"
                a.titled = a.titled or in_article and a.article
        inside = inside or tag in ("article", "main")
        if _left_out(tag, m[3], inside):
            away = (*away, _Away(tag, m[3]))
        if not m[3].endswith("/"):
            stack.append((tag, away, inside))
        order.append(-1 - len(tags))
        tags.append("/".join(t for t, _, _ in stack))
    flush()
    stay = _wrappers(blocks)
    return [(p, t, inside, not stay.issuperset(away)) for p, t, inside, away in blocks], tags, order


def _token(path: str, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{path}\0{text}".encode("utf-8", "surrogatepass"))


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


class Template:
    """A host's valid classes, each (whether of articles, its tokens in order), and where their tokens belong."""

    def __init__(self, classes=()):
        self.classes = [(part, tuple(tokens)) for part, tokens in classes]
        self.tokens = frozenset(t for _, tokens in self.classes for t in tokens)
        self.place: dict[tuple[bool, int], tuple[int, int]] = {}
        for c, (part, tokens) in enumerate(self.classes):
            for k, t in enumerate(tokens):
                self.place.setdefault((part, t), (c, k))

    def nest(self, tokens: list[tuple[bool, int]]) -> tuple[list[bool], list[tuple[tuple[int, int], ...]]]:
        """For a page's tokens, each (whether of an article, token): whether each is at its place, and the (class, gap)s around it, outermost first."""
        open_, at_place, around = [], [], []
        for key in tokens:
            c, k = self.place.get(key, (-1, 0))
            # a class that is open already and opens anew, or goes on while classes inside it are open, ends those
            i = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == c), -1)
            right = c >= 0 and (k == 0 or i >= 0 and open_[i][1] == k)
            if right:
                if i >= 0:
                    del open_[i + (k > 0) :]
                if k == 0:
                    open_.append([c, 1])
                else:
                    open_[i][1] = k + 1
                if open_[-1][1] == len(self.classes[c][1]):
                    open_.pop()
            at_place.append(right)
            around.append(tuple((c, k) for c, k in open_))
        return at_place, around


NO_TEMPLATE = Template()


def article_marks(tags: list[str], template: Template) -> tuple[str, ...]:
    """Paths at which the template itself has an article."""
    marks = {p for p in tags if p.rpartition("/")[2] in ("article", "main")}
    return tuple(sorted(p for p in marks if _token(p, "") in template.tokens))


def slots(blocks: list[tuple[str, str, bool, bool]], tags: list[str], order: list[int], template: Template) -> list[tuple[str, str, bool, tuple]]:
    """(path, text, in an article, place in the template) of each block that is neither template nor left out, in page order."""
    out = []
    seen = ([], [])  # outside and inside articles, whose classes are apart
    for e in order:
        p, t, inside = (*blocks[e][:2], blocks[e][2]) if e >= 0 else (tags[-1 - e], "", False)
        seen[inside].append((e, (inside, _token(p, t))))
    for part in seen:
        at_place, around = template.nest([k for _, k in part])
        for (e, (inside, token)), right, place in zip(part, at_place, around):
            if e >= 0 and not blocks[e][3] and not (right if inside else token in template.tokens):
                out.append((e, (*blocks[e][:3], place)))
    return [x for _, x in sorted(out, key=lambda x: x[0])]


def main_text(html: str | None, template: Template = NO_TEMPLATE) -> str:
    blocks, tags, order = parse_in_order(html or "")
    whole = [(p, t, inside, ()) for p, t, inside, out in blocks if not out]
    free = slots(blocks, tags, order, template) if template.classes else whole
    if 4 * sum(len(x[1]) for x in free if x[2]) < sum(len(x[1]) for x in whole if x[2]):
        free = [x for x in whole if x[2] or _token(*x[:2]) not in template.tokens]
    if template.classes:
        marks = article_marks(tags, template)
        for some in (free, whole):
            below = [t for p, t, inside, _ in some if inside and any(p == m or p.startswith(m + "/") for m in marks)]
            if below:
                return "\n".join(below)
    marked = [x[1] for x in free if x[2]] or [x[1] for x in whole if x[2]]
    return "\n".join(marked or [x[1] for x in free] or [t for _, t, _, out in blocks if not out])


def article_tokens(blocks: list[tuple[str, str, bool, bool]]) -> tuple[int, Counter, dict[int, int]]:
    """A page's marked text: its hash, how often each of its tokens is there, and where first; tags by their paths, once each, at no place (-1)."""
    live = [(i, p, t) for i, (p, t, inside, out) in enumerate(blocks) if inside and not out]
    seen, first = Counter(), {}
    for i, p, t in live:
        token = _token(p, t)
        seen[token] += 1
        first.setdefault(token, i)
    for path in {p for _, p, _ in live}:
        steps = path.split("/")
        start = next(i for i, t in enumerate(steps) if t in ("article", "main"))
        for i in range(start, len(steps)):
            token = _token("/".join(steps[: i + 1]), "\0")
            seen[token] = 1
            first[token] = -1
    return _token("", "\0".join(x for _, *b in live for x in b)), seen, first


def page_tokens(blocks: list[tuple[str, str, bool, bool]], tags: list[str], order: list[int]) -> tuple[Counter, dict[int, int]]:
    """How often each token outside marks is on a page, tags everywhere among them, and where first."""
    seen, first = Counter(), {}
    for i, e in enumerate(order):
        if e < 0 or not blocks[e][2]:
            token = _token(tags[-1 - e], "") if e < 0 else _token(*blocks[e][:2])
            seen[token] += 1
            first.setdefault(token, i)
    return seen, first


TOKENS = "host string, part boolean, token long, vector long, at long"
CLASSES = "array<struct<part:boolean,tokens:array<bigint>>>"


def deduce_templates(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(th, template): per host its valid classes, those on most pages first, each with its tokens in page order."""

    def tokens(batches):
        for b in sliced(batches):
            hosts, parts, keys, vectors, places = [], [], [], [], []
            for url, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                host = host_of(url)
                if not host or not html:
                    continue
                blocks, tags, order = parse_in_order(html)
                me = f"{url}\0{xxhash.xxh3_64_intdigest(html.encode('utf-8', 'surrogatepass'))}"
                own = xxhash.xxh3_64_intdigest(me.encode("utf-8", "surrogatepass"))
                article, *below = article_tokens(blocks)
                for part, whole, (found, first) in ((False, own, page_tokens(blocks, tags, order)), (True, article, below)):
                    if part and not found:
                        continue
                    hosts += [host] * (len(found) + 1)
                    parts += [part] * (len(found) + 1)
                    keys += [0, *found]  # 0 stands for the page or article itself
                    vectors += [whole, *(xxhash.xxh3_64_intdigest(c.to_bytes(8, "big"), whole % 2**63) for c in found.values())]
                    places += [0, *(first[t] for t in found)]
            columns = [pa.array(hosts, pa.string()), pa.array(parts, pa.bool_()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, vectors)), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["host", "part", "token", "vector", "at"])

    # in halves, whose sums do not overflow
    halves = F.expr("sum(shiftright(vector, 32))").alias("high"), F.expr("sum(vector & 4294967295L)").alias("low")
    rows = pages.select("url", "html").mapInArrow(tokens, TOKENS)
    # copies of an article count once; pages are summed up before the shuffle
    once = rows.groupBy("host", "part", "token", F.when(F.col("part"), F.col("vector")).alias("own")).agg(F.count("*").alias("n"), *halves, F.sum("at").alias("all_at"), F.min("at").alias("one_at"))
    one = {"n": "1L", "high": "shiftright(own, 32)", "low": "own & 4294967295L", "all_at": "one_at"}
    once = once.select("host", "part", "token", *(F.expr(f"if(part, {x}, {name})").alias(name) for name, x in one.items()))
    sums = [F.sum(name).alias(name) for name in one]
    seen = scratch.save(once.groupBy("host", "part", "token").agg(*sums), "tokens")
    total = scratch.save(seen.where("token = 0").select(F.col("host").alias("h"), F.col("part").alias("of"), F.col("n").alias("pages")), "pages")
    # the rows of a host with very many tokens stay where they are
    frequent = seen.where(f"token <> 0 and n >= {LEAST_PAGES}").join(small_side(total, BROADCAST_HOSTS), (F.col("host") == F.col("h")) & (F.col("part") == F.col("of")) & (F.col("n") >= F.col("pages") * LEAST_SHARE))
    # tokens of a class are on the same pages, so the sums of their places are in the order of the pages
    classes = frequent.groupBy("host", "part", "n", "high", "low").agg(F.array_sort(F.collect_list(F.struct("all_at", "token"))).alias("members")).where(F.size("members") >= LEAST_CLASS)
    classes = classes.withColumn("tokens", F.filter("members", lambda x: x["all_at"] >= 0)["token"])
    template = classes.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "part", "tokens"))).alias("nest"))
    return scratch.save(template.select(F.col("host").alias("th"), F.expr(f"cast(transform(nest, x -> named_struct('part', x.part, 'tokens', x.tokens)) as {CLASSES})").alias("template")), "templates")


def _host(urls: pa.Array) -> pa.Array:
    return pa.array([host_of(u) or None for u in urls.to_pylist()], pa.string())


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text and its code points."""
    scratch = Scratch(pages.sparkSession, "html")
    pages = spread(pages).selectExpr("cast(page_id as long) page_id", "url", "html")
    templates = deduce_templates(pages, scratch)
    scratch.drop("tokens", "pages")
    # the same function as above, so that every host finds its template
    host = F.arrow_udf(_host, "string")("url")

    def run(batches):
        known: dict[str, Template] = {}
        for b in sliced(batches):
            texts = []
            for html, name, template in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                if name not in known:
                    if len(known) >= KNOWN:
                        known.clear()
                    known[name] = Template((c["part"], [t % 2**64 for t in c["tokens"]]) for c in template or ())
                texts.append(main_text(html, known[name]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = joined_near(pages.withColumn("host", host), templates, "host", "th", BROADCAST_ROWS)
    return rows.select("page_id", "url", "html", "host", "template").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op1_html_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
