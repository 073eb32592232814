"""Main text of web pages: template deduction by equivalence classes, then slot extraction.

A page is read as tokens: tags, told by their path and their place among the tags of that path, and text blocks, told by
path and words.  On each host a token's occurrence vector says how often it stands in each page; tokens with
equal vectors form an equivalence class.  A class is frequent if it stands in at least ``SHARE`` of the host's
pages, and in ``LEAST`` pages; it is valid on a page if its tokens stand in the class's order (that of
their mean places, which is the order of every page if they agree) and nests in the larger
classes: all of it lies between two neighbouring tokens of each.  A text belongs to the template if its own
tag is of its class.  The valid classes, nested, are the page's template; what they leave are slots.

Template texts are dropped wherever they stand, in an article too, unless they are more than half of the
page's main text: such a page is a copy, not a frame.  Of the slots, those under a menu, header, footer, sidebar,
notice, advert, form, script or comment are dropped; if ``MAIN_SHARE`` or more of the characters left are under
article or main elements, only those are the main text.

Vectors are folded into one 64-bit exclusive-or a host and token while counting, so a host
with a third of all pages costs a count like any other and no page list is gathered.  Templates reach the pages by
a broadcast up to ``SENT`` tokens, else by a join that splits large hosts.  Null html is
empty; a null url is a host of its own; repeated rows are treated alike; a page of any length is read in one pass, in memory; empty tables
give empty results; extra columns are
ignored; character references are decoded; a page cut off anywhere is read as far as it goes, and a quote that is not closed ends with
its tag.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import clean_text, save

SHARE, LEAST = 0.5, 4
MAIN_SHARE = 0.3
SENT = 500_000

# Element names of the HTML standard by role.
RAW = {"script", "style", "template", "textarea", "title", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
SKIP = {"nav", "aside", "form", "button", "select", "menu", "dialog", "head", "footer", "svg", *RAW}
MAIN = {"article", "main"}
#: Words of class, id and role that mark boilerplate.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pagination", "popup", "promo", "related", "replies", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Those that also hold inside an article; of the others there the template decides.
INNER = {"ad", "ads", "advert", "adverts", "advertisement", "comment", "comments", "consent", "cookie", "cookies", "disqus", "gdpr", "nav", "navbar", "navigation", "replies", "respond", "sidebar", "sponsor", "sponsored"}
#: In an unclosed paragraph these end it.
CLOSES_P = {"p", "div", "ul", "ol", "table", "section", "article", "main", "footer", "header", "nav", "aside", "form", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "hr", "figure", "dl"}

#: A quoted value ends at a quote that is followed by space, slash or the tag's end; a quote without one is a character like others.
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"(?=[\s/>])|'[^']*'(?=[\s/>])|[^>])*+)(>|$)", re.S)
ATTR = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


def _marks(attrs: str, article: bool) -> tuple[str, bool]:
    """(class text, is boilerplate)."""
    if not attrs or not attrs.strip():
        return "", False
    found, bad = "", False
    for name, value in ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            bad = True
        elif name in ("class", "id", "role"):
            found = found or value
            marks = set(re.split(r"[^a-z0-9]+", value))
            bad = bad or bool(marks & (INNER if article else MARKS)) or value in ("complementary", "contentinfo")
    return found, bad


class Token(NamedTuple):
    path: str
    #: The words of a text block; None for a tag.
    text: str | None
    article: bool
    skip: bool


class _Open(NamedTuple):
    name: str
    path: str
    skip: bool
    article: bool


def tokens(page: str) -> list[Token]:
    """Opening tags and text blocks in page order; texts under boilerplate tags are left out."""
    out: list[Token] = []
    stack: list[_Open] = []
    text: list[str] = []

    def flush() -> None:
        if text:
            words = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if words:
                top = next((s for s in reversed(stack) if s.name not in INLINE), _Open("", "", False, False))
                out.append(Token(top.path, words, any(s.article for s in stack), False))

    def say(part: str) -> None:
        # What a skipped element says is left out; an inline one doesn't end the block around it.
        if part and not (stack and stack[-1].skip):
            text.append(part)

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if m[0].startswith("<![CDATA["):
                say(entities.escape(m[0][9:].removesuffix("]]>")))
            continue
        if name == "br":
            say(" ")
            continue
        if name not in INLINE:
            flush()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name == name), None)
            # An inline end tag closes nothing beyond the block it stands in.
            if depth is not None and not (name in INLINE and any(s.name not in INLINE for s in stack[depth:])):
                del stack[depth:]
            continue
        if name in VOID or m[3].rstrip().endswith("/") and name not in RAW:
            continue
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in CLOSES_P or name in ("li", "dt", "dd", "tr", "td", "th"):
            closes = {"p"} if name in CLOSES_P else {name, "p"} if name not in ("dt", "dd", "td", "th") else {"p", *({"dt", "dd"} if name[0] == "d" else {"td", "th"})}
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i].name in closes), None)
            walls = max((i for i, s in enumerate(stack) if s.name in ("table", "ul", "ol", "div", "article", "section", "main", "dl")), default=-1)
            if depth is not None and depth > walls:
                del stack[depth:]
        up = stack[-1] if stack else _Open("", "", False, False)
        label, marked = _marks(m[3], up.article)
        skip = up.skip or name in SKIP and not (name == "footer" and up.article) or marked and name not in ("html", "body", *MAIN) or name == "header" and not up.article
        stack.append(_Open(name, f"{up.path}/{name}" + (f".{label}" if label else ""), skip, up.article or name in MAIN))
        if name not in INLINE:
            out.append(Token(stack[-1].path, None, stack[-1].article, skip))
    flush()
    return out


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def host_of(url):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def named(page: list[Token]) -> list[tuple[int, int]]:
    """(number, number of the enclosing tag) of each token of a page; a tag encloses itself."""
    out, place, last = [], Counter(), {}
    for t in page:
        if t.text is None:
            number = _hash(t.path, "#", str(place[t.path]))
            place[t.path] += 1
            last[t.path] = number
            out.append((number, number))
        else:
            out.append((_hash(t.path, t.text), last.get(t.path, 0)))
    return out


def templates(pages: DataFrame) -> DataFrame:
    """pages(row, host, html) -> host, token, vector, place, pages: the frequent classes of each host,
    with the texts whose tag is of their class."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            rows = []
            for row, host, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                numbers = named(tokens(page))
                count, first = Counter(x for x, _ in numbers), {}
                for at, (x, tag) in enumerate(numbers):
                    first.setdefault(x, (at, tag))
                rows += [(host, x, tag, _hash(str(row), str(count[x])), at) for x, (at, tag) in first.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)], names=["host", "token", "tag", "seen", "place"])

    seen = pages.mapInArrow(read, "host long, token long, tag long, seen long, place long")
    sums = seen.groupBy("host", "token", "tag").agg(F.bit_xor("seen").alias("vector"), F.count(F.lit(1)).alias("pages"), F.sum("place").alias("place")).where(F.col("pages") >= LEAST)
    hosts = pages.groupBy("host").agg(F.count(F.lit(1)).alias("all"))
    frequent = save(sums.join(hosts, "host").where(F.col("pages") >= SHARE * F.col("all")).drop("all"), "web-frequent")
    tags = frequent.where("token = tag").select("host", "tag", "vector")
    # A valid class holds the tag around its text: both then have one occurrence vector.
    return frequent.join(tags, ["host", "tag", "vector"], "left_semi").select("host", "token", "vector", (F.col("place") / F.col("pages")).alias("place"), "pages")


def template_of(numbers: list[int], known: dict) -> set[int]:
    """Places on the page of the tokens of its valid classes; known: token -> (class, mean place, pages)."""
    classes: dict[int, list[int]] = {}
    seen = set()
    for at, x in enumerate(numbers):
        if x in known and x not in seen:
            seen.add(x)
            classes.setdefault(known[x][0], []).append(at)
    accepted: list[list[int]] = []
    for _, places in sorted(classes.items(), key=lambda c: (-known[numbers[c[1][0]]][2], -len(c[1]), c[1])):
        means = [known[numbers[at]][1] for at in places]
        ordered = all(a <= b for a, b in zip(means, means[1:]))
        nested = all(bisect(outer, places[0]) == bisect(outer, places[-1]) or (places[0] < outer[0] and outer[-1] < places[-1] and bisect(places, outer[0]) == bisect(places, outer[-1])) for outer in accepted)
        if ordered and nested:
            accepted.append(places)
    valid = {numbers[at] for places in accepted for at in places}
    return {at for at, x in enumerate(numbers) if x in valid}


def main_text(page: str, known: dict | None = None) -> tuple[str, int]:
    """The text of a page and how many of its tokens belong to the host's template."""
    found = tokens(page)
    frame = template_of([x for x, _ in named(found)], known) if known else set()
    texts = [(at, t) for at, t in enumerate(found) if t.text is not None and not t.skip]
    size = lambda part: sum(len(t.text) for _, t in part)
    slots = [(at, t) for at, t in texts if at not in frame]
    main = [x for x in slots if x[1].article]
    every = [x for x in texts if x[1].article] or texts
    of = main if main and size(main) >= MAIN_SHARE * size(slots) else slots
    if 2 * size(of) < size(every):
        # Half of the text is the host's: a copy of a page, not a frame around others.
        main = [x for x in texts if x[1].article]
        of = main if main and size(main) >= MAIN_SHARE * size(texts) else texts
    return "\n\n".join(t.text for _, t in of), len(frame)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_template (tokens of the host's template on the page)."""
    host = F.xxhash64(host_of(F.col(url))).alias("host")
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host, clean_text(page).alias("html"))
    known = save(templates(rows.select(F.xxhash64("page_id", "url", "html").alias("row"), "host", "html")), "web-templates")
    by_host = save(known.groupBy("host").agg(F.collect_list(F.struct("token", "vector", "place", "pages")).alias("template")), "web-hosts")  # a host's is bounded by what half its pages share
    small = known.count() <= SENT

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, frames, cache = [], [], {}
            for body, host, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                if host not in cache:
                    cache[host] = {t["token"]: (t["vector"], t["place"], t["pages"]) for t in template.as_py() or ()}
                text, n = main_text(body, cache[host])
                texts.append(text)
                frames.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(frames, pa.int64())], names=["page_id", "url", "text", "n_chars", "n_template"])

    joined = rows.join(F.broadcast(by_host) if small else by_host, "host", "left").select("page_id", "url", "html", "host", "template")
    kind = dict(rows.dtypes)
    return joined.mapInArrow(cut, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars long, n_template long")


def op9_webtext(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
