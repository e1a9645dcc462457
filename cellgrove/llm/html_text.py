"""Main text of web pages by removal of site templates.

A page is cut into tags and text by one regular expression without backtracking and read as a tree (omitted end tags are closed
as HTML closes them). Every element subtree is hashed from its tag, class and content. Spark counts, per host, the distinct holders
of each block element's hash: outside the main zone the holders are the host's distinct pages, inside it the distinct texts of
``article`` or ``main``. A subtree with ``MIN_PAGES`` holders or more, and ``SHARE`` of the host's holders of its kind, is the
site's template. Repeated pages are one page, and copies of an article one article, so they keep their text.

The main zone is all that stands in ``article`` or ``main``; without text there, it is the body. Its templates are deleted. Two
guards keep copies apart from templates: if more than ``COPIED`` of a zone's text recurs, in two subtrees or more, the zone is a
near copy of others and nothing of it is template; if nothing were left of a page, nothing goes. An element around an article or main is
never a template. Outside an article, elements whose tag, role, class or id names a menu, header, footer, side bar, notice, advert, form,
comment section or the like are dropped too; inside an article only the tags of these, adverts and reader comments (which no count can find, as each is new).

What is left is cut at block elements; white space (no-break spaces too) inside a block becomes one space, ends are trimmed,
empty blocks go, and blocks are joined by a line feed.

Defined results: a null or empty page gives the empty text; a page without an address counts under the empty host; every row
has its own result, whether its id is null, repeated or not; text outside any element counts as body; a tag that never ends is
text, a comment that never ends is dropped; a quote that never ends is an ordinary character. Reading a page is linear in its
length. A hot host is counted with partial sums, and the hashes of templates are joined to pages by page, never gathered by host.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellgrove.llm.common import small_batches, written

MIN_PAGES, SHARE, COPIED = 5, 0.3, 0.5

# Element names by what HTML does with them, and names that sites give to what is no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("script style noscript template head nav footer aside form button select textarea option input iframe object embed svg canvas dialog menu audio video map label".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: An opening tag closes the nearest open element of its group, unless one of the names after it is nearer.
CLOSED = {"p": "p", "li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
STOPS = {
    "p": "td th table button object body html article section div li", "li": "ul ol menu", "dt": "dl", "tr": "table", "td": "table tr", "option": "select",
}
CLOSES_P = BLOCK - frozenset("body head html title td th tr tbody thead tfoot li dd dt legend summary figcaption".split())
NAMES = re.compile(r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|sponsor\w*|promo\w*|banner\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscri\w*|signup|sidebar\w*|side|menu\w*|nav|navbar|navigation|breadcrumb\w*|header|masthead|topbar|footer\w*|foot|copyright|legal|comment\w*|disqus|replies|respond|share|sharing|social|related|recommend\w*|widget\w*|toolbar|pagination|pager|skip|login|search)(?=$|[\s_-])", re.I)
INNER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsored|comments?|disqus|respond)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())

#: One step over markup; possessive throughout, so that no text makes it go back.
TAG = re.compile(r"""<(?:!--(?:.*?-->|.*)|(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|$)|(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+)(?:>|$))""", re.S)
ATTR = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
GAPS = re.compile(r"\s+")

GROUPS = tuple(STOPS)
#: What an element's start does to the nearest open element of each group: its own place, or none.
SETS = {name: tuple(k for k, g in enumerate(GROUPS) if CLOSED.get(name) == g) for name in CLOSED}
CUTS = {name: tuple(k for k, g in enumerate(GROUPS) if name in STOPS[g].split()) for name in {x for s in STOPS.values() for x in s.split()}}


class Element:
    """An open element: ``near`` are the places of the nearest open elements of each group, ``first`` the number of blocks before it."""

    __slots__ = ("name", "names", "dropped", "digests", "zone", "article", "first", "around", "near")

    def __init__(self, name: str, names: str, dropped: bool, zone: bool, article: bool, first: int, near: tuple[int, ...]):
        self.name, self.names, self.dropped, self.zone, self.article, self.first, self.near = name, names, dropped, zone, article, first, near
        self.digests: list[str] = []
        self.around = False


class Page:
    """One pass over a page. ``hashes``: of subtrees, with the hash of the nearest article or main that they stand in, or None. ``articles``: these hashes. ``text()``: main text, without the subtrees whose hash is in ``template``."""

    def __init__(self, source: str, template: frozenset[int] = frozenset()):
        self.template = template
        self.stack = [Element("", "", False, False, False, 0, (-1,) * len(GROUPS))]
        self.opened: Counter = Counter()
        self.inner: list[list[int]] = []  # hashes inside each open article or main
        self.blocks: list[tuple[bool, str]] = []  # in the zone, text
        self.recurs: tuple[list, list] = ([], [])  # runs of blocks that are template, outside and inside the zone
        self.open: list[str] = []
        self.hashes: set[tuple[int, int | None]] = set()
        self.articles: set[int] = set()
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            m = None
            while lt >= 0 and not (m := TAG.match(source, lt)):
                lt = source.find("<", lt + 1)  # no tag begins here
            if not m:
                self._text(source[at:])
                break
            if lt > at:
                self._text(source[at:lt])
            at = m.end()
            if not m[2]:
                continue
            if source[at - 1] != ">":
                self._text(source[lt:])
                break
            name = m[2].lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                stop = end.start() if end else n
                if name in ("title", "textarea"):
                    self._text(source[at:stop])
                else:
                    self.stack[-1].digests.append(source[at:stop])
                at = source.find(">", stop) + 1 if end else n
                at = at or n
                self._end(name)
        while len(self.stack) > 1:
            self._pop()
        self._flush()

    def _text(self, raw: str) -> None:
        top = self.stack[-1]
        if "&" in raw:
            raw = html.unescape(raw)
        top.digests.append(raw)
        if not top.dropped:
            self.open.append(raw)

    def _flush(self) -> None:
        if self.open:
            text = GAPS.sub(" ", "".join(self.open)).strip()
            self.open = []
            if text:
                self.blocks.append((self.stack[-1].zone, text))

    def _start(self, name: str, attrs: str) -> None:
        stack = self.stack
        if name in CLOSES_P:
            self._close(0)
        for k in SETS.get(name, ()):
            self._close(k)
        if name in BLOCK:
            self._flush()
        parent = stack[-1]
        if name in VOID:
            if name == "br" and not parent.dropped:
                self.open.append(" ")
            parent.digests.append(f"<{name}>")
            return
        found: dict[str, str] = {}
        if attrs and not attrs.isspace():
            for k, a, b, c in ATTR.findall(attrs):
                found.setdefault(k.lower(), html.unescape(a or b or c))
        names = f"{found.get('class', '')} {found.get('id', '')}".strip()
        dropped = parent.dropped or name in DROPPED or (name == "header" and not parent.zone) or found.get("role", "").lower() in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
        if names and not dropped and name not in ("body", "html", "article", "main"):
            if parent.article:
                dropped = bool(INNER.search(names))
            else:  # a main's own header stays
                dropped = any(not parent.zone or m[0].strip(" _-").lower() != "header" for m in NAMES.finditer(names))
        article = parent.article or (name == "article" and not dropped)
        zone = parent.zone or (name in ("article", "main") and not dropped)
        if name in ("article", "main") and not dropped:
            self.inner.append([])
        near = parent.near
        if name in SETS or name in CUTS:
            own = list(near)
            for k in CUTS.get(name, ()):
                own[k] = -1
            for k in SETS.get(name, ()):
                own[k] = len(stack)
            near = tuple(own)
        stack.append(Element(name, names, dropped, zone, article, len(self.blocks), near))
        self.opened[name] += 1

    def _close(self, group: int) -> None:
        k = self.stack[-1].near[group]
        while k > 0 and len(self.stack) > k:
            self._pop()

    def _end(self, name: str) -> None:
        if self.opened[name]:
            while self._pop() != name:
                pass

    def _pop(self) -> str:
        name = self.stack[-1].name
        if name in BLOCK:
            self._flush()
        own, parent = self.stack.pop(), self.stack[-1]
        self.opened[name] -= 1
        article = name in ("article", "main") and own.zone and not own.dropped
        body = GAPS.sub(" ", "\x00".join(own.digests))
        digest = xxhash.xxh64_intdigest(f"{name}\x01{own.names}\x01{body}".encode("utf-8", "replace"), 2 if own.zone else 1)
        digest -= (digest >> 63) << 64
        parent.digests.append(str(digest))
        if own.around or article:
            parent.around = True
        if article:
            self.articles.add(digest)
            self.hashes.update((x, digest) for x in self.inner.pop())
        elif not own.around and name in BLOCK and name not in ("html", "body"):
            if own.zone and self.inner:
                self.inner[-1].append(digest)
            else:
                self.hashes.add((digest, None))
            if digest in self.template and not own.dropped and own.first < len(self.blocks):
                self.recurs[own.zone].append((own.first, len(self.blocks)))
        return name

    def text(self) -> str:
        zone = any(z for z, _ in self.blocks)
        own = np.array([z == zone for z, _ in self.blocks], bool)
        gone = np.zeros(len(self.blocks), bool)
        apart = end = 0  # subtrees that stand in no other
        for first, last in sorted(self.recurs[zone], key=lambda x: (x[0], -x[1])):
            if last > end:
                gone[first:last] = True
                apart, end = apart + 1, last
        gone &= own
        if gone.any():
            size = np.array([len(t) for _, t in self.blocks])
            part = size[gone].sum() / size[own].sum()
            if (zone and apart > 1 and part > COPIED) or part == 1:
                gone[:] = False
        return "\n".join(t for (_, t), keep in zip(self.blocks, own & ~gone) if keep)


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def rows_of(page: Page, body: int) -> list[tuple[int | None, int, bool]]:
    """(subtree, holder, whether that is an article): a page's subtrees with what they stand in; rows without a subtree are the holders themselves."""
    rows = [(None, a, True) for a in page.articles] + [(None, body, False)]
    return rows + [(d, body if a is None else a, a is not None) for d, a in page.hashes]


def site_templates(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> tuple[DataFrame, DataFrame]:
    """((host, digest, n) of the sites' template subtrees, (key, body, digest) of the pages that hold them; ``body`` is the xxhash64 of a page)."""
    small_batches(pages.sparkSession)
    own = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("_host"), F.xxhash64(source).alias("_body"), source)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rows_of(Page(s), b) if s else [] for s, b in zip(batch.column(3).to_pylist(), batch.column(2).to_pylist())]
            which = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            digest, holder, inside = zip(*(r for x in found for r in x)) if which else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(which) for i in range(3)), pa.array(digest, pa.int64()), pa.array(holder, pa.int64()), pa.array(inside, pa.bool_())], ["_key", "host", "body", "digest", "holder", "inside"])

    kind = own.schema["_key"].dataType.simpleString()
    seen = written(own.mapInArrow(run, f"_key {kind}, host string, body long, digest long, holder long, inside boolean"))
    each = seen.groupBy("host", "digest", "inside", "holder").agg(F.lit(1).alias("one"))
    counts = written(each.groupBy("host", "digest", "inside").agg(F.count("*").alias("n")))
    holders = counts.filter("digest is null").select("host", "inside", (F.col("n") * share).alias("least"))
    often = counts.filter(F.col("digest").isNotNull() & (F.col("n") >= min_pages))
    template = written(often.join(holders, ["host", "inside"]).filter("n >= least").select("host", "digest", "n"))
    held = seen.join(template.select("host", "digest"), ["host", "digest"], "left_semi")
    return template, held.select(F.col("_key").alias(key), "body", "digest")


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE) -> DataFrame:
    """(key, url, text) of every page."""
    _, held = site_templates(pages, key, url, source, min_pages, share)
    per_page = written(held.groupBy(F.col(key).alias("_key"), F.col("body").alias("_body")).agg(F.collect_set("digest").alias("_template")))
    own = pages.select(F.col(key).alias("_own"), F.col(url).alias("_url"), F.col(source).alias("_html"))
    joined = own.join(per_page, own["_own"].eqNullSafe(per_page["_key"]) & (F.xxhash64("_html") == per_page["_body"]), "left").select("_own", "_url", "_html", "_template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(s, frozenset(t or ())).text() if s else "" for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], [key, url, "text"])

    kind = pages.schema[key].dataType.simpleString()
    return joined.mapInArrow(run, f"`{key}` {kind}, `{url}` string, text string")
