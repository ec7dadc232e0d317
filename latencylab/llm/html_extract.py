"""Main text of web pages by deducing the template that same-host pages share.

A page is a sequence of tokens, each with its role: a tag under its path of containers, or a whole text
under its path. Over the distinct pages of a host every token has an occurrence vector, how often
it is on each page; tokens with equal vectors form an equivalence class. The vector is kept as
(pages, occurrences, xor of a hash of page and count), which combines map-side, so a host with a third of
all pages is no large group. Classes that nearly all of the host's pages have nest by their containers: a class lies
in the slot that a tag of its parent class opens. On a page, a class is valid if its tokens come in the template's order and
its parent is valid. Texts between the tags are in slots, named by the containers around them. A slot's text is main
text unless it is in a menu, header, footer, sidebar, notice, advert, form, script, style or reader
comments, by its elements, roles and names. On every page, texts that are themselves tokens of a valid class are template and dropped, as are slots that hold
mostly links over all pages of the host and are in no article; inside a line with other text only a text that each page has once is dropped, so
a sentence keeps its common words between inline tags. Of the slots that remain, those in articles are the main text if they hold a fair share of it.

Templates are bounded by a page's size (a token is on ``SUPPORT`` of the pages). Together they are broadcast
where they are measured to be at most ``BROADCAST_TOKENS`` tokens, else joined to the pages by host.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.llm.blocks import scratch

SUPPORT = 0.8  # share of a host's distinct pages that have the tokens of a valid class
MIN_PAGES = 10  # distinct pages a host needs before constant text counts as template
BROADCAST_TOKENS = 500_000
ARTICLE_SHARE = 0.25  # of the text that is left, from which on the articles are the main text

# Elements of HTML by kind.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe svg textarea select noframes".split())
OUTSIDE = frozenset("head title nav footer aside form menu dialog button search datalist".split())
CLOSED_BY = {  # an open element of the first kind ends where one of the second starts
    "p": BLOCKS - {"body", "html"},
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
    "head": frozenset(["body"]),
}
# Words of class names and ids: those of boilerplate, and those that only say where or how it is shown. A name is evidence of
# boilerplate if it has one of the first kind and all its words are of these two kinds: "site-header" is, "entry-header" and "side-effects" are not.
BOILERPLATE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner banners breadcrumb breadcrumbs comment comments consent cookie cookies copyright "
    "disclaimer disqus footer footnav header masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications alert "
    "alerts pager pagination paywall popup promo promos promotion related replies reply share sharing shares side sidebar sidenav signup skip skyscraper "
    "social sponsor sponsored sponsors subscribe subscription toolbar topbar widget widgets login search form".split()
)
LAYOUT = frozenset(
    "site page main top bottom left right global inner outer wrap wrapper container box block area section region list item items bar link links col column "
    "row primary secondary slot unit title button buttons btn icon icons message overlay panel group holder posts articles stories content "
    "respond thread policy gdpr mobile desktop sticky fixed large small media us this tools results field input".split()
)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
# Elements whose names are no evidence: headings and the parts of running text.
PROSE = frozenset("html body main p h1 h2 h3 h4 h5 h6 hgroup blockquote pre figure figcaption td th em strong b i u q cite code sub sup mark math".split())
# Names that speak of a page around its articles, not of what the articles are: an article inside is main text again.
AROUND = BOILERPLATE - frozenset("ad ads adv advert adverts advertisement advertising adsense comment comments disqus replies reply related promo promos promotion sponsor sponsored sponsors".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar status note".split())
TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
BLANK = re.compile(r"\s+")


class Node:
    """A text with its path of containers, block number, where the path places it, and its position among all tokens."""

    __slots__ = ("path", "block", "text", "outside", "article", "link", "at")

    def __init__(self, path, block, text, outside, article, link, at):
        self.path, self.block, self.text, self.outside, self.article, self.link, self.at = path, block, text, outside, article, link, at


class Tag(NamedTuple):
    """A tag token: its path and name, the path it stands in, the path it opens (or None), its position."""

    token: str
    path: str
    opens: str | None
    at: int


def _named(names: str, words: frozenset = BOILERPLATE) -> bool:
    """Whether one of the names is evidence of boilerplate."""
    for name in names.split():
        parts = [w.lower() for w in WORD.findall(name)]
        if any(w in words for w in parts) and all(w in BOILERPLATE or w in LAYOUT or w.isdigit() for w in parts):
            return True
    return False


# What an element is to the main text: part of it, boilerplate by a name that articles inside overrule, or boilerplate.
INSIDE, BY_NAME, OUT = 0, 1, 2


def _kind(tag: str, attrs: str, in_article: bool) -> tuple[str, int, bool]:
    """Label of a container for paths, what it is to the main text, whether it is an article."""
    got = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in ATTR.finditer(attrs)} if attrs else {}
    names = " ".join(entities.unescape(got[a]) for a in ("class", "id") if a in got)
    role = got.get("role", "").lower()
    hidden = "hidden" in got or got.get("aria-hidden", "").lower() == "true" or "display:none" in got.get("style", "").replace(" ", "").lower()
    state = INSIDE
    if hidden or tag in OUTSIDE or role in ROLES or (tag == "header" and not in_article):
        state = OUT
    elif names and tag == "article":
        state = OUT if re.search(r"comment|reply|related|sponsor|promo|teaser|advert", names, re.I) else INSIDE
    elif names and tag not in PROSE and _named(names):
        state = BY_NAME if _named(names, AROUND) else OUT
    article = tag in ("article", "main") or role in ("main", "article")
    label = tag + "".join("." + x for x in names.split()) if tag not in ("html", "body") else tag
    return label, state, article


class _Open:
    """The open elements: [tag, path, state, article, link] each, with the positions of those that searches look for, so
    that a search does not walk through thousands of unclosed elements. A path is the hash of its containers."""

    def __init__(self):
        self.stack: list[list] = [["", "", INSIDE, False, False]]
        self.of: dict[str, list[int]] = {}  # positions of each tag
        self.solid: list[int] = []  # positions of block elements

    def push(self, entry: list) -> None:
        self.of.setdefault(entry[0], []).append(len(self.stack))
        if entry[0] in BLOCKS or entry[0] in CLOSED_BY:
            self.solid.append(len(self.stack))
        self.stack.append(entry)

    def cut(self, at: int) -> None:
        for entry in reversed(self.stack[at:]):
            self.of[entry[0]].pop()
        while self.solid and self.solid[-1] >= at:
            self.solid.pop()
        del self.stack[at:]

    def last(self, *tags: str) -> int:
        return max((self.of[t][-1] for t in tags if self.of.get(t)), default=0)

    def end(self, tag: str) -> None:
        """An end tag closes up to its element; a stray inline end tag closes no container."""
        at = self.last(tag)
        if at and (tag in BLOCKS or at >= self.last("article", "main", "body", "table")):
            self.cut(at)

    def start(self, tag: str) -> None:
        """A start tag ends the open elements that cannot hold it."""
        if tag not in CLOSERS:
            return
        while self.solid:
            i = self.solid[-1]
            one = self.stack[i][0]
            if one in CLOSED_BY and tag in CLOSED_BY[one]:
                self.cut(i)
            else:
                return  # any other block holds it


CLOSERS = frozenset().union(*CLOSED_BY.values())


def parse(page: str) -> tuple[list[Tag], list[Node]]:
    """Tag tokens and texts of a page, in page order. Unclosed and stray tags are tolerated; time and memory follow the
    page's length, however deep it nests."""
    tags: list[Tag] = []
    nodes: list[Node] = []
    opened = _Open()
    stack = opened.stack
    block = 0
    at, n = 0, len(page)

    def text(a: int, b: int) -> None:
        s = page[a:b]
        if s and not s.isspace():
            _, path, state, article, link = stack[-1]
            nodes.append(Node(path, block, entities.unescape(s), state != INSIDE, article, link, len(tags) + len(nodes)))
        elif s and nodes and nodes[-1].block == block:
            blank()

    def blank() -> None:
        _, path, state, article, link = stack[-1]
        nodes.append(Node(path, block, " ", state != INSIDE, article, link, len(tags) + len(nodes)))

    def token(sign: str, opens: str | None = None) -> None:
        tags.append(Tag(stack[-1][1] + sign + tag, stack[-1][1], opens, len(tags) + len(nodes)))

    while at < n:
        lt = page.find("<", at)
        m = TAG.match(page, lt) if lt >= 0 else None
        while lt >= 0 and not m:  # a lone "<" is text
            lt = page.find("<", lt + 1)
            m = TAG.match(page, lt) if lt >= 0 else None
        if not m:
            text(at, n)
            break
        text(at, lt)
        at = m.end()
        close, tag, attrs = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            blank()
            continue
        if tag in BLOCKS:
            block += 1
        if close:
            token("</")
            opened.end(tag)
            continue
        opened.start(tag)
        if tag in RAW:
            token("<")
            end = re.compile(rf"</{re.escape(tag)}\s*>?", re.I).search(page, at)
            at = end.end() if end else n
            if end and at < n and page[at - 1] != ">":
                gt = page.find(">", at)
                at = gt + 1 if gt >= 0 else n
            continue
        if tag in VOID or (attrs or "").rstrip().endswith("/") and tag not in BLOCKS:
            token("<")
            continue
        _, path, state, article, link = stack[-1]
        label, own, is_article = _kind(tag, attrs, article)
        inner = path if tag not in BLOCKS or tag in ("p", "li") and not attrs else xxhash.xxh3_64_hexdigest(path + "/" + label)
        token("<", inner if inner != path else None)
        if is_article and state == BY_NAME:
            state = INSIDE
        opened.push([tag, inner, max(state, own), article or is_article, link or tag == "a"])
    return tags, nodes


def host_of(url: str | None) -> str:
    """Host of a URL, lower case, without port; empty if there is none."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _text_token(path: str, s: str) -> str:
    return path + "\x00" + BLANK.sub(" ", s).strip()


def _hash(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s) - (1 << 63)


def page_tokens(page: str) -> list[tuple]:
    """Distinct tokens of a page: (token, kind, count, mean position, path, opened path or None, characters, of them in links)."""
    tags, nodes = parse(page)
    found: dict[tuple[str, str], list] = {}
    for t in tags:
        x = found.setdefault((t.token, "tag"), [0, 0, t.path, t.opens, 0, 0])
        x[0] += 1
        x[1] += t.at
    for node in nodes:
        if not node.text.isspace():
            x = found.setdefault((_text_token(node.path, node.text), "text"), [0, 0, node.path, None, 0, 0])
            x[0] += 1
            x[1] += node.at
            x[4] += len(node.text)
            x[5] += len(node.text) * node.link
    return [(t, kind, n, at / n, path, opens, chars, linked) for (t, kind), (n, at, path, opens, chars, linked) in found.items()]


TOKENS = "host string, page long, token long, kind string, count long, at double, path long, opens long, chars long, linked long"


def _tokens(batches):
    """Each page's tokens, hashed, with its host and the hash of its content."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), *[pa.int64()] * 4]
    for batch in batches:
        out: list[tuple] = []
        hashes: dict[str, int] = {}
        for url, page in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist()):
            page = page or ""
            host, digest = host_of(url), _hash(page)
            for token, kind, count, at, path, opens, chars, linked in page_tokens(page):
                for p in (path, opens):
                    if p is not None and p not in hashes:
                        hashes[p] = _hash(p)
                out.append((host, digest, _hash(token), kind, count, at, hashes[path], hashes.get(opens), chars, linked))
        cols = list(zip(*out)) if out else [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], [c.split()[0] for c in TOKENS.split(", ")])


def _digests(batches):
    """(host, page content) of each page."""
    for batch in batches:
        hosts = [host_of(u) for u in batch.column("url").to_pylist()]
        digests = [_hash(p or "") for p in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64())], ["host", "page"])


def templates(pages: DataFrame, support: float = SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, template, slots) of hosts with at least ``min_pages`` distinct pages; equal pages count once.

    ``template``: the equivalence classes of the tokens on at least ``support`` of the host's pages, as (pages, total,
    members (at, kind, token, path, opens) in mean page order); a class has two tokens or is one text. ``slots``: characters
    and linked characters, over all pages, of the texts right in each container that a template tag opens.
    """
    each = pages.select("url", "html").mapInArrow(_tokens, TOKENS)
    once = each.groupBy("host", "page", "token", "kind", "path", "opens").agg(*[F.max(c).alias(c) for c in ("count", "at", "chars", "linked")])
    vector = once.groupBy("host", "token", "kind", "path", "opens").agg(
        F.count(F.lit(1)).alias("pages"), F.sum("count").alias("total"), F.expr("bit_xor(xxhash64(page, count))").alias("vector"), F.avg("at").alias("at"),
        F.sum("chars").alias("chars"), F.sum("linked").alias("linked"),
    )
    distinct = pages.select("url", "html").mapInArrow(_digests, "host string, page long").groupBy("host", "page").agg(F.lit(1).alias("one"))
    hosts = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    vector = scratch(pages.sparkSession, vector.join(hosts, "host"), "html-tokens")
    common = vector.filter(F.col("pages") >= support * F.col("n"))
    classes = common.groupBy("host", "pages", "total", "vector").agg(F.sort_array(F.collect_list(F.struct("at", "kind", "token", "path", "opens"))).alias("members"))
    valid = classes.filter((F.size("members") >= 2) | (F.col("members")[0]["kind"] == "text"))
    template = valid.groupBy("host").agg(F.collect_list(F.struct("pages", "total", "members")).alias("template"))
    opened = common.filter("opens is not null").select("host", F.col("opens").alias("path")).distinct()
    slot = vector.filter("kind = 'text'").groupBy("host", "path").agg(F.sum("chars").alias("chars"), F.sum("linked").alias("linked"))
    slots = slot.join(opened, ["host", "path"]).groupBy("host").agg(F.collect_list(F.struct("path", "chars", "linked")).alias("slots"))
    return template.join(slots, "host", "left")


class Template:
    """A host's nested classes, and the share of links in its slots."""

    def __init__(self, classes: list | None = None, slots: list | None = None):
        self.classes = [[(m["token"], m["kind"], m["path"], m["opens"]) for m in c["members"]] for c in classes or ()]
        opener = {m[3]: i for i, c in enumerate(self.classes) for m in c if m[3] is not None}
        self.parent = [opener.get(c[0][2], -1) for c in self.classes]
        self.texts = {m[0] for c in self.classes for m in c if m[1] == "text"}
        self.once = {m["token"] for c in classes or () if c["total"] == c["pages"] for m in c["members"]}
        self.links = {s["path"]: s["linked"] / s["chars"] for s in slots or () if s["chars"]}

    def constant_texts(self, tags: list[Tag], nodes: list[Node]) -> set[int]:
        """Hashes of the text tokens of the classes that are valid on a page."""
        if not self.texts:
            return set()
        first: dict[int, int] = {}
        for t in tags:
            first.setdefault(_hash(t.token), t.at)
        for x in nodes:
            first.setdefault(_hash(_text_token(x.path, x.text)), x.at)
        valid: dict[int, bool] = {-1: True}

        def check(i: int, seen: tuple = ()) -> bool:
            if i not in valid:
                at = [first.get(m[0]) for m in self.classes[i]]
                here = [x for x in at if x is not None]
                ok = len(here) == len(at) and here == sorted(here)
                valid[i] = ok and (self.parent[i] in (i, *seen) or check(self.parent[i], (*seen, i)))
            return valid[i]

        return {m[0] for i, c in enumerate(self.classes) if check(i) for m in c if m[1] == "text"}


def _without_template(nodes: list[Node], constant: set[int], once: set[int]) -> list[Node]:
    """Nodes without constant texts; in a block with other text only the constant texts that are once on each page go."""
    tokens = [_hash(_text_token(x.path, x.text)) for x in nodes]
    mixed = {x.block for x, t in zip(nodes, tokens) if t not in constant and not x.text.isspace()}
    return [x for x, t in zip(nodes, tokens) if t not in constant or x.block in mixed and t not in once]


def main_text(page: str, template: Template | None = None) -> str:
    """Main text of a page: its slots' texts, blocks joined by one line break."""
    tags, nodes = parse(page)
    template = template or Template()
    constant = template.constant_texts(tags, nodes)
    inside = [x for x in nodes if not x.outside]
    if constant:
        inside = _without_template(inside, constant, template.once)
    # links all over the host are a menu or a list of pages, but what an article lists is its own
    inside = [x for x in inside if x.article or template.links.get(_hash(x.path), 0.0) <= 0.5] if template.links else inside
    articles = [x for x in inside if x.article]
    size = lambda some: sum(len(x.text) for x in some if not x.text.isspace())
    if size(articles) >= ARTICLE_SHARE * size(inside) > 0:  # else they are teasers beside the main text
        inside = articles
    blocks: dict[int, list[str]] = {}
    for x in inside:
        blocks.setdefault(x.block, []).append(x.text)
    lines = (BLANK.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(s for s in lines if s)


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract_main_text(pages: DataFrame, support: float = SUPPORT, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages`` (page_id, url, html).

    Null or empty html has an empty text. Pages without a host in their url share the empty host. Equal rows give
    equal rows; broken markup is read as browsers do in the main. Columns beyond the three are
    not read; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    found = scratch(pages.sparkSession, templates(pages, support, min_pages), "html-templates")
    tokens = F.aggregate("template", F.lit(0), lambda n, c: n + F.size(c["members"])) + F.coalesce(F.size("slots"), F.lit(0))
    if (found.agg(F.sum(tokens)).first()[0] or 0) <= BROADCAST_TOKENS:
        known = {r["host"]: Template(r["template"], r["slots"]) for r in found.collect()}
        shared = pages.sparkSession.sparkContext.broadcast(known)

        def extract(batches):
            none = Template()
            for batch in batches:
                yield _extracted(batch, [shared.value.get(host_of(u), none) for u in batch.column("url").to_pylist()])

        return rows.mapInArrow(extract, EXTRACTED)

    def hosts_of(batches):
        for batch in batches:
            urls = batch.column("url").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(map(host_of, urls)), pa.string())], ["page_id", "url", "html", "_host"])

    def extract_joined(batches):
        for batch in batches:
            parsed: dict[str, Template] = {}  # of the batch's hosts
            for i, host in enumerate(batch.column("_host").to_pylist()):
                if host not in parsed:
                    parsed[host] = Template(batch.column("template")[i].as_py(), batch.column("slots")[i].as_py())
            yield _extracted(batch, [parsed[h] for h in batch.column("_host").to_pylist()])

    by_host = rows.mapInArrow(hosts_of, "page_id long, url string, html string, _host string")
    return by_host.join(found.withColumnRenamed("host", "_host"), "_host", "left").mapInArrow(extract_joined, EXTRACTED)


def _extracted(batch: pa.RecordBatch, known: list[Template]) -> pa.RecordBatch:
    texts = [main_text(page, t) if page else "" for page, t in zip(batch.column("html").to_pylist(), known)]
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    return pa.RecordBatch.from_arrays(
        [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["page_id", "url", "text", "n_chars"]
    )
