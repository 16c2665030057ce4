"""Main text of web pages, with site templates removed: every element's subtree is hashed,
Spark counts on how many pages of a host each hash occurs, and subtrees that recur
across many pages of the host go. What markup itself names as no article (menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) goes too.

A recurring subtree outside the article goes from OUTSIDE of the host's pages on, one
inside of it from INSIDE on, as articles may share a sentence.

Edge cases. Null html is an empty page; a null url or one without a host has no site, so
only markup is judged. Cut-off pages are closed at their end. Pages of a host with the
same text, digits aside, count as one page, so copies make no template of their article.
Pages without article or main element use their whole body, less lists of
links. Very long pages are parsed whole, in time and memory linear in their length, however
broken they are. Repeated rows are extracted row by row. Empty tables give empty results; only
the three named columns are read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Workspace
from .op01_url_filter import host_path

#: (least pages, least share of the host's pages)
OUTSIDE, INSIDE = (3, 0.1), (8, 0.6)

# Element names by role.
DROPPED = frozenset("nav header footer aside form script style noscript template svg math button select option textarea iframe object canvas dialog menu head title audio video map datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCKS - {"br", "option", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "head", "html", "body"}
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
SCOPES = frozenset("table ul ol dl select".split())
# Words of a class or id, and roles, that name what is no article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense promo promotion sponsor sponsored sponsors banner cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay newsletter subscribe subscription signup share sharing social sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs header masthead topbar footer comment comments commentlist respond disqus related recommended recommendations pagination pager "
    "widget widgets toolbar skip login search paywall disclaimer".split()
)
# Words that say nothing of what a part is; inside an article a name must hold no others beside those above.
PLAIN = frozenset(
    "area article bar block body bottom box btn button buttons card center column container content entry feed form group holder icon icons inline inner item items "
    "left link links list main mobile module more outer page panel placeholder post posts region right row section site slot small stories story text title top unit wrap wrapper zone".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: The start of a comment, a declaration, or a whole tag: with quotes, or without regard to them. Nothing is tried twice.
_quoted = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)(?:((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(>))?+")
_unquoted = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)(?:([^>]*+)(>))?+")
_attribute = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_digits = re.compile(r"\d+")


class Node:
    __slots__ = ("children", "dropped", "hash", "header", "length", "linked", "tag")

    def __init__(self, tag: str, dropped: bool = False) -> None:
        self.tag, self.dropped, self.children = tag, dropped, []
        self.hash = self.length = self.linked = 0
        self.header = False


#: Off only to measure what templates alone find.
USE_NAMES = True


def named_out(tag: str, attributes: str, inside: bool = False) -> bool:
    """Do the element's name, class, id or role say that it is no article? Inside an article a part of a
    name is not enough: `share-prices` or `search-engines` may be what it is about, `share-buttons` is not."""
    if not USE_NAMES:
        return tag in ("script", "style", "head", "noscript", "template")
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(attributes)} if attributes else {}
        words = _part.findall(found.get("class", "") + " " + found.get("id", ""))
        return tag == "article" and any(w.lower() in ("comment", "comments", "related", "ad", "ads", "advert", "sponsored", "promo") for w in words)
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role", "").lower() in ROLES:
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "")):
        return True
    names = found.get("class", "") + " " + found.get("id", "")
    if not inside:
        return any(w.lower() in NAMES for w in _part.findall(names))
    return any((words := {w.lower() for w in _part.findall(name)}) & NAMES and words <= NAMES | PLAIN for name in names.split())


def is_header(tag: str, attributes: str) -> bool:
    """A header by its own name, or by nothing but that word in class or id."""
    if tag == "header":
        return True
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _attribute.finditer(attributes)}
    words = {w.lower() for w in _part.findall(found.get("class", "") + " " + found.get("id", ""))}
    return words & NAMES == {"header"} and "hidden" not in found


class Open:
    """The stack of open elements, with the places of each name and of blocks in it, so that nothing walks the stack."""

    def __init__(self, root: Node) -> None:
        self.stack, self.places, self.blocks = [root], {}, []

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        if node.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int) -> None:
        """Ends all elements from place k on."""
        for node in reversed(self.stack[k:]):
            self.places[node.tag].pop()
            if node.tag in BLOCKS:
                self.blocks.pop()
        del self.stack[k:]

    def last(self, tag: str) -> int:
        own = self.places.get(tag)
        return own[-1] if own else 0

    def end(self, tag: str) -> bool:
        """An end tag; an inline one doesn't end a block around it."""
        k = self.last(tag)
        if k and (tag in BLOCKS or not self.blocks or k > self.blocks[-1]):
            self.cut(k)
        return k > 0

    def before(self, tag: str) -> None:
        """What a start tag ends: an open paragraph, and siblings up to the list or table around them."""
        if tag in CLOSES_P and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in SIBLINGS:
            scope = max(map(self.last, SCOPES))
            found = [own[i] for own in map(self.places.get, SIBLINGS[tag]) if own and (i := bisect_right(own, scope)) < len(own)]
            if found:
                self.cut(min(found))


def parse(page: str) -> Node:
    """A tree of elements and strings, in time linear in the page. Optional end tags are supplied; what is
    left open ends with the page. Where quotes never close, a tag ends at the next >."""
    root = Node("#root")
    opened = Open(root)
    at, end, token = 0, len(page), _quoted
    while at < end:
        m = token.search(page, at)
        if m is None:
            opened.stack[-1].children.append(entities.unescape(page[at:]))
            break
        if m[2] and not m[4]:
            token = _unquoted
            m = token.match(page, m.start())
        start, stop, tag = m.start(), m.end(), m[2]
        if start > at:
            opened.stack[-1].children.append(entities.unescape(page[at:start]))
        if tag is None:
            close = "-->" if m[0] == "<!--" else ">"
            k = page.find(close, stop)
            at = k + len(close) if k >= 0 else end
            continue
        if not m[4]:
            break  # a tag cut off by the page's end is no text
        at = stop
        tag, attributes = tag.lower(), m[3]
        if m[1]:
            if not opened.end(tag) and tag == "br":
                opened.stack[-1].children.append(Node("br"))
            continue
        opened.before(tag)
        node = Node(tag, named_out(tag, attributes, opened.last("article") > 0))
        node.header = node.dropped and is_header(tag, attributes)
        opened.stack[-1].children.append(node)
        if tag in VOID or attributes.endswith("/") and tag not in BLOCKS:
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            node.children.append(page[at : close.start()] if close else page[at:])
            at = (page.find(">", close.end()) + 1 or end) if close else end
            continue
        opened.push(node)
    return root


def _post_order(root: Node) -> Iterator[Node]:
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        out.append(n)
        todo += [c for c in n.children if isinstance(c, Node)]
    return reversed(out)


def hash_subtrees(root: Node) -> None:
    """Sets each element's hash (0: no text), text length and length of text in links. Digits count alike."""
    for n in _post_order(root):
        h = xxhash.xxh3_64(n.tag)
        n.length = n.linked = 0
        for c in n.children:
            if isinstance(c, Node):
                h.update(c.hash.to_bytes(8, "little"))
                n.length += c.length
                n.linked += c.linked
            else:
                s = " ".join(c.split())
                h.update(_digits.sub("0", s))
                n.length += len(s)
        if n.tag == "a":
            n.linked = n.length
        n.hash = h.intdigest() if n.length else 0


def _signed(h: int) -> int:
    return h - (1 << 64) if h >= 1 << 63 else h


def subtree_hashes(page: str) -> tuple[int, set[int]]:
    """The hash of the page's text before templates go, alike for copies, and those of its subtrees."""
    root = parse(page)
    hash_subtrees(root)
    content = xxhash.xxh3_64_intdigest(_digits.sub("0", _text(root)))
    return _signed(content), {_signed(n.hash) for n in _post_order(root) if n.hash and not n.dropped and n.tag not in ("#root", "html", "body", "b", "i", "em", "strong", "a", "span")}


def _articles(root: Node) -> list[Node]:
    """The outermost articles that aren't in a dropped element, else main elements, else
    those that only a class or id around them drops; in page order."""
    for strict in (True, False):
        for wanted in ("article", "main"):
            found, todo = [], [root]
            while todo:
                n = todo.pop()
                if n.tag == wanted and not n.dropped:
                    found.append(n)
                    continue
                todo += [c for c in reversed(n.children) if isinstance(c, Node) and not (c.dropped and (strict or c.tag in DROPPED))]
            if found:
                return found
    return []


def _collect(top: Node, gone: set[int], whole_body: bool) -> list[str]:
    """The text pieces below top, with spaces at block ends."""
    out: list[str] = []
    todo: list = [(top, False)]
    while todo:
        n, headings = todo.pop()
        if isinstance(n, str):
            if not headings:
                out.append(n)
            continue
        if n is not top:
            if n.dropped:
                # a header inside an article may hold its headings
                if not whole_body and n.header and not headings:
                    headings = True
                else:
                    continue
            elif headings and n.tag in HEADINGS:
                headings = False
            if n.hash and _signed(n.hash) in gone:
                continue
            if whole_body and n.tag in ("ul", "ol", "table", "div", "p") and n.length and n.linked > 0.7 * n.length:
                continue
        if n.tag in BLOCKS:
            out.append(" ")
            todo.append((" ", False))
        todo += [(c, headings) for c in reversed(n.children)]
    return out


def _text(root: Node, outside=(), inside=()) -> str:
    tops = _articles(root)
    pieces: list[str] = []
    for top in tops or [root]:
        pieces += [" ", *_collect(top, set(inside) if tops else set(outside), not tops), " "]
    return " ".join("".join(pieces).split())


def main_text(page: str | None, outside=(), inside=()) -> str:
    """The article's text; outside and inside: hashes of subtrees that are templates there."""
    root = parse(page or "")
    hash_subtrees(root)
    return _text(root, outside, inside)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", outside=OUTSIDE, inside=INSIDE) -> DataFrame:
    """page_id, url, host, text and n_chars. The pages are read twice and not shuffled:
    only (host, hash, hash of the page's text) are. A host has few templates, each on a set share of its
    pages at least; their table is broadcast while it is proven small, else joined by host."""
    own = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    own = own.withColumn("host", host_path(F.col("url"))[0])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            hosts, subs, contents = [], [], []
            for host, page in zip(df["site"], df["html"], strict=True):
                content, found = subtree_hashes(page if isinstance(page, str) else "")
                hosts += [host] * (len(found) + 1)
                subs += [0, *found]
                contents += [content] * (len(found) + 1)
            yield pd.DataFrame({"site": pd.Series(hosts, dtype="int64"), "sub": pd.Series(subs, dtype="int64"), "content": pd.Series(contents, dtype="int64")})

    sited = own.where(F.col("host") != "").select(F.xxhash64("host").alias("site"), "html")
    # copies of a page add one: they meet in (site, sub, content), at first where they are parsed
    found = sited.mapInPandas(count, "site long, sub long, content long").distinct()
    counts = found.groupBy("site", "sub").count().where(F.col("count") >= min(outside[0], inside[0]))
    # written once, as two branches read it, and the pages are parsed for it
    ws = Workspace(pages.sparkSession, "html")
    counts = ws.write(counts, "counts")
    # sub 0 stands for the host's pages
    per_site = counts.groupBy("site").agg(F.max(F.when(F.col("sub") == 0, F.col("count"))).alias("pages"))
    often = lambda least: (F.col("count") >= least[0]) & (F.col("count") >= least[1] * F.col("pages"))
    template = counts.where(F.col("sub") != 0).join(per_site, "site").where(often(outside) | often(inside))
    lists = template.groupBy("site").agg(
        F.collect_list(F.when(often(outside), F.col("sub"))).alias("outside"), F.collect_list(F.when(often(inside), F.col("sub"))).alias("inside"), F.count("*").alias("n")
    )
    lists = ws.write(lists, "templates")
    ws.drop("counts")
    total = lists.agg(F.sum("n")).first()[0] or 0
    lists = lists.select(F.col("site").alias("__site"), "outside", "inside")
    if total <= BROADCAST_ROWS:
        lists = F.broadcast(lists)

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for page, out, ins in batches:
            yield pd.Series([main_text(p if isinstance(p, str) else "", () if o is None else o, () if i is None else i) for p, o, i in zip(page, out, ins, strict=True)], dtype="object")

    site = F.when(F.col("host") != "", F.xxhash64("host"))
    joined = own.withColumn("site", site).join(lists, F.col("site") == F.col("__site"), "left")
    return joined.select("page_id", "url", "host", run("html", "outside", "inside").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir):
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
