"""Main text of HTML pages: site templates found by counting element subtrees per host, then removed.

Pass one hashes every block element's subtree of every page, bottom-up from its children's hashes, and counts in Spark, for
each host, on how many pages it stands. A subtree that recurs on many of a host's pages is template. Pass two drops template
subtrees and, outside the article, elements that are by their tag, role, class or id not part of one (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, reader comments), keeps the article element, else main, else the
body, and writes out the text.

Inside the article the counts decide: names that occur in prose as well (search, copyright, responses) remove an element only
if elements opened alike stand on most pages of the host. Only a whole class, id or role that says advert or comments (``_SURE``)
needs no counting there.

A subtree outside the article counts as template from ``OUTSIDE`` of the host's pages on, one inside from ``INSIDE``, at
``LEAST_PAGES`` pages or more in both cases: copies of one article on a few pages are no template.

Counts are reduced before the shuffle, so a host with a third of all pages is no hot key. A host's templates are one row of
bounded size (a page of b blocks has at most b / OUTSIDE templates to share), which is joined to its pages.

Parsing takes time in proportion to the page: one forward pass; after the first quoted value that never ends, quotes are plain
characters; elements deeper than ``DEPTH`` become siblings.

Defined cases: null or empty html has the empty text; a page without the elements named is read from its body; broken and
unclosed markup is closed where HTML would close it; a null url is a host of its own; repeated rows are separate rows but
count as pages of their host; other columns are untouched.
"""

from __future__ import annotations

import html as html_
import re
import struct
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.session import ship

from .common import Scratch, materialise, schema_with, table

OUTSIDE, INSIDE, LEAST_PAGES = 0.2, 0.6, 5
#: Elements deeper than this are siblings of the last that is not.
DEPTH = 512

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*[\"']")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg".split())
_RAW_END = {tag: re.compile(f"</{tag}", re.I | re.A) for tag in _RAW}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_DROP = frozenset("head nav footer aside form script style noscript iframe svg template button select option textarea input object embed canvas audio video map dialog menu title noembed noframes xmp".split())
_HEADER = "header"
#: An opening tag closes these when they are open, up to one of the second set.
_CLOSES = {
    "p": (frozenset({"p"}), frozenset("div article section main body li td th blockquote aside header footer nav form button".split())),
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table", "tbody", "thead", "tfoot"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "option": (frozenset({"option"}), frozenset({"select"})),
}
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol pre section table ul".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Words of class, id and role that mark what is not the article.
_MARKS = frozenset(
    """ad ads advert adverts advertisement advertisements adsense adslot banner banners breadcrumb breadcrumbs byline-share comment comments
    commentlist consent contentinfo cookie cookies copyright disclaimer discussion disqus footer footers form gdpr hidden login masthead menu menus
    modal nav navbar navigation navmenu newsletter noprint notice notices notification notifications offcanvas overlay pager pagination paywall
    popup promo promos promotion reader-comments recommend recommended recommendations related replies reply respond rss search
    searchbox share sharing sharebar sidebar sidebars signup skip social sponsor sponsored sponsors subscribe subscription tagcloud tags
    toc toolbar topbar widget widgets alert alerts complementary dialog tooltip responses commentary""".split()
)
_COMPOUND = re.compile(r"side-?bar|comment|advert|cookie|newsletter|breadcrumb|share-?(?:bar|button|link)|nav-?bar|site-?(?:header|footer|nav)|page-?(?:header|footer)|global-?(?:header|footer)|social-?(?:media|link|share)|skip-?link|(?:^|\s)(?:ad|ads)-|-(?:ad|ads)(?:\s|$)")


#: What is an advert or reader comments wherever it stands, as a whole class, id or role.
_SURE = frozenset("ad ads advert advertisement comments commentlist comment-list reader-comments".split())


class Node:
    """An element; ``drop``: not wanted, ``maybe``: named like what is not wanted, inside an article."""

    __slots__ = ("tag", "drop", "maybe", "parts", "head", "inside", "hash")

    def __init__(self, tag: str, head: str, inside: bool):
        self.tag, self.head, self.inside, self.drop, self.maybe, self.hash = tag, head, inside, False, False, 0
        self.parts: list = []


def _judge(node: Node, attrs: str) -> None:
    tag, inside = node.tag, node.inside
    if tag in _DROP:
        node.drop = True
        return
    found = {}
    for m in _ATTR.finditer(attrs) if attrs else ():
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", "").lower()):
        node.drop = True
    elif not (tag in ("html", "body", "main") or tag == "article" and not inside):
        names = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
        named = bool(names) and (not _MARKS.isdisjoint(_SPLIT.split(names)) or bool(_COMPOUND.search(names)))
        if inside:
            node.drop, node.maybe = not _SURE.isdisjoint(names.split()), named
        else:
            node.drop = named or tag == _HEADER


def parse(source: str) -> tuple[Node, list[Node]]:
    """The tree, and its block elements."""
    root = Node("#", "", False)
    stack, blocks, at, n = [root], [], 0, len(source)
    last, quotes = source.rfind(">"), True
    opened: dict[str, int] = {}  # elements on the stack, and those too deep for it, by tag
    deep: dict[str, int] = {}

    def close(k: int) -> None:
        while len(stack) > k:
            opened[stack.pop().tag] -= 1

    while at < n:
        lt = source.find("<", at)
        if lt < 0 or lt > last and not source.startswith("<!--", lt):
            stack[-1].parts.append(source[at:])
            break
        if lt > at:
            stack[-1].parts.append(source[at:lt])
        m = _NAME.match(source, lt)
        if not m:
            if source.startswith("<!--", lt):
                end = _COMMENT_END.search(source, lt + 4)
                at = end.end() if end else n
            elif source[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = source.index(">", lt) + 1
            else:
                stack[-1].parts.append("<")
                at = lt + 1
            continue
        gt = m.end()
        while True:
            stop = _STOP.search(source, gt) if quotes else None
            if quotes and stop and stop[0] != ">":
                gt = source.find(stop[0][-1], stop.end()) + 1
                if gt:
                    continue
                stop = None
            if quotes and not stop:
                quotes = False
            break
        gt = stop.start() if quotes else source.find(">", m.end())
        if gt < 0:
            stack[-1].parts.append(source[lt:])
            break
        at, ending, tag, attrs = gt + 1, m[1], m[2].lower(), source[m.end() : gt]
        if ending:
            if deep.get(tag):
                deep[tag] -= 1
                stack[-1].parts.append("" if tag in _INLINE else " ")
            elif opened.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
            elif tag == "p":
                stack[-1].parts.append(" ")
            continue
        closes, until = _CLOSES.get(tag, (None, None))
        if tag in _ENDS_P and tag != "p":
            closes, until = _CLOSES["p"]
        if closes and any(opened.get(x) for x in closes):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    close(k)
                    if tag not in ("tr", "td", "th"):
                        break
                elif stack[k].tag in until:
                    break
        if tag in _VOID:
            stack[-1].parts.append("" if tag in _INLINE else " ")
            continue
        up = stack[-1]
        node = Node(tag, attrs, up.inside or up.tag in ("article", "main"))
        _judge(node, attrs)
        up.parts.append(node)
        if attrs.endswith("/") and tag in ("svg", "path", "use"):
            continue
        if tag in _RAW:
            end = _RAW_END[tag].search(source, at)
            stop_at = end.start() if end else n
            node.parts.append(source[at:stop_at] if tag not in ("script", "style") else "")
            after = source.find(">", stop_at)
            at = n if after < 0 else after + 1
            continue
        if tag not in _INLINE and tag not in ("html", "body"):
            blocks.append(node)
        if len(stack) > DEPTH:
            deep[tag] = deep.get(tag, 0) + 1
            continue
        stack.append(node)
        opened[tag] = opened.get(tag, 0) + 1
    return root, blocks


def hash_subtrees(root: Node) -> None:
    """Each node's hash, from its opening tag, its texts with white space levelled and its children's hashes."""
    order, todo = [], [root]
    while todo:
        x = todo.pop()
        order.append(x)
        todo += [p for p in x.parts if isinstance(p, Node)]
    for x in reversed(order):
        h = xxhash.xxh64(f"{x.tag} {' '.join(x.head.split())}".encode("utf-8", "surrogatepass"))
        for p in x.parts:
            if isinstance(p, Node):
                h.update(struct.pack("<cq", b"\0", p.hash))
            else:
                h.update(b"\1" + " ".join(p.split()).encode("utf-8", "surrogatepass"))
        x.hash = h.intdigest() - (1 << 63)


def opening(node: Node) -> int:
    """A hash of how an element is opened, whatever it holds."""
    return xxhash.xxh64_intdigest(f"<{node.tag} {' '.join(node.head.split())}".encode("utf-8", "surrogatepass")) - (1 << 63)


def text_of(root: Node) -> str:
    """Text in page order: blocks joined by one space, white space levelled, character references decoded."""
    keep = [root]
    for wanted in ("article", "main", "body"):
        found = []
        todo = [root]
        while todo:
            x = todo.pop()
            if x.drop:
                continue
            if x.tag == wanted:
                found.append(x)
            else:
                todo += [p for p in reversed(x.parts) if isinstance(p, Node)]
        if found:
            out = _flat(found)
            if out or wanted == "body":
                return out
    return _flat(keep)


def _flat(nodes: list[Node]) -> str:
    out: list[str] = []
    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(html_.unescape(x) if "&" in x else x)
        elif not x.drop:
            if x.tag in _INLINE:
                todo += reversed(x.parts)
            else:
                out.append(" ")
                todo.append(" ")
                todo += reversed(x.parts)
        elif x.tag not in _INLINE:
            out.append(" ")
    return " ".join("".join(out).split())


def host_of(url: Column) -> Column:
    """The host of a url, lower case; what is no absolute url stands for itself."""
    pattern = r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#\s]*@)?([^/?#\s@]*)"
    return F.when(url.rlike(pattern), F.lower(F.regexp_extract(url, pattern, 1))).otherwise(url)


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The columns of ``pages`` without the html in struct ``row``, and the main ``text``."""
    ship(pages.sparkSession)
    host = host_of(F.col(f"`{url}`").cast("string")).alias("host")

    def subtrees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from collections import Counter

        for b in batches:
            seen: Counter = Counter()
            for host, h in zip(b["host"], b["html"], strict=True):
                host = host if isinstance(host, str) else None
                seen[host, None, False] += 1
                if isinstance(h, str):
                    root, blocks = parse(h)
                    hash_subtrees(root)
                    found = {x.hash: x.inside or x.tag in ("article", "main") for x in blocks} | {opening(x): True for x in blocks if x.maybe}
                    seen.update((host, x, inside) for x, inside in found.items())
            yield pd.DataFrame({"host": [k[0] for k in seen], "hash": pd.array([k[1] for k in seen], dtype="Int64"), "inside": [k[2] for k in seen], "n": list(seen.values())})

    keep = Scratch()
    counted = pages.select(host, F.col(f"`{html}`").alias("html")).mapInPandas(subtrees, "host string, hash bigint, inside boolean, n bigint").groupBy("host", "hash", "inside").agg(F.sum("n").alias("n"))
    counted = keep.write(counted.where((F.col("n") >= LEAST_PAGES) | F.col("hash").isNull()), "pages-subtrees")
    totals = counted.where("hash is null").select(F.col("host").alias("host_"), F.col("n").alias("pages"))
    recurring = counted.where("hash is not null").join(totals, F.col("host").eqNullSafe(F.col("host_")))
    recurring = recurring.where(F.col("n") >= F.col("pages") * F.when(F.col("inside"), INSIDE).otherwise(OUTSIDE))
    templates = materialise(recurring.groupBy("host").agg(F.collect_set("hash").alias("templates")).withColumnRenamed("host", "host_"), "pages-templates")
    keep.clear()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own = [set() if t is None else set(t.tolist()) for t in b["templates"]]
            yield pd.DataFrame({"row": b["row"], "text": [_main(h, t) for h, t in zip(b["html_"], own, strict=True)]})

    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != html])
    slim = pages.select(row.alias("row"), host, F.col(f"`{html}`").alias("html_"))
    both = slim.join(templates, F.col("host").eqNullSafe(F.col("host_")), "left").select("row", "html_", "templates")
    return both.mapInPandas(write, schema_with(both, "row", text="string"))


def _main(source, templates: set[int]) -> str:
    if not isinstance(source, str):
        return ""
    root, blocks = parse(source)
    if templates:
        hash_subtrees(root)
        for x in blocks:
            if x.tag not in ("article", "main") and (x.hash in templates or x.maybe and opening(x) in templates):
                x.drop = True
    return text_of(root)


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("row.page_id", "row.url", "text", F.length("text").cast("bigint").alias("n_chars"))
