"""Main text of web pages by site template removal.

Every element's subtree gets a hash of its tags and text. Spark counts, for each host, the distinct pages in
which a subtree recurs; subtrees on many pages of a host are its template and are deleted. Names move that bar: an element
with a word of boilerplate among others in its class or id (``alert-history``) goes from two pages on, one whose
tag, role or whole class name declares menu, header, footer, sidebar, notice, advert, form or reader comment goes
without a count. The text is read from ``article`` elements, else ``main``, else the whole body; in the last case a block
of which more than half is link text, outside of paragraphs and headings, is a menu.

Inside a declared article the same count decides with stricter guards, so that the article's own text stays: only
containers (boxes, sections, lists) with text beside headings count, at one place of the tree, on more pages, and only
pages whose longest other block of article text differs; a paragraph or heading that recurs on other pages stays text.

Pages are parsed in Arrow batches where they lie; only hashes of host, subtree, page and longest other block move, summed by
host and subtree before the shuffle, so that neither a hot host nor a page with thousands of copies (which count as one page)
gathers in a task. Nothing of a text is capped.

Defined cases: a NULL or empty html gives an empty text; broken or cut markup is read as far as it goes; a NULL URL
or one without a host forms a host of its own; repeated rows get equal texts; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small

#: A template subtree stands on at least so many distinct pages of its host, and on this share of them ...
MIN_PAGES = 4
MIN_SHARE = 0.02
#: ... unless it stands on so many: that is template on a host of any size.
MANY_PAGES = 100
#: Where a name hints at boilerplate, on so many pages.
HINTED_PAGES = 2
#: Inside articles on at least so many pages with different text.
ARTICLE_PAGES = 20
#: Kinds of subtrees: outside articles, there with a hint, a container inside an article.
OUTSIDE, HINTED, BOX = 0, 1, 2

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.S)
_NAME = re.compile(r"[a-z0-9]+")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp", "noembed", "noframes", "svg", "object", "select",
        "annotation", "annotation-xml"}
#: Elements without a box of their own: their text belongs to the block around them.
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd",
           "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "td", "th",
           "time", "tt", "u", "var",
           "math", "menclose", "merror", "mfenced", "mfrac", "mi", "mmultiscripts", "mn", "mo", "mover", "mpadded", "mphantom", "mprescripts",
           "mroot", "mrow", "ms", "mspace", "msqrt", "mstyle", "msub", "msubsup", "msup", "mtable", "mtd", "mtext", "mtr", "munder",
           "munderover", "semantics"}
_DROP = {"head", "nav", "footer", "aside", "form", "button", "dialog", "menu", "fieldset", "audio", "video", "canvas", "map"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
_CLASSES = {"ad", "ads", "advert", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner",
            "cookie", "cookies", "consent", "gdpr", "notice", "notification", "alert", "popup", "modal", "overlay", "newsletter",
            "subscribe", "subscription", "signup", "login", "sidebar", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb",
            "breadcrumbs", "pagination", "pager", "footer", "masthead", "topbar", "toolbar", "share", "sharing", "social", "related",
            "recommended", "recommendations", "comment", "comments", "disqus", "reply", "replies", "respond", "copyright", "disclaimer"}
#: Elements that can be template inside an article; paragraphs, headings, list items and quotations are its text.
_BOXES = {"div", "section", "ul", "ol", "dl", "table", "aside", "details", "header", "center"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Text whose id is a link target, often a slug of its words.
_TEXTS = _HEADINGS | {"p", "li", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "section", "caption"}
#: What class names inside an article may hold beside a word of _CLASSES, and ids that name a box there.
_PARTS = {"area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "container", "content", "cta", "floating", "footer",
          "form", "group", "header", "icon", "icons", "inline", "inner", "item", "items", "left", "link", "links", "list", "panel",
          "post", "posts", "prompt", "right", "row", "section", "slot", "sticky", "thread", "title", "toggle", "top", "unit", "wrap", "wrapper",
          "article", "articles", "stories", "story", "tools", "us", "reader", "readers", "user", "users", "site", "page", "main", "fixed", "global"}
_BOX_IDS = {"ad", "ads", "advertisement", "comment", "comments", "disqus", "newsletter", "pagination", "reply", "replies", "respond", "sidebar"}
#: What a start tag closes if it is open.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr"},
           "tfoot": {"tbody", "thead", "tr"}}


@dataclass
class Node:
    tag: str
    parent: int
    drop: bool = False       # by its tag
    boilerplate: bool = False  # by its role, class or id
    suspect: bool = False      # a word of its class or id hints at it
    root: int = 0            # 2: article, 1: main
    parts: list = field(default_factory=list)
    hash: int = 0


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[tuple[int, str, int]]     # node, text, characters inside links

    def roots(self) -> list[int]:
        """The elements that hold the main text: outermost articles, else main elements, else none."""
        for rank in (2, 1):
            found = [i for i, n in enumerate(self.nodes) if n.root == rank and not n.boilerplate
                     and not any(self.nodes[a].root == rank or self.nodes[a].drop for a in self.above(i))]
            if found:
                return found
        return []

    def above(self, i: int):
        i = self.nodes[i].parent
        while i >= 0:
            yield i
            i = self.nodes[i].parent


def _names(value: str, words: set[str]) -> bool:
    """Whether a whole name of the value consists of such words and of parts of a page."""
    for name in value.split():
        found = {x for x in _NAME.findall(name) if not x.isdigit()}
        if found & words and found <= words | _PARTS:
            return True
    return False


def _declared(attributes: str, tag: str, inside: bool) -> tuple[bool, bool]:
    """Whether role, style, class or id declare boilerplate, and whether some word of a class or id hints at it. Whole names
    declare, inside an article (and for the article itself) those of containers only; the id of a heading, paragraph
    or section, often a slug of its words, says nothing unless it names a box."""
    hint = False
    for k, v in _ATTRIBUTE.findall(attributes):
        k, v = k.lower(), v.strip("\"'").lower()
        if k in ("class", "id"):
            slug = k == "id" and tag in _TEXTS
            known = _CLASSES if k == "class" else _BOX_IDS if inside or slug else _CLASSES
            boxed = tag in _BOXES or tag == "article" if inside else not slug or tag == "section"
            if boxed and _names(v, known):
                return True, True
            hint |= not slug and bool(_CLASSES & set(_NAME.findall(v)))
        elif (k == "role" and v in _ROLES or k == "hidden" or k == "aria-hidden" and v == "true"
              or k == "style" and "display:none" in v.replace(" ", "")):
            return True, True
    return False, hint


def parse(source: str) -> Page:
    """The page's elements (document order) and its blocks of text, all of them."""
    nodes = [Node("", -1)]
    page = Page(nodes, [])
    at, here, linked, in_link = 0, 0, 0, False
    buffer: list[str] = []

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                page.blocks.append((here, text, linked))
                nodes[here].parts.append(xxhash.xxh3_64_digest(text))
            buffer.clear()
        linked = 0

    def close(i: int) -> int:
        n = nodes[i]
        if n.parts:
            n.hash = xxhash.xxh3_64_intdigest(n.tag.encode() + b"".join(n.parts))
            nodes[n.parent].parts.append(n.hash.to_bytes(8, "little"))
        return n.parent

    def text(raw: str) -> None:
        nonlocal linked
        if raw:
            raw = _html.unescape(raw) if "&" in raw else raw
            buffer.append(raw)
            if in_link:
                linked += len(raw.strip())

    while (m := _TOKEN.search(source, at)) is not None:
        text(source[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, attributes = m[1] or m[4], m[3] or m[6] or ""
        if tag in _RAW:
            if not ends and not attributes.endswith("/"):
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
                at = stop.end() if stop else len(source)
            continue
        if tag == "a":
            in_link = not ends
        if tag in ("br", "td", "th", "hr", "img"):
            buffer.append(" ")
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _INLINE:
            continue
        flush()
        in_link = False
        if ends:
            if tag == "p" and not any(nodes[i].tag == "p" for i in (here, *page.above(here))):
                continue
            i = here
            while i > 0 and nodes[i].tag != tag:
                i = nodes[i].parent
            if i > 0:                                  # close everything up to the named element
                while here != i:
                    here = close(here)
                here = close(here)
            continue
        if nodes[here].tag == "p":
            here = close(here)
        shut = _CLOSES.get(tag)
        if shut:
            i = here
            while i > 0 and nodes[i].tag not in shut and nodes[i].tag not in ("ul", "ol", "dl", "table", "select"):
                i = nodes[i].parent
            if i > 0 and nodes[i].tag in shut:
                while here != i:
                    here = close(here)
                here = close(here)
        inside = any(nodes[i].root == 2 for i in (here, *page.above(here)))
        root = 2 if tag == "article" else 1 if tag == "main" or re.search(r"""role\s*=\s*["']?main\b""", attributes, re.I) else 0
        named = attributes and tag not in ("html", "body")
        declared, hint = _declared(attributes, tag, inside or tag == "article") if named else (False, False)
        nodes.append(Node(tag, here, tag in _DROP or tag == "header" and not inside, declared, hint, root))
        here = len(nodes) - 1
        if attributes.endswith("/") and tag not in ("p", "div", "li", "article", "main", "section"):
            here = close(here)
    text(source[at:])
    flush()
    while here > 0:
        here = close(here)
    return page


def _kept(page: Page) -> list[bool]:
    """Whether each element may hold main text, by its own and its ancestors' tags and names."""
    nodes, roots = page.nodes, page.roots()
    holds = {a for r in roots for a in page.above(r)}
    out: list[bool] = []
    for i, n in enumerate(nodes):
        # a name cannot condemn what holds the article
        bad = n.drop and i not in holds or n.boilerplate and i not in holds
        out.append(not bad and (n.parent < 0 or out[n.parent]))
    return out


def subtrees(page: Page) -> dict[int, bool]:
    """Hashes of elements with text that may be template, those outside of articles, and whether a name hints at it."""
    inside: list[bool] = []
    found: dict[int, bool] = {}
    articles = {r for r in page.roots() if page.nodes[r].root == 2}
    for i, n in enumerate(page.nodes):
        inside.append(i in articles or n.parent >= 0 and inside[n.parent])
        if n.hash and not inside[i] and n.tag not in ("html", "body"):
            found[n.hash] = found.get(n.hash, False) or n.suspect
    return found


def article_boxes(page: Page) -> tuple[list[int], dict[int, int]]:
    """Containers inside articles: for each element the hash of its subtree and its place below the article (0: none),
    and for each hash that of the longest block of article text outside of such subtrees."""
    nodes = page.nodes
    articles = {r for r in page.roots() if nodes[r].root == 2}
    if not articles:
        return [0] * len(nodes), {}
    path: list[bytes] = []
    for i, n in enumerate(nodes):
        up = path[n.parent] if n.parent >= 0 else b""
        path.append(b"/" if i in articles else up + n.tag.encode() + b"/" if up else b"")
    texts = [(i, text) for i, text, _ in page.blocks if path[i]]
    worded = {a for i, _ in texts if nodes[i].tag not in _HEADINGS for a in (i, *page.above(i))}
    box = [xxhash.xxh3_64_intdigest(path[i] + n.hash.to_bytes(8, "little"))
           if n.hash and n.tag in _BOXES and path[i] and i not in articles and i in worded else 0 for i, n in enumerate(nodes)]
    found: dict[int, int] = {}
    texts.sort(key=lambda x: -len(x[1]))
    around = [(text, {box[a] for a in (i, *page.above(i))}) for i, text in texts]
    for h in set(box) - {0}:
        other = next((text for text, over in around if h not in over), None)
        if other is not None:
            found[h] = xxhash.xxh3_64_intdigest(other)
    return box, found


def main_text(page: Page, template: set[int]) -> str:
    """Blocks of the main text in page order, joined by two line breaks."""
    nodes, roots, kept = page.nodes, page.roots(), _kept(page)
    articles = {r for r in roots if nodes[r].root == 2}
    box = article_boxes(page)[0] if template and articles else [0] * len(nodes)
    inside, article, gone = [], [], []
    for i, n in enumerate(nodes):
        up = n.parent
        inside.append(not roots or i in roots or up >= 0 and inside[up])
        article.append(i in articles or up >= 0 and article[up])
        gone.append((box[i] if article[i] else n.hash) in template or up >= 0 and gone[up] and i not in articles)
    out = []
    for i, text, linked in page.blocks:
        menu = not roots and 2 * linked > len(text) and nodes[i].tag not in _HEADINGS and nodes[i].tag != "p"
        if inside[i] and kept[i] and not gone[i] and not menu:
            out.append(text)
    return "\n\n".join(out)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def extract(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE,
            article_pages: int = ARTICLE_PAGES, many_pages: int = MANY_PAGES, hinted_pages: int = HINTED_PAGES) -> DataFrame:
    """The table without ``html`` and with ``text`` and ``n_chars`` added."""
    clash = {"text", "n_chars", "_host", "_page", "_template", html.lower()}
    others = [c for c in pages.columns if c.lower() not in clash]
    host = F.lower(F.regexp_extract(F.coalesce(pages[f"`{url}`"], F.lit("")), r"(?s)://([^/?#]*)", 1))
    source = F.coalesce(pages[f"`{html}`"], F.lit(""))
    rows = pages.select(*[pages[f"`{c}`"] for c in others], host.alias("_host"), source.alias("_html")).withColumn(
        "_page", F.xxhash64("_host", "_html"))

    def found(batches):
        for b in batches:
            hosts, keys, hashes, rests, kinds = [], [], [], [], []
            for h, k, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                page = parse(x.as_py())
                for s, o, kind in [*((s, k, HINTED if hint else OUTSIDE) for s, hint in subtrees(page).items()),
                                   *((s, _signed(o), BOX) for s, o in article_boxes(page)[1].items())]:
                    hosts.append(h)
                    keys.append(k)
                    hashes.append(_signed(s))
                    rests.append(o)
                    kinds.append(kind)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(hashes, pa.int64()),
                                              pa.array(rests, pa.int64()), pa.array(kinds, pa.int8())],
                                             ["host", "page", "subtree", "other", "kind"])
    seen = saved(rows.select("_host", "_page", "_html").mapInArrow(
        found, "host string, page long, subtree long, other long, kind byte").distinct(), "subtrees")
    # pages of a host: its distinct pages that have any such subtree
    sizes = seen.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    box, hinted = F.col("kind") == BOX, F.col("kind") == HINTED
    # what a page's subtree is outside of articles counts together, whether a name hints at it there or not
    counted = (seen.select("host", "subtree", "other", box.alias("box"), "kind").groupBy("host", "subtree", "box", "other")
               .agg(F.max("kind").alias("kind")).groupBy("host", "subtree", "box").agg(F.count("*").alias("n"), F.max("kind").alias("kind")))
    bar = F.when(box, article_pages).when(hinted, F.least(F.lit(hinted_pages), F.lit(min_pages))).otherwise(min_pages)
    template = (counted.filter(F.col("n") >= bar).join(sizes, "host")
                .filter(hinted | (F.col("n") >= F.least(min_share * F.col("pages"), F.lit(many_pages)))).select("host", "subtree"))
    marks = saved(seen.join(template, ["host", "subtree"]).groupBy(F.col("page").alias("_page")).agg(
        F.collect_list("subtree").alias("_template")), "templates")

    def read(batches):
        for b in batches:
            n = len(others)
            texts = [main_text(parse(x.as_py()), {i & (1 << 64) - 1 for i in t.as_py() or ()})
                     for x, t in zip(b.column(n), b.column(n + 1))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             [*others, "text", "n_chars"])
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.select(*others).dtypes) + ", text string, n_chars long"
    return rows.join(small(marks, 200_000), "_page", "left").select(*others, "_html", "_template").mapInArrow(read, schema)
