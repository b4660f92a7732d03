"""Main text of web pages: element rules, and removal of the templates of a site.

* Pages are read into elements as a browser would nest them, as far as text needs it: void elements, elements whose end is implied, raw
  text, end tags without a start. Scripts, styles, forms, menus, headers, footers, sidebars, notices, adverts and reader comments
  go, by element, role, or a class or id that consists of such names alone (``ad``, ``site-footer``; not ``no-sidebar`` or ``entry-header``).
  A class, id or role never takes an element that holds the article, or, on a page without one, most of its running text.
  Where a page has an article or a main element, only text inside counts. Raw elements without an end do not swallow the page.
* Template removal: every element outside running text is hashed with all it holds; Spark counts on how many different
  pages of its host each hash occurs, and subtrees on at least ``MIN_PAGES`` and ``MIN_SHARE`` of them are deleted.
  Copies of one page count once, and blocks of running text inside an article are never taken for a template, so that passages
  that many articles share stay.
* The counts are distributed sums; a page meets the recurring hashes that it holds itself, at most as many as it has
  elements. A host with a third of all pages leaves each task as one row per hash.
* White space inside a block becomes one blank, blocks are joined by a line end, ``br`` is white space. A null or empty page has an empty
  text; a null url is a host of its own. Repeated rows get equal rows. No pages, no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wastelens.llm import common

MIN_PAGES = 5
MIN_SHARE = 0.5
MOST = 0.75
TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))*+)>|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>|<(/?)([A-Za-z][^\s/>]*+)([^<>]*+)\Z""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']++)\s*+(?:=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>]++)))?""")
NAMES = re.compile("[a-z]+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe noframes noembed template svg".split())
ENDLESS = {"script", "style", "textarea", "title"}  # without an end they take the rest of the page, as in a browser; the other raw ones are skipped
GONE = set("head nav header footer aside form button select option label fieldset menu frameset".split()) | RAW
GONE_NAMES = set("""ad ads adv advert adverts advertisement advertisements advertising adsense banner banners sponsor sponsored sponsors promo
    promoted promotion cookie cookies consent gdpr notice notices alert alerts sidebar sidebars menu menus nav navbar navigation
    breadcrumb breadcrumbs comment comments disqus respond share sharing social newsletter subscribe subscription signup login
    related recommended footer header masthead popup modal overlay widget widgets pagination pager toolbar copyright disclaimer""".split())
BESIDE = set("""site global top bottom left right primary secondary box block area container wrapper wrap list links link bar section item items
    slot unit inner outer row col column group panel""".split())  # may stand beside a name without changing what it means
READERS = {"comment", "comments", "disqus", "respond"}
GONE_ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
BLOCK = set("""address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul""".split())
RUNNING = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td th tr tbody thead dl figure".split())
MAIN = {"article", "main"}
CLOSED_BY = {  # an open element that ends where one of these begins
    "p": BLOCK - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"} | BLOCK - {"html"}, "option": {"option"}}
SCOPE = {"table", "ul", "ol", "dl", "html", "body", "article", "main", "section"}


class Element:
    __slots__ = ("tag", "parent", "mark", "gone", "inside", "parts")

    def __init__(self, tag: str, parent: Element | None, mark: str | None, inside: bool):
        self.tag, self.parent, self.mark, self.inside = tag, parent, mark, inside
        self.gone = False  # set by settle
        self.parts: list[Element | str] = []  # children and raw text in order


def is_name(token: str) -> str | None:
    """``readers``, ``name`` or None: whether a class or id consists of listed names, and words that may stand beside them, alone."""
    words = set(NAMES.findall(token))
    if not words & GONE_NAMES or words - GONE_NAMES - BESIDE:
        return None
    return "readers" if words & READERS else "name"


def mark_of(tag: str, attributes: str) -> str | None:
    """Why an element goes: ``element`` (surely), ``readers`` or ``name`` (unless it holds what the page is about), or None."""
    if tag in GONE:
        return "element"
    if not attributes or tag in ("html", "body") or tag in MAIN and "comment" not in attributes.lower():
        return None
    found = None
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return "element"
        if name in ("class", "id"):
            for kind in filter(None, map(is_name, value.split())):
                found = "readers" if "readers" in (kind, found) else "name"
        elif name == "role" and value.strip() in GONE_ROLES:
            found = found or "name"
    return found


def settle(root: Element) -> Element:
    """Decide which elements go: a marked one with all it holds, unless only its name speaks against it and it holds the article,
    or, where no article is left, more than ``MOST`` of the page's running text (reader comments go whatever their size)."""
    order, stack, running = [], [root], {id(None): False}
    while stack:
        x = stack.pop()
        order.append(x)
        running[id(x)] = x.tag in RUNNING or running[id(x.parent)]
        stack.extend(p for p in x.parts if isinstance(p, Element))
    main, size = {}, {}
    for x in reversed(order):
        below = [p for p in x.parts if isinstance(p, Element)]
        if x.mark == "element":
            main[id(x)], size[id(x)] = False, 0
            continue
        main[id(x)] = x.tag in MAIN and x.mark is None or any(main[id(p)] for p in below)
        size[id(x)] = sum(size[id(p)] for p in below) + (
            sum(len(p.strip()) for p in x.parts if isinstance(p, str)) if running[id(x)] else 0)
    for x in order:
        holds = main[id(x)] if main[id(root)] else x.mark != "readers" and size[id(x)] > MOST * size[id(root)]
        x.gone = (x.parent is not None and x.parent.gone) or x.mark == "element" or x.mark is not None and not holds
    return root


def parse(page: str) -> Element:
    return settle(_read(page))


def _read(page: str) -> Element:
    root = node = Element("", None, None, False)
    at, ends, endless = 0, {}, set()
    while True:
        m = TAG.search(page, at)
        if m is None or m.start() > at:
            node.parts.append(page[at:m.start() if m else len(page)])
        if m is None:
            return root
        at = m.end()
        tag = m[2] or m[5] or m[8]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4] or m[7]:
            node = _end(node, tag)
            continue
        node = _imply(node, tag)
        if tag in VOID:
            node.parts.append(Element(tag, node, None, node.inside))
            continue
        attributes = m[3] or m[6] or ""
        child = Element(tag, node, mark_of(tag, attributes), node.inside or tag in MAIN)
        node.parts.append(child)
        if tag in RAW:
            if not attributes.rstrip().endswith("/") or tag != "svg":
                if tag not in ends:
                    ends[tag] = re.compile(f"</{re.escape(tag)}(?=[\\s/>])[^>]*>", re.I)
                close = ends[tag].search(page, at) if tag not in endless else None
                if close:
                    at = close.end()
                elif tag in ENDLESS:
                    at = len(page)
                else:
                    endless.add(tag)
            continue
        node = child


def _imply(node: Element, tag: str) -> Element:
    """The element that a start tag finds open, after those whose end it implies."""
    x: Element | None = node
    while x is not None and x.tag not in SCOPE and x.tag != "":
        if tag in CLOSED_BY.get(x.tag, ()):
            return _imply(x.parent, tag)
        if x.tag in ("div", "form", "nav", "aside", "header", "footer", "blockquote"):
            break
        x = x.parent
    return node


def _end(node: Element, tag: str) -> Element:
    x: Element | None = node
    while x is not None and x.tag != tag:
        x = x.parent
    return x.parent if x is not None and x.parent is not None else node


def clean(raw: str) -> str:
    """Text of one piece between tags: references are decoded inside it, never across tags."""
    return " ".join(entities.unescape(raw).split())


def hashed(root: Element) -> dict[int, list[Element]]:
    """Elements by the hash of their subtree (tag, text and children), without those that no template can be."""
    out: dict[int, list[Element]] = {}
    order, stack = [], [root]
    while stack:
        x = stack.pop()
        order.append(x)
        stack.extend(p for p in x.parts if isinstance(p, Element))
    known: dict[int, bytes] = {}
    for x in reversed(order):
        digest = xxhash.xxh64(x.tag.encode(), seed=1)
        filled = False
        for p in x.parts:
            if isinstance(p, Element):
                inner = known[id(p)]
                filled |= bool(inner[8:])
                digest.update(inner)
            elif text := clean(p):
                filled = True
                digest.update(text.encode("utf-8", "surrogatepass") + b"\0")
        known[id(x)] = digest.digest() + (b"+" if filled else b"")
        if filled and x.tag not in ("", "html", "body") and x.tag not in MAIN and not (x.inside and x.tag in RUNNING) and x.tag in BLOCK:
            out.setdefault(int.from_bytes(known[id(x)][:8], "big", signed=True), []).append(x)
    return out


def main_text(root: Element, template: set[int] = frozenset()) -> str:
    """Blocks of the article, or of the page where it has none, without what is gone or template."""
    dropped = {id(x) for h, found in hashed(root).items() if h in template for x in found} if template else set()
    blocks: list[str] = []
    held: list[str] = []
    only_main = _has_main(root)

    def flush() -> None:
        if text := " ".join("".join(held).split()):
            blocks.append(text)
        held.clear()

    stack: list = [root]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            held.append(x)
        elif x is None:
            flush()
        elif isinstance(x, tuple):
            if x[0].inside or not only_main:
                held.append(entities.unescape(x[1]))
        elif not x.gone and id(x) not in dropped:
            if x.tag == "br":
                held.append(" ")
                continue
            if x.tag in BLOCK:
                flush()
                stack.append(None)
            stack.extend(p if isinstance(p, Element) else (x, p) for p in reversed(x.parts))
    flush()
    return "\n".join(blocks)


def _has_main(root: Element) -> bool:
    stack = [root]
    while stack:
        x = stack.pop()
        if not x.gone:
            if x.tag in MAIN:
                return True
            stack.extend(p for p in x.parts if isinstance(p, Element))
    return False


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, hosts, pages, hashes = [], [], [], []
        for key, url, page in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            root = parse(page or "")
            found = hashed(root)
            keys.append(key)
            hosts.append(host_of(url))
            pages.append(int.from_bytes(xxhash.xxh64_digest(main_text(root).encode("utf-8", "surrogatepass")), "big", signed=True))
            hashes.append(list(found))
        yield pa.RecordBatch.from_arrays([
            pa.array(keys, pa.int64()), pa.array(hosts, pa.string()), pa.array(pages, pa.int64()), pa.array(hashes, pa.list_(pa.int64()))],
            names=["key", "host", "page", "hashes"])


def templates(subtrees: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """(host, hash) of subtrees that recur across many different pages of the host."""
    each = subtrees.select("host", "page", F.explode("hashes").alias("hash")).distinct()
    counts = each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pages)
    sizes = subtrees.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    return counts.join(sizes, "host").filter(F.col("n") >= min_share * F.col("pages")).select("host", "hash")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(parse(page or ""), set(hashes or ())) for page, hashes in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", "html").withColumn("key", F.xxhash64("page_id", "url", "html"))
    subtrees = common.cut_lineage(
        rows.select("key", "url", "html").mapInArrow(_subtrees, "key long, host string, page long, hashes array<long>"), "subtrees")
    each = subtrees.select("key", "host", F.explode("hashes").alias("hash"))
    marks = common.cut_lineage(
        each.join(templates(subtrees, min_pages, min_share), ["host", "hash"]).groupBy("key").agg(F.collect_set("hash").alias("hashes")), "marks")
    marked = rows.join(marks, "key", "left").select("page_id", "url", "html", "hashes")
    kind = pages.schema["page_id"].dataType.simpleString()
    return marked.mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(common.table(spark, sf_dir, "pages"))


QUERIES = {"op2_html_text": op2_html_text}
ORACLES: dict[str, str] = {}
