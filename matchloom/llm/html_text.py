"""Main text of web pages, with site templates removed by subtree counts.

Every page is parsed into a tree, and its subtrees are hashed. Outside the article a subtree's hash is that of its frame: tag,
class, id and role, and the frames of its children, runs of equal ones counting once, without the texts, so that menus, adverts and
notices are recognised whatever they say today. Inside an article, and on pages without one, the hash also covers the texts.
Spark counts for each host the page contents that hold a subtree; one found in at least ``min_pages`` contents
and ``min_share`` of the host's contents is part of the site's template and is deleted wherever it occurs on that host. Pages of
equal main text are one content, however many mirrors, print views and repeated rows there are, so copies of a page do
not make it a template. Counts are partial aggregates keyed by host, hash and content, so a host with a third of all pages is spread like
any other. What travels back is one row a host with its template hashes (at most ``1 / min_share`` times the subtrees of a
page), which Catalyst broadcasts where its measured size allows.

What is left of a page's body after the deletions is its text. Script, style, forms and hidden elements, and what HTML itself names as navigation, header, footer or
aside, never are. On a host of fewer than ``min_pages`` contents counts say nothing: there the text is that of the page's articles,
else of its main element, else of its body.

Protected from deletion: paragraphs, headings, quotes and tables of an article, and boxes in it of more than ``PART`` of its words unless
mostly links, since a passage that many pages repeat is part of each; everything that holds an article. On a page without article and main, paragraphs and
headings go only with the whole of a recurring box around them, list items and table cells only where they are mostly links.

Blocks are white-space-collapsed and joined by one space. Null, empty and textless pages give an empty text. Text that lies loose between the
boxes around an article belongs to no box and is left out. Unclosed, misnested and truncated markup is closed as HTML does it for paragraphs, list items and
table cells. A very long or deep page is read in time linear in its length, and whole. A url without a host forms the host ``""``. Repeated rows give
equal rows; other columns are not read, whatever their names. No rows: no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Callable, Container, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from matchloom.llm.common import map_batches, slices
from matchloom.plans.durable import materialize

MIN_PAGES, MIN_SHARE = 8, 0.005
#: Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
DROPPED = frozenset("head nav header footer aside form button select dialog svg canvas object audio video menu math datalist".split()) | RAW
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table dl figure".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("html body article main div section table ul ol dl td th nav aside header footer form blockquote".split())
#: Where a page has neither article nor main, tables may be its layout.
BODY_PROSE = PROSE - {"table"}
ITEMS = frozenset("li dt dd tr td th thead tbody tfoot caption".split())
#: Share of an article's words beyond which a box in it is no template, unless it is mostly links.
PART = 0.25
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_DIGITS = re.compile(r"\d+")
#: Elements that are the page itself and so never a part of it.
WHOLE = frozenset(("#root", "html", "body", "head"))


class Node:
    """An element. Its marks are class, id and role without digits, which only number what recurs."""

    __slots__ = ("tag", "marks", "gone", "main", "parent", "children", "hash", "words", "linked")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent = tag, parent
        self.children: list[Node | str] = []
        self.marks, self.gone, self.main = "", tag in DROPPED, tag == "main"
        self.hash = self.words = self.linked = 0
        marks, hidden = [], False
        for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), value.strip("\"'").lower()
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
            elif name in ("class", "id", "role"):
                marks.append(f"{name}={_DIGITS.sub('', value)}")
                self.main = self.main or name == "role" and value == "main"
        self.marks = " ".join(marks)
        self.gone = self.gone or hidden and tag not in ("html", "body", "article", "main")


def parse(source: str) -> Node:
    """The tree of a page, in time linear in its length but for end tags that close many elements at once, each closed once."""
    root = Node("#root", None)
    top, at = root, 0
    lower = None
    opened: Counter[str] = Counter()  # open elements by tag: a stray end tag costs no walk
    search = _TOKEN.search
    while True:
        m = search(source, at)
        if m is None:
            if at < len(source):
                top.children.append(source[at:])
            return root
        if m.start() > at:
            top.children.append(source[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, ending, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if not m[0].endswith(">"):
            return root  # the page ends inside a tag
        closing = (tag,) if ending else ("p",) if tag in CLOSES_P else CLOSES.get(tag, ())
        if any(opened[x] for x in closing):
            node = top
            while node.tag not in closing and (ending or node.tag not in SCOPE):
                node = node.parent  # type: ignore[assignment]
            if node.tag in closing:
                while top is not node.parent:
                    opened[top.tag] -= 1
                    top = top.parent  # type: ignore[assignment]
        if ending:
            continue
        node = Node(tag, top, attributes)
        top.children.append(node)
        if tag in RAW:
            lower = lower if lower is not None else source.lower()
            end = lower.find(f"</{tag}", at)
            if end < 0:
                return root
            shut = source.find(">", end)
            at = len(source) if shut < 0 else shut + 1
        elif tag not in VOID and not attributes.endswith("/"):
            top = node
            opened[tag] += 1


class Page:
    """A parsed page: its elements in page order, those that are no text, its articles, and the elements around these."""

    def __init__(self, source: str) -> None:
        self.root = parse(source)
        self.nodes: list[Node] = []
        stack = [self.root]
        while stack:
            x = stack.pop()
            self.nodes.append(x)
            stack += [y for y in reversed(x.children) if not isinstance(y, str)]
        self.lost: set[Node] = set()
        for x in self.nodes:
            if x.gone or x.parent in self.lost:
                self.lost.add(x)
        self.inside: dict[Node, Node] = {}  # the article that an element is in
        self._outermost(lambda x: x.tag == "article")
        if not self.inside:
            self._outermost(lambda x: x.main)
        self.articles = [x for x, y in self.inside.items() if x is y]
        self.around: set[Node] = set()
        for x in self.articles:
            above = x.parent
            while above is not None and above not in self.around:
                self.around.add(above)
                above = above.parent

    def _outermost(self, test: Callable[[Node], bool]) -> None:
        for x in self.nodes:
            if x.parent in self.inside:
                self.inside[x] = self.inside[x.parent]
                if x.tag == "article" and self.inside[x].tag == "article":
                    x.gone = True  # HTML: an article in an article is a comment on it
                if x.gone or x.parent in self.lost:
                    self.lost.add(x)
            elif x not in self.lost and test(x):
                self.inside[x] = x

    def _measure(self) -> None:
        """Words of every element that are text, and those of them in links."""
        for x in reversed(self.nodes):
            if x in self.lost:
                continue
            for y in x.children:
                if isinstance(y, str):
                    x.words += len(y.split())
                elif y not in self.lost:
                    x.words += y.words
                    x.linked += y.linked
            if x.tag == "a":
                x.linked = x.words

    def _hash(self) -> None:
        """Exact hashes within articles and on pages without one, else those of frames; children first."""
        for x in reversed(self.nodes):
            if x in self.lost or x in self.around:
                continue
            parts = [x.tag, x.marks]
            if self.articles and x not in self.inside:
                parts.append("frame")
                for y in x.children:
                    part = "#" if isinstance(y, str) or y.tag in INLINE and y.tag != "a" else f"<{y.hash}>"
                    if part != parts[-1] and not (isinstance(y, str) and not y.strip()):
                        parts.append(part)
            else:
                parts += [" ".join(y.split()) if isinstance(y, str) else f"<{y.hash}>" for y in x.children]
            x.hash = xxh64_intdigest("\x00".join(p for p in parts if p)) >> 1 or 1

    def candidates(self) -> dict[Node, int]:
        """The elements that may be template, with their hashes: those whose deletion would change the text and that nothing protects."""
        self._measure()
        self._hash()
        prose: set[Node] = set()
        found: dict[Node, int] = {}
        exempt = PROSE if self.articles else BODY_PROSE
        for x in self.nodes:
            if x in self.lost or x in self.around:
                continue
            if x.parent in prose or x.tag in exempt:
                prose.add(x)
            if not x.words or x.tag in WHOLE or x.tag in VOID:
                continue
            if x.parent in self.around or x not in prose and x.tag not in INLINE:
                links = 2 * x.linked >= x.words
                article = self.inside.get(x)
                if article is not None:
                    free = x is not article and (links or x.words <= PART * article.words)
                else:
                    free = bool(self.articles) or links or x.tag not in ITEMS
                if free:
                    found[x] = x.hash
        return found

    def text(self, whole: bool = False, deleted: Container[Node] = ()) -> str:
        """The text of the articles, else of the page; or, ``whole``, that of the page in any case, without deleted elements."""
        pieces: list[str] = []
        stack: list[Node | str] = [self.root] if whole or not self.articles else [z for y in reversed(self.articles) for z in (y, " ")]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                pieces.append(html.unescape(x) if "&" in x else x)
            elif x in self.lost or x in deleted:
                pieces.append(" ")
            elif x in self.around:  # text that lies loose between boxes belongs to none
                stack += [y for y in reversed(x.children) if not isinstance(y, str)]
            elif x.tag in INLINE:
                stack += x.children[::-1]
            else:
                stack += [" ", *x.children[::-1], " "]
        return " ".join("".join(pieces).split())


def subtrees(source: str | None) -> tuple[list[int], int]:
    """Hashes of a page's possible template subtrees, and the hash of its text with them."""
    if not source:
        return [], 0
    page = Page(source)
    return sorted(set(page.candidates().values())), xxh64_intdigest(page.text()) >> 1


def extract(source: str | None, template: Iterable[int] | None = None) -> str:
    """The main text of a page: on a host with known template subtrees (perhaps none) without these, else by its article alone."""
    if not source:
        return ""
    page = Page(source)
    if template is None:
        return page.text()
    known = set(template)
    return page.text(True, {x for x, h in page.candidates().items() if h in known})


def host_of(url):  # noqa: ANN001, ANN201
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``(host, template)`` from ``(host, html)``: for every host of ``min_pages`` contents or more, the hashes of its template's subtrees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found = [subtrees(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.list_(pa.int64())), pa.array([x for _, x in found], pa.int64())], names=["host", "seen", "content"])

    rows = materialize(map_batches(pages.select("host", "html"), run, "host string, seen array<long>, content long"), "html-subtrees", narrow=True)
    sites = rows.groupBy("host").agg(F.countDistinct("content").alias("contents")).where(F.col("contents") >= min_pages)
    counts = rows.select("host", "content", F.explode("seen").alias("hash")).groupBy("host", "hash").agg(F.countDistinct("content").alias("n")).where(F.col("n") >= min_pages)
    common = counts.join(sites, "host").where(F.col("n") >= F.col("contents") * min_share).groupBy("host").agg(F.sort_array(F.collect_list("hash")).alias("template"))
    return sites.select("host").join(common, "host", "left").select("host", F.coalesce("template", F.array().cast("array<long>")).alias("template"))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row."""
    rows = pages.select(pages[id_col].alias("page_id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    known = materialize(templates(rows, min_pages, min_share), "html-templates", narrow=True)
    kind = rows.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [extract(x, d) for x, d in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(known, "host", "left").select("page_id", "url", "html", "template")
    return map_batches(joined, run, f"page_id {kind}, url string, text string, n_chars long")
