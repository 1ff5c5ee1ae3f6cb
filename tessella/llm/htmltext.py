"""Main text of web pages by site style trees: the pages of a host are merged into one tree of elements, each element's importance
is the entropy of its presentation and content with that of its branches, and branches of low importance are cut from every page."""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import session_of, small_batches, staged, tidy
from .urlfilter import host_of

#: Elements whose content is no markup: it ends at their end tag only.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in "script style textarea title iframe noscript xmp noembed noframes".split()}
#: Elements whose content is never text of an article.
DROPPED = set(
    "head nav aside form button menu dialog input label fieldset option datalist audio video map template svg math object canvas select".split()
)
#: Page headers and footers; inside an article or a main part a header holds its heading.
EDGES = {"header", "footer"}
BLOCKS = set(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html "
    "li main nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: A start tag of the value ends an open element of the key, unless one of the fences stands between.
CLOSED_BY = {
    "p": BLOCKS,
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "tbody", "tfoot"},
    "td": {"td", "th", "tr", "tbody", "tfoot"},
    "th": {"td", "th", "tr", "tbody", "tfoot"},
    "option": {"option"},
}
CLOSES: dict[str, list[str]] = {}
for _open, _starts in CLOSED_BY.items():
    for _start in _starts:
        CLOSES.setdefault(_start, []).append(_open)
FENCES = set("table ul ol dl section article blockquote body main aside nav".split())
#: Open elements beyond this depth are not entered one by one; their text belongs to the deepest one.
DEEPEST = 400
#: Elements deeper than this count as their ancestor at this depth in the tree.
TREE_DEPTH = 32

#: Words in a class or id that name what is not the article, and words that say nothing beside them. A name counts only if it is made of such
#: words alone: "site-footer" and "comment-list" are, "has-sidebar" and "side-effects" are not, and what they name is left to the style tree.
_NOISE = (
    r"(?:ad|ads|adv|advert\w*|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menus?|breadcrumbs?|sidebar|side|widgets?|footer|header|masthead|"
    r"cookies?|consent|notices?|alerts?|popup|modal|newsletter|subscribe|subscription|comments?|disqus|repl(?:y|ies)|respond|share|sharing|social|related|"
    r"recommended|recommendations?|pagination|pager|toolbar|search|login|signup|form|hidden|skip|copyright|legal|disclaimer|complementary|contentinfo)"
)
_PLAIN = r"(?:container|wrapper|wrap|box|bar|list|area|block|inner|outer|left|right|top|bottom|main|site|page|post|posts|entry|global|buttons|links|slot|unit|0)"
NOISE = re.compile(rf"(?:{_PLAIN}[_-])*{_NOISE}(?:[_-](?:{_NOISE}|{_PLAIN}))*", re.I)
#: Classes that name what is not the article even inside one.
INNER_NOISE = re.compile(
    r"(?:ads?|advert\w*|sponsored|promo|comments?|disqus|share|sharing|newsletter|subscribe|sidebar|breadcrumbs?|pagination|pager)"
    r"(?:[_-](?:container|wrapper|wrap|box|bar|list|area|block|buttons|links|slot|unit|section))*",
    re.I,
)
#: Roles say what an element is, as tags do.
ROLES = set("navigation complementary contentinfo banner search menu menubar toolbar form alert alertdialog dialog".split())
ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[\"'>]")
SENTENCE = re.compile(r"(?<=[.!?]) ")

#: An element is judged if this many different pages of its host have it.
LEAST_PAGES = 5
#: Below this importance a branch is noise on a page without marks; a third of it in an article, and 1 less it beside one.
LEAST_IMPORTANCE = 0.3
#: How fast the layout of an element outweighs its branches with the number of its different layouts.
FADE = 0.9
#: Beside a longer article, one with less than this share of its text is a teaser.
TEASER = 0.25


NONE: frozenset[str] = frozenset()


@lru_cache(16_384)
def label_code(label: str) -> bytes:
    return crc32(label.encode("utf-8", "surrogatepass")).to_bytes(4, "big")


class Element:
    """A block element: its place in the tree, and how its children follow each other (equal neighbours once; "#" is text)."""

    __slots__ = ("children", "depth", "heading", "path", "text", "up")

    def __init__(self, up: Element | None, label: str) -> None:
        self.up, self.children, self.text = up, [], False
        self.heading = len(label) > 1 and label[0] == "h" and label[1] in "123456"
        self.depth, self.path = (0, b"") if up is None else (up.depth + 1, up.path + label_code(label))

    def has(self, label: str) -> None:
        if not self.children or self.children[-1] != label:
            self.children.append(label)


class Block:
    """A run of text in one block element."""

    __slots__ = ("article", "element", "inside", "linked", "text")

    def __init__(self, element: Element, inside: int, article: int, text: str, linked: int) -> None:
        self.element, self.inside, self.article, self.text = element, inside, article, text
        self.linked = 5 * linked >= 4 * len(text)


class Open:
    """An open element: noise is 2 by a tag, role or attribute, 1 by a name alone; inside is 2 in an article, 1 in a main part."""

    __slots__ = ("article", "element", "inside", "link", "noise", "tag")

    def __init__(self, tag: str, element: Element, noise: int, inside: int, article: int, link: bool) -> None:
        self.tag, self.element, self.noise = tag, element, noise
        self.inside, self.article, self.link = inside, article, link


@lru_cache(4096)
def _named(names: tuple[str, ...]) -> bool:
    return any(NOISE.fullmatch(n) for n in names)


@lru_cache(4096)
def _named_inside(classes: tuple[str, ...]) -> bool:
    return any(INNER_NOISE.fullmatch(n) for n in classes)


@lru_cache(16_384)
def described(tag: str, raw: str) -> tuple[tuple[str, ...], tuple[str, ...], frozenset[str], bool, str]:
    """(classes, ids, roles, whether it is hidden, label) of a start tag; of repeated attributes the first counts."""
    given: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        given.setdefault(name.lower(), a or b or c)
    classes, ids = tuple(given.get("class", "").split()), tuple(given.get("id", "").split())
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or bool(INVISIBLE.search(given.get("style", "")))
    label = re.sub(r"\d+", "0", ".".join((tag, *sorted(classes), *ids)))
    return classes, ids, frozenset(given.get("role", "").lower().split()), hidden, label


class Reader:
    """Reads a page into elements and blocks, in time that grows with its length: no character is searched for twice in vain."""

    def __init__(self, page: str) -> None:
        self.root = Element(None, "")
        self.elements: list[Element] = [self.root]
        self.blocks: list[Block] = []
        self.stack = [Open("", self.root, 0, 0, 0, False)]
        self.open: Counter[str] = Counter()
        self.skipped: Counter[str] = Counter()
        self.buffer: list[str] = []
        self.linked = self.articles = 0
        self._read(page)
        self._flush()

    def _flush(self) -> None:
        if not self.buffer:
            return
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        linked, self.linked = self.linked, 0
        if text:
            top = self.stack[-1]
            self.blocks.append(Block(top.element, top.inside, top.article, text, linked))
            top.element.has("#")
            at: Element | None = top.element
            while at is not None and not at.text:
                at.text, at = True, at.up

    def _run(self, text: str) -> None:
        top = self.stack[-1]
        if top.noise:
            return
        text = _html.unescape(text) if "&" in text else text
        self.buffer.append(text)
        if top.link:
            self.linked += len(text.strip())

    def _pop_to(self, k: int) -> None:
        stack, flushed = self.stack, not self.buffer
        for x in stack[k:]:
            self.open[x.tag] -= 1
            if not flushed and x.tag in BLOCKS:
                self._flush()
                flushed = True
        del stack[k:]

    def _find(self, tags: list[str] | tuple[str, ...], fences: set[str]) -> int:
        """Where the innermost open element of ``tags`` stands, 0 if there is none before a fence."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                return k
            if self.stack[k].tag in fences:
                return 0
        return 0

    def _end(self, tag: str) -> None:
        if self.skipped[tag]:
            self.skipped[tag] -= 1
        elif self.open[tag]:
            self._pop_to(self._find((tag,), set()))
        if tag in BLOCKS:
            self._flush()

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br":
            self._run(" ")
            return
        block = tag in BLOCKS
        if block:
            self._flush()
        if tag in CLOSES:
            ended = [t for t in CLOSES[tag] if self.open[t]]
            while ended and (k := self._find(ended, FENCES)):
                self._pop_to(k)
        if tag in VOID or (raw.endswith("/") and not block):
            return
        if len(self.stack) > DEEPEST:
            self.skipped[tag] += 1
            return
        top = self.stack[-1]
        classes, ids, roles, hidden, label = described(tag, raw) if raw else ((), (), NONE, False, tag)
        inside, article, noise = top.inside, top.article, top.noise
        if tag == "article":
            if inside < 2:
                self.articles += 1
                article = self.articles
            inside = 2
        elif tag == "main" or "main" in roles:
            inside = max(inside, 1)
        if inside > top.inside and noise == 1:
            noise = 0  # The name of a wrapper says nothing of the article in it.
        if tag in DROPPED or (tag in EDGES and not (inside and tag == "header")) or not ROLES.isdisjoint(roles):
            noise = 2
        elif raw and not noise and tag not in ("html", "body", "article", "main"):
            if hidden:
                noise = 2
            elif (_named_inside(classes) if inside == 2 else _named(classes + ids)) and "main" not in roles:
                noise = 1
        element = top.element
        if block and not noise:
            element.has(label)
            if element.depth < TREE_DEPTH:
                element = Element(element, label)
                self.elements.append(element)
        self.open[tag] += 1
        self.stack.append(Open(tag, element, noise, inside, article, top.link or tag == "a"))

    def _read(self, page: str) -> None:
        at, n = 0, len(page)
        last = {c: page.rfind(c) for c in "\"'>"}
        while at < n:
            i = page.find("<", at)
            if i < 0:
                self._run(page[at:])
                return
            nxt = page[i + 1 : i + 2]
            end = nxt == "/"
            name = TAG_NAME.match(page, i + 1 + end)
            if name is None and not end and nxt not in ("!", "?"):
                self._run(page[at : i + 1])  # a bare "<"
                at = i + 1
                continue
            if i > at:
                self._run(page[at:i])
            if name is None:  # a comment, or what browsers take for one
                if page.startswith("<!--", i):
                    k = i + 3 if page.startswith(("<!-->", "<!--->"), i) else page.find("-->", i + 4)
                    at = n if k < 0 else page.find(">", k) + 1
                else:
                    at = page.find(">", i) + 1 if i < last[">"] else n
                continue
            j = self._tag_end(page, name.end(), last)
            if j < 0:
                return  # The page ends in a tag.
            tag, raw = name[0].lower(), page[name.end() : j]
            at = j + 1
            if end:
                self._end(tag)
            elif tag in RAW and not raw.endswith("/"):
                if tag in BLOCKS:
                    self._flush()
                m = RAW[tag].search(page, at)
                if m is None:
                    return
                k = page.find(">", m.end())
                at = n if k < 0 else k + 1
            else:
                self._start(tag, raw)

    @staticmethod
    def _tag_end(page: str, at: int, last: dict[str, int]) -> int:
        """Where the ``>`` of a tag stands, quoted ones left out; an unclosed quote ends at the next ``>``. -1 if there is none."""
        while at <= last[">"]:
            m = STOP.search(page, at)
            if m[0] == ">":
                return m.start()
            at = m.end()
            if page[m.start() - 1] == "=" or page[max(0, m.start() - 64) : m.start()].rstrip().endswith("="):
                if at > last[m[0]]:
                    return page.find(">", at) if at <= last[">"] else -1
                at = page.find(m[0], at) + 1
        return -1


def _h(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


@lru_cache(65_536)
def node_key(path: bytes) -> int:
    return int.from_bytes(blake2b(path, digest_size=8).digest(), "little", signed=True)


NODES = "host string, page long, path binary, style long, said array<long>"


def style_nodes(pages: DataFrame) -> DataFrame:
    """One row for each element of each page that holds text: host, page (a hash of the html), path (hashes of the labels from the root on),
    style (a hash of how its children follow each other) and said (hashes of the sentences that stand in it and in no element below).

    An element's label is its tag with its classes and id, numbers apart; elements with the same labels from the root on are one. What a tag,
    role or name rules out is no branch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                read = Reader(page or "")
                if not read.blocks:
                    continue
                own, styles, said = _h(page), {}, {}
                for e in read.elements:
                    if e.text:
                        styles.setdefault(e.path, set()).add(">".join(e.children))
                for x in read.blocks:
                    said.setdefault(x.element.path, set()).update(map(_h, SENTENCE.split(x.text)))
                for path, seen in styles.items():
                    for col, v in zip(cols, (host, own, path, _h("\n".join(sorted(seen))), sorted(said.get(path, ()))), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["host", "page", "path", "style", "said"])

    return pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(tidy(run), NODES)


def site_tree(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The style tree of each host: host, path, m (different pages that have the element), layout, styles and content, one row an element.

    layout: the entropy of the element's styles over the m pages, to the base m, from 0 (one style) to 1 (no two agree); styles: their number.
    content: 1 less the mean entropy of its sentences, a sentence on c pages having log_m c; 1 if none is repeated, 0 if every page
    says the same, null for elements without text of their own. Equal pages of a host count once, so that copies of an article don't make it look like
    a menu. All counts are combined before they move, and a hot host is spread by element and sentence. Elements on fewer than
    ``least_pages`` pages are not judged and have no row.
    """
    nodes = style_nodes(pages).groupBy("host", "page", "path").agg(F.first("style").alias("style"), F.first("said").alias("said"))
    nodes = staged(nodes, "style-nodes")
    styles = nodes.groupBy("host", "path", "style").agg(F.count("*").cast("double").alias("c"))
    m = F.sum("c")
    elements = styles.groupBy("host", "path").agg(m.alias("m"), ((F.ln(m) - F.sum(F.col("c") * F.ln("c")) / m) / F.ln(m)).alias("layout"), F.count("*").alias("styles"))
    elements = elements.where((F.col("m") >= least_pages) & (F.col("m") > 1))
    said = nodes.select("host", "path", F.explode("said").alias("s")).groupBy("host", "path", "s").agg(F.count("*").cast("double").alias("c"))
    said = said.groupBy("host", "path").agg(F.count("*").alias("_n"), F.sum(F.ln("c")).alias("_ln"))
    both = elements.join(said, ["host", "path"], "left")
    return both.select("host", "path", "m", "layout", "styles", (1 - F.col("_ln") / (F.col("_n") * F.ln("m"))).alias("content"))


class Node:
    """An element on the way up: what its branches add, and what is known of it."""

    __slots__ = ("content", "layout", "m", "path", "styles", "sum", "weight")

    def __init__(self, path: bytes, m: float, layout: float, styles: int, content: float | None) -> None:
        self.path, self.m, self.layout, self.styles, self.content = path, m, layout, styles, content
        self.sum = self.weight = 0.0

    def importance(self) -> float:
        """The composite importance: that of the layout with the mean of the branches (own text is one), weighed by how many pages have
        them. The more layouts an element has, the more they say themselves."""
        total, weight = self.sum, self.weight
        if self.content is not None:
            total, weight = total + self.m * self.content, weight + self.m
        fade = FADE**self.styles
        # Branches that too few pages share to be judged are different everywhere.
        return (1 - fade) * self.layout + fade * (total / weight if weight else 1.0)


def composite(rows: Iterator[tuple]) -> Iterator[tuple[bytes, float, float | None]]:
    """(path, importance, content) of the elements of one host, given as (path, m, layout, styles, content) in the order of their paths,
    so that a branch follows its root. Only the open elements from the root down are held."""
    stack: list[Node] = []

    def close() -> tuple[bytes, float, float | None]:
        node = stack.pop()
        own = node.importance()
        if stack:
            up = stack[-1]
            up.sum, up.weight = up.sum + node.m * own, up.weight + node.m
        return node.path, own, node.content

    for path, m, layout, styles, content in rows:
        while stack and not path.startswith(stack[-1].path):
            yield close()
        stack.append(Node(path, m, layout, styles, content))
    while stack:
        yield close()


#: What the pages of a host get to know of an element: its composite importance and that of its own text (NaN: it has none).
JUDGED = np.dtype([("key", "<i8"), ("own", "<f4"), ("content", "<f4")])


def judged_branches(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, branches): each host's judged elements as ``JUDGED`` records; the tree is folded from its leaves up in one pass over its sorted rows.

    A host's rows are the different elements of its templates, not its pages.
    """
    tree = site_tree(pages, least_pages).repartition("host").sortWithinPartitions("host", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True))
        now, held = None, []

        def close() -> pa.RecordBatch:
            found = np.array([(node_key(p), own, np.nan if c is None else c) for p, own, c in composite(iter(held))], JUDGED)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([found.tobytes()], pa.binary())], ["host", "branches"])

        for host, *row in rows:
            if held and host != now:
                yield close()
                held = []
            now = host
            held.append(row)
        if held:
            yield close()

    return tree.mapInArrow(tidy(run), "host string, branches binary")


@lru_cache(64)
def tree_of(branches: bytes) -> dict[int, tuple[float, float]]:
    found = np.frombuffer(branches, JUDGED)
    return dict(zip(found["key"].tolist(), zip(found["own"].tolist(), found["content"].tolist(), strict=True), strict=True))


def importance_of(element: Element, tree: dict[int, tuple[float, float]]) -> float | None:
    """The importance of the element's own text; where too few pages have the element, the composite importance of the nearest one around
    it that is judged; null where none is. The root, which every page has, says nothing."""
    own = tree.get(node_key(element.path))
    if own is not None:
        return own[0] if own[1] != own[1] else own[1]
    at = element.up
    while at is not None and at.up is not None:
        if (above := tree.get(node_key(at.path))) is not None:
            return above[0]
        at = at.up
    return None


def main_text(page: str, tree: dict[int, tuple[float, float]] | None = None, least: float = LEAST_IMPORTANCE) -> str:
    """The text of the article, as the importance of its branches in the host's tree has it.

    A block is cut if its importance is below a limit, and marks move the limit: it is ``least`` on pages without any, a third of it
    in articles and main parts (where headings stay: many pages have an "Introduction"), and 1 - ``least`` for what stands beside these. What no tree judges (hosts with few pages, elements that few pages
    have) stays, but for what stands beside an article or main part. Of several articles, those with less than ``TEASER`` of the
    text of the longest are teasers; three blocks or more of links alone in like elements outside articles are a menu.
    """
    read = Reader(page)
    found = read.blocks
    marked = any(x.inside for x in found)
    sizes: Counter[int] = Counter()
    menus: Counter[bytes] = Counter()
    for x in found:
        sizes[x.article] += len(x.text)
        menus[x.element.path] += x.linked
    longest = max((n for a, n in sizes.items() if a), default=0)

    def stays(x: Block) -> bool:
        if x.article:
            if sizes[x.article] < TEASER * longest:
                return False
        elif x.linked and menus[x.element.path] >= 3:
            return False
        value = importance_of(x.element, tree) if tree else None
        if x.inside:
            return value is None or x.element.heading or value >= least / 3
        return value is not None and value >= 1 - least if marked else value is None or value >= least

    return "\n\n".join(x.text for x in found if stays(x))


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, least: float = LEAST_IMPORTANCE) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html).

    The pages of a host are merged into its style tree (``site_tree``); importance is combined from the leaves up (``composite``), and ``main_text``
    cuts the branches of low importance from each page. Elements that say what they are (menus, forms, adverts by class and the like) are no
    branches and never text; articles and main parts move the limit of importance. Hosts with fewer than ``least_pages`` different pages have no tree.

    Null html is empty and gives an empty text; a null url counts as host "". Repeated rows are extracted each. Empty tables give no rows.
    White space of any kind inside a block is one space. Other columns are not used. A hot host is one row of ``judged_branches``; pages
    are joined to it where they lie if that table is small, and else by a join that is split where it is skewed.
    """
    spark = session_of(pages)
    small_batches(spark)
    trees = staged(judged_branches(pages, least_pages), "style-tree").withColumnRenamed("host", "_h")
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("_host"))
    rows = rows.join(trees, F.col("_host") == F.col("_h"), "left").select("page_id", "url", "html", "branches")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "text", "n_chars"]
        for b in batches:
            given = zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            texts = [main_text(page or "", tree_of(branches) if branches else None, least) for page, branches in given]
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), b.column(1), pa.array(texts, pa.string()), sizes], names)

    return rows.mapInArrow(tidy(run), "page_id long, url string, text string, n_chars long")
