"""Main-text extraction by equivalence-class template deduction.

Pages of one host come from one template.  A token is a tag or a word together
with its path of open elements; tokens that occur equally often on every page
(equal occurrence vectors) form a class.  A class whose tokens keep one order on
all pages is valid; the class of tokens that occur once on each page is the root
of the template, classes that repeat inside one of its slots nest below it.
Words of valid classes are the template's own text.  What is left lies in slots.
The slots with most text that are not menus are the article's body; the element
of the template around them is the article, and its slots are extracted.  Lists of
names only drop parts of that.  A host of too few pages has no template: there
the article element, if there is one, and the lists decide.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import takewhile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, table

#: Pages of a host whose template is deduced together, on average; a larger host is dealt to such groups by a hash.
GROUP = 256
#: Groups of GROUP pages that a task has, on average; the number of tasks grows with the table.
GROUPS = 4
#: Hosts of more than GROUP pages up to which their table is broadcast.
HOSTS = 100_000
#: Different pages below which a host says nothing about its template.
LEAST = 4
#: Tokens that make a class large enough to belong to a template.
CLASS_TOKENS = 3
#: Share of link words, and links of a page, from which a slot is a menu.
LINKS, MENU = 0.5, 3
#: Share of the largest slot's words from which a slot is part of the body as well.
MASS = 0.2
#: Elements that hold no text of the article, wherever they are.
DROP = {"head", "nav", "footer", "aside", "form", "noscript", "template", "button", "select", "svg", "iframe", "menu", "dialog", "object", "canvas"}
#: Whole values of a class, an id or a role that mark such an element: a name alone,
#: or with a word of place before it and a word of form after it.
NAMES = re.compile(
    r"^(?:(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|sidebar|related|recommended|share|sharing|social|comments?|disqus|replies|nav|navigation|navbar|navmenu|menus?|breadcrumbs?|footer|pagination|pager|widget|toolbar|login|signup|search|hidden|complementary|contentinfo)"
    r"|(?:(?:site|page|main|top|bottom|global|primary|secondary|left|right|post|entry|article)[-_])?(?:ads?|banner|cookies?|newsletter|sidebar|related|recommended|share|sharing|social|comments?|nav|navigation|navbar|menu|breadcrumbs?|footer|pagination|pager|search|login)(?:[-_](?:list|links|bar|box|area|section|block|form|buttons|icons|menu|posts|articles|items|notice|banner|consent|signup|popup|modal|slot|unit|left|right))?)$"
)
#: The same for the head of a page; inside an article they hold its headline.
HEAD_NAMES = re.compile(r"^(?:(?:site|main|top|global)[-_])?(?:header|masthead)$")
#: Elements that hold an article.
ARTICLE = {"article", "main"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Blocks that hold text and no other slots.
TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "address", "figcaption"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp"}
#: An element of the key is closed by the start of an element of the value.
CLOSED_BY = {"p": BLOCKS - {"br", "td", "th", "li", "body", "html", "caption"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"}, "head": {"body"}}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Element:
    """An open element: its path of names, and what its ancestors say about it.

    It is barred by its tag or as unseen, dropped by its names as well; named if its own names say so.
    """

    tag: str
    path: str
    barred: bool
    dropped: bool
    named: bool
    article: bool
    link: bool


@dataclass
class Block:
    """Text of one block: its element, its words, the words inside links, and the links."""

    element: Element
    words: list[str]
    linked: int
    links: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    elements: dict[str, Element] = field(default_factory=dict)


def _tag(path: str) -> str:
    """The tag of a path's last element."""
    return path.rpartition("/")[2].partition(".")[0]


def _open(parent: Element | None, tag: str, attributes: str, spared: frozenset[str] = frozenset()) -> Element:
    names = [w for m in _ATTRIBUTE.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split()] if attributes else []
    label = tag + "".join(f".{n}" for n in sorted(set(names)))
    path = f"{parent.path}/{label}" if parent else label
    inside = bool(parent and parent.article)
    named = tag not in ("html", "body", *ARTICLE) and path not in spared and any(NAMES.match(n) or (not inside and HEAD_NAMES.match(n)) for n in names)
    article = inside or tag in ARTICLE
    barred = bool(parent and parent.barred) or tag in DROP or (tag == "header" and not inside) or bool(attributes and _UNSEEN.search(attributes))
    return Element(tag, path, barred, barred or named or bool(parent and parent.dropped), named, article, tag == "a" or bool(parent and parent.link))


def parse(source: str | None, spared: frozenset[str] = frozenset()) -> Page:
    """Tags and blocks of text of a page, in page order; forgiving about missing end tags.

    Names drop no element of the paths spared.  Where they would drop every
    article or main element of a page, those around these are spared.
    """
    page, stack = Page(), [_open(None, "", "")]
    around: set[str] = set()
    pieces: list[str] = []
    linked = links = 0
    text, at = source or "", 0

    def flush() -> None:
        nonlocal linked, links
        if pieces:
            words = entities.unescape("".join(pieces)).split()
            if words:
                page.blocks.append(Block(owner, words, min(linked, len(words)), links))
            pieces.clear()
            linked = links = 0

    owner = stack[0]

    def say(piece: str) -> None:
        nonlocal linked, links, owner
        if not pieces:
            owner = stack[-1]
        pieces.append(piece)
        if stack[-1].link:
            linked += len(piece.split())
            links += bool(piece.strip())

    while at < len(text):
        m = _TOKEN.search(text, at)
        if not m:
            say(text[at:])
            break
        if m.start() > at:
            say(text[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
            if any(e.tag == tag for e in stack[1:]):
                if stack[-1].dropped:
                    flush()
                while stack.pop().tag != tag:
                    pass
                page.tags.append(f"{stack[-1].path}/</{tag}")
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>|\Z", re.I).search(text, at)
            at = end.end()
            continue
        if tag in BLOCKS:
            flush()
        while len(stack) > 1:
            closing = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in CLOSED_BY), 0)
            if not closing or tag not in CLOSED_BY[stack[closing].tag] or any(e.tag in BLOCKS and e.tag not in CLOSED_BY for e in stack[closing + 1 :]):
                break
            del stack[closing:]
        element = _open(stack[-1], tag, m[3], spared)
        if tag in ARTICLE and not element.barred:
            around |= {e.path for e in stack if e.named}
        page.tags.append(element.path)
        page.elements.setdefault(element.path, element)
        if element.dropped != stack[-1].dropped:
            flush()
        if tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(element)
    flush()
    if around and not any(b.element.article and not b.element.dropped for b in page.blocks):
        return parse(source, spared | around)
    return page


class Template:
    """Valid classes of a group of pages of one host: paths of root tags, words of the template, the article's slots."""

    def __init__(self, pages: list[Page]):
        """pages differ from each other; fewer than LEAST of them give no class."""
        n = len(pages)
        found: dict[tuple[str, str], dict[int, int]] = defaultdict(dict)
        for i, page in enumerate(pages):
            for path, count in Counter(page.tags).items():
                found[path, ""][i] = count
            for token, count in Counter((b.element.path, w) for b in page.blocks for w in b.words).items():
                found[token][i] = count
        vectors: dict[tuple[int, ...], list[tuple[str, str]]] = defaultdict(list)
        for token, counts in found.items():
            if 2 * len(counts) > n:
                vectors[tuple(counts.get(i, 0) for i in range(n))].append(token)
        classes = {v: t for v, t in vectors.items() if len(t) >= CLASS_TOKENS} if n >= LEAST else {}
        wanted = {t for tokens in classes.values() for t in tokens}
        order = [self._order(p, wanted) for p in pages]
        self.root: set[str] = set()
        self.slots: dict[str, str] = {}
        self.words: set[tuple[str, str]] = set()
        self.nested: list[tuple[str, set[str]]] = []
        for vector, tokens in sorted(classes.items(), key=lambda x: (max(x[0]) > 1, -len(x[1]))):
            valid = self._valid(vector, set(tokens), order)
            own = {p for p, w in valid if not w}
            if max(vector) == 1:
                self.root |= {p for p in own if "/</" not in p}
            elif own and len(slots := {self.slot(p) for p in own}) == 1:
                self.nested.append((slots.pop(), own))
            if min(vector) and (own or max(vector) == 1):
                self.words |= {t for t in valid if t[1]}
        self.article, self.menus = self._article(pages)

    @staticmethod
    def _order(page: Page, wanted: set) -> list[tuple[str, str]]:
        """Tokens of classes in page order: tags in theirs, then words in theirs."""
        return [(t, "") for t in page.tags if (t, "") in wanted] + [(b.element.path, w) for b in page.blocks for w in b.words if (b.element.path, w) in wanted]

    @staticmethod
    def _valid(vector: tuple[int, ...], tokens: set, order: list[list]) -> set:
        """The tokens of a class, if they keep one order, over and over, on every page; else none, or the tags alone."""
        first = None
        for count, seen in zip(vector, order, strict=True):
            own = [t for t in seen if t in tokens]
            first = first or own[: len(tokens)]
            if own != first * count:
                tags = {t for t in tokens if not t[1]}
                return Template._valid(vector, tags, order) if CLASS_TOKENS <= len(tags) < len(tokens) else set()
        return tokens

    def slot(self, path: str) -> str:
        """The deepest root tag of the template that a path lies in."""
        if path not in self.slots:
            own = path
            while own and own not in self.root:
                own = own.rpartition("/")[0]
            self.slots[path] = own
        return self.slots[path]

    def _article(self, pages: list[Page]) -> tuple[str, set[str]]:
        """Path (with a final slash) of the element around the slots with most text, and the slots that are menus.

        Slots that the lists name do not count, unless all are named.
        """
        words, linked, links, named = Counter(), Counter(), Counter(), Counter()
        for page in pages:
            for block in page.blocks:
                slot = self.slot(block.element.path)
                words[slot] += len(block.words)
                linked[slot] += block.linked
                links[slot] += block.links
                named[slot] += len(block.words) * block.element.dropped
        heavy = {s for s in words if linked[s] >= LINKS * words[s]}
        menus = {s for s in heavy if links[s] >= MENU * len(pages)}
        body = {s for s in words if s not in heavy and 2 * named[s] <= words[s]} or set(words) - heavy or set(words)
        most = max((words[s] for s in body), default=0)
        return self._around({s for s in body if words[s] >= MASS * most}), menus

    @staticmethod
    def _around(slots: set[str]) -> str:
        """Path, with a final slash, of the deepest element around all slots that is not a paragraph or a heading itself."""
        if not slots:
            return ""
        common = [x[0] for x in takewhile(lambda x: len(set(x)) == 1, zip(*(s.split("/") for s in slots)))]
        while common and _tag(common[-1]) in TEXT:
            common.pop()
        return "".join(f"{x}/" for x in common)

    def constant(self, block: Block) -> bool:
        """Whether a block is the template's own text."""
        return bool(self.words) and all((block.element.path, w) in self.words for w in block.words)

    def extract(self, page: Page) -> str:
        """The page's text inside the article, without menus, what the lists name, and the template's own text.

        Where that would leave less than half of the words, the pages of the group
        are near copies, whose common words are no template: they stay.  Where
        names drop all text of the article, they do not count.  A page without
        the article of its template is read like one of a host without template;
        where no class is valid, the whole page is one slot and all of it stays.
        """
        if not self.root:
            return _joined(page.blocks)
        inside = [b for b in page.blocks if f"{b.element.path}/".startswith(self.article) and self.slot(b.element.path) not in self.menus]
        own = [b for b in inside if not b.element.dropped] or [b for b in inside if not b.element.barred]
        if not own:
            return alone(page)
        free = [b for b in own if not self.constant(b)]
        return _joined(free if 2 * sum(len(b.words) for b in free) >= sum(len(b.words) for b in own) else own)


def _joined(blocks: list[Block]) -> str:
    return "\n".join(" ".join(b.words) for b in blocks)


def alone(page: Page) -> str:
    """The text of a page whose host has no template: its article elements, or all, without what the lists name."""
    kept = [b for b in page.blocks if not b.element.dropped] or [b for b in page.blocks if not b.element.barred]
    return _joined([b for b in kept if b.element.article] or kept)


def _group_texts(sources: list[str | None]) -> list[str]:
    """Main texts of pages of one host."""
    pages = {s: parse(s) for s in dict.fromkeys(sources)}
    template = Template(list(pages.values())) if len(pages) >= LEAST else None
    texts = {s: template.extract(p) if template else alone(p) for s, p in pages.items()}
    return [texts[s] for s in sources]


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by host and group; equal sources are held once."""
    now, rows, sources = None, [], {}
    kind = pa.int64()

    def answer() -> pa.RecordBatch:
        texts = _group_texts(list(sources))
        own = [texts[r[2]] for r in rows]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]).cast(kind), pa.array([r[1] for r in rows], pa.string()), pa.array(own, pa.string()), pa.array([len(t) for t in own], pa.int64())], names=["id", "url", "text", "n_chars"])

    for batch in batches:
        kind = batch.schema.field(2).type
        for host, group, i, url, source in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (host, group) != now:
                if rows:
                    yield answer()
                now, rows, sources = (host, group), [], {}
            rows.append((i, url, sources.setdefault(source, len(sources))))
    if rows:
        yield answer()


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of pages, from its whole source.

    A host of more than GROUP pages is dealt to groups of about that many by a
    hash of id, url and source, so a host that holds a third of all rows is many
    groups; each group has its template.  Groups, and so texts, do not depend on
    partitions.  A host of fewer than LEAST different pages has no template.  A
    null source or one without text gives an empty text; a null url counts as a
    host of its own; repeated rows are extracted each; an empty table gives no
    rows; further columns are ignored.  Hosts are counted on narrow rows (an action);
    the few large ones are broadcast if they are at most HOSTS, and sources are then
    shuffled once.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(host.alias("host"), F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    hosts = durable(rows.groupBy(F.col("host").alias("of")).count())
    total = hosts.agg(F.sum("count")).first()[0] or 0
    large = hosts.where(F.col("count") > GROUP).select("of", F.ceil(F.col("count") / GROUP).alias("groups"))
    large = F.broadcast(large) if large.count() <= HOSTS else large
    group = F.pmod(F.xxhash64("id", "url", "html"), F.coalesce("groups", F.lit(1))).alias("group")
    dealt = rows.join(large, F.col("host") == F.col("of"), "left").select("host", group, "id", "url", "html")
    parts = max(-(-total // (GROUPS * GROUP)), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sorted_ = dealt.repartition(parts, "host", "group").sortWithinPartitions("host", "group")
    return sorted_.mapInArrow(_extract, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every page."""
    return main_text(table(spark, sf_dir, "pages"))
