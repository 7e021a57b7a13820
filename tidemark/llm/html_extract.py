"""HTML extraction by tree scoring: paragraphs pass points to their ancestors, and the best container gives the text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A comment, a section of plain characters, a declaration, or a tag; a tag with an open quote ends at its first ">".
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<plain>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
#: Elements whose content is never text of the page.
RAW = frozenset("script style template noscript textarea iframe object svg math head title select canvas xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that break a text into blocks.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold menus, headers, footers, sidebars and forms.
SIDE = frozenset("nav header footer aside form button dialog menu fieldset".split())
NEGATIVE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adsby\w*|ad(?:box|slot|unit|space|wrap\w*)s?|banner|sponsor\w*|promo\w*|comments?|comment(?:list|er|form|area|box|section|thread)\w*|discussions?|disqus\w*|reply|replies|respond|responses?|footer|foot|header|masthead|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|widget\w*|related\w*|recommend\w*|share|sharing|social\w*|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|pagination|pager|paging|toolbar|skip|hidden|copyright|legal|disclaimer|complementary|contentinfo|navigation)(?:$|[\s_-])",
    re.I,
)
#: Names of what is never the frame of an article, however long it is; and of parts of a layout, which may be alike.
NEVER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsby\w*|comments?|comment(?:list|er|form|area|box|section|thread)\w*|discussions?|disqus\w*|reply|replies|respond|responses?|nav\w*|menu\w*|footer|sidebar\w*|cookie\w*|consent|gdpr|newsletter|popup|modal|overlay|hidden|related\w*|recommend\w*)(?:$|[\s_-])", re.I)
LAYOUT = re.compile(r"(?:^|[\s_-])(?:col\w*|grid|row|cell|box|panel|wrap\w*|container|left|right|card|tile|item|span\d*)(?:$|[\s_-])", re.I)
POSITIVE = re.compile(r"(?:^|[\s_-])(?:article\w*|body|content\w*|entry|main|page|post\w*|text|story|blog)(?:$|[\s_-])", re.I)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: What an open paragraph or item is closed by.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table", "select")
#: Elements that an inline end tag does not close anything outside of.
HOLDS = ("td", "th", "table", "article", "body")
#: Elements of running text: aside by name only where a whole name says so.
PROSE = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 pre blockquote caption figcaption".split())
SCOPE = frozenset("table td th ul ol dl body html div article section main aside nav header footer form blockquote".split())
SPACE = re.compile(r"\s+")


#: Elements that may hold an article.
FRAME = frozenset("article main section div td body html blockquote center".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "weight", "side", "names", "score", "chars", "linked", "commas", "frame")

    def __init__(self, tag: str, parent: "Node | None", weight: float = 0.0, side: bool = False, names: str = ""):
        self.tag, self.parent, self.kids, self.weight, self.side, self.names = tag, parent, [], weight, side, names
        self.score = 0.0
        self.frame = None if parent is None else parent if parent.tag in FRAME else parent.frame
        self.chars = self.linked = self.commas = 0


def _judge(tag: str, attrs: str) -> tuple[float, bool, str]:
    """Weight of an element by its names, whether it stands aside from the text, and its names.

    Names set block elements aside, never inline ones; an element of running text only by a whole name, so that `notice`
    does and `hidden-gem` does not. Hidden elements of either kind stand aside.
    """
    side = tag in SIDE
    if not attrs.strip():
        return 0.0, side, ""
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attrs)}
    names = " ".join(found.get(k, "") for k in ("class", "id", "role"))
    negative, positive = bool(NEGATIVE.search(names)), bool(POSITIVE.search(names))
    gone = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    named = negative and tag in BLOCK and not (positive and tag in ("article", "main"))
    if named and tag in PROSE:
        named = any((m := NEGATIVE.match(name)) and m.end() == len(name) for name in names.split())
    return 25.0 * positive - 25.0 * negative * (tag in BLOCK), side or gone or named and tag not in ("body", "html", "article", "main"), (names + " hidden" * gone).strip()


class _Open:
    """The open elements, outermost first, and where each name last stands among them; closing costs what it closes."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def last(self, *tags: str) -> int:
        """Place of the innermost open element of these names; 0, the root, for none."""
        return max((places[-1] for t in tags if (places := self.at.get(t))), default=0)

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        while len(self.nodes) > place:
            self.at[self.nodes.pop().tag].pop()


def parse(html: str) -> Node:
    """The page as a tree. Unclosed and crossed elements are closed as far as needed; nothing is dropped but RAW content.

    Work grows with the length of the page, however malformed: an end without its start costs a look at the names that are
    open, and a RAW element that is never closed is looked for once.
    """
    root = Node("html", None)
    open_, endless = _Open(root), set()
    at, upto = 0, len(html)
    while at < upto:
        m, here = TOKEN.search(html, at), open_.nodes[-1]
        if not m:
            here.kids.append(unescape(html[at:]))
            break
        if m.start() > at:
            here.kids.append(unescape(html[at : m.start()]))
        at = m.end()
        if m["plain"]:
            here.kids.append(m["plain"])
        if not (tag := m["tag"]):
            continue
        tag, attrs = tag.lower(), m["attrs"]
        if m["end"]:
            place = open_.last(tag)
            if place and (tag in BLOCK or place >= open_.last(*HOLDS)):
                open_.close(place)
            elif tag == "p":
                here.kids.append(Node("p", here))
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at) if tag not in endless and not attrs.endswith("/") else None
            if end:
                at = end.end()
            elif not attrs.endswith("/"):
                endless.add(tag)
            if not end and tag in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"):
                at = upto
            continue
        if tag in ("html", "body"):
            here.kids.append("\n")
            continue
        if tag in BLOCK and (place := open_.last("p")) > open_.last(*SCOPE):
            open_.close(place)  # a block start ends an open paragraph, and what is open inside it
        if (shut := CLOSES.get(tag)) and (place := open_.last(*shut)) > open_.last(*LISTS):
            open_.close(place)
        here = open_.nodes[-1]
        node = Node(tag, here, *_judge(tag, attrs))
        here.kids.append(node)
        if tag not in VOID and not attrs.endswith("/"):
            open_.push(node)
    return root


def _frames(root: Node) -> None:
    """Side elements that hold the page's text are its frame, such as a form around everything: they stand aside no more.

    An element is one if its running text outside further side elements, in pieces of 80 characters or more that are not
    links, is over four times that of the page outside side elements. Menus, footers, comments and what is hidden never are.
    """
    order, stack = [], [(root, False, False)]
    while stack:
        node, linked, aside = stack.pop()
        linked, aside = linked or node.tag == "a", aside or node.side
        order.append((node, linked, aside))
        stack.extend((k, linked, aside) for k in node.kids if isinstance(k, Node))
    long = {}
    for node, linked, _ in reversed(order):
        own = 0 if linked else sum(n for k in node.kids if isinstance(k, str) and (n := len(k.strip())) >= 80)
        long[node] = own + sum(long[k] for k in node.kids if isinstance(k, Node) and not k.side)
    for node, _, aside in order:
        if node.side and node.tag not in ("nav", "footer", "menu", "dialog", "button") and not NEVER.search(node.names) and long[node] > 4 * long[root]:
            node.side = False
            up = node.parent
            while up is not None:
                long[up] += long[node]
                if up.side:
                    break
                up = up.parent


def _count(root: Node) -> list[Node]:
    """All nodes outside side elements in page order, with characters, characters in links and commas summed upward."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and not k.side)
    for node in reversed(order):
        for k in node.kids:
            if isinstance(k, str):
                if text := k.strip():
                    node.chars += len(text)
                    node.commas += text.count(",") + text.count("，") + text.count("、")
        if node.tag == "a":
            node.linked = node.chars
        if node.parent is not None:
            up = node.parent
            up.chars, up.linked, up.commas = up.chars + node.chars, up.linked + node.linked, up.commas + node.commas
    return order


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _own_block(node: Node) -> bool:
    return not any(isinstance(k, Node) and k.tag in BLOCK for k in node.kids)


def best(root: Node) -> list[Node]:
    """The containers that hold the article: the best by points and those of its siblings that look like it."""
    _frames(root)
    order = _count(root)
    seen = []
    for node in order:
        if node.tag not in ("p", "pre", "td", "blockquote", "li", "h1", "h2", "h3") and not (node.tag in FRAME and _own_block(node)):
            continue
        if node.chars < 25 or node.parent is None:
            continue
        points = (1 + node.commas + min(node.chars / 100, 3)) * (1 - _density(node))
        up, share = node if node.tag in FRAME else node.frame, 1.0
        for level in range(4):
            if up is None:
                break
            seen.append(up)
            up.score += points * share
            share = 0.5 if level == 0 else 0.5 / (level + 1)
            up = up.frame
    ranked = {id(n): n for n in seen}.values()
    if not ranked:
        return [root]
    value = lambda n: (n.score + n.weight + (25 if n.tag in ("article", "main") else 0)) * (1 - _density(n))
    top = max(ranked, key=value)
    # an article or main element around the best container is its frame
    node = top.parent
    while node is not None:
        if node.tag in ("article", "main"):
            top = node
        node = node.parent
    if top.parent is None:
        return [top]
    least = max(10.0, 0.2 * value(top))
    kept = []
    for k in top.parent.kids:
        if not isinstance(k, Node) or k.side:
            continue
        alike = k.tag == top.tag and k.weight == top.weight and k.weight > 0
        same = k.tag == top.tag and k.names and k.names == top.names and k.weight >= 0 and k.chars and not LAYOUT.search(k.names) and _density(k) < 0.25
        if k is top or same or (k.tag in FRAME and value(k) + (0.2 * value(top) if alike else 0) >= least and _density(k) < 0.25):
            kept.append(k)
        elif k.tag in ("p", "pre", "blockquote", "ul", "ol", "h1", "h2", "h3") and k.chars and top.tag not in ("article", "main") and _density(k) < 0.25:
            kept.append(k)
    return kept


def text_of(nodes: list[Node]) -> str:
    """Blocks of the nodes in page order, white space inside one made one space, joined by an empty line."""
    blocks: list[str] = []
    now: list[str] = []

    def end():
        if text := SPACE.sub(" ", "".join(now)).strip():
            blocks.append(text)
        now.clear()

    stack: list = list(reversed(nodes))
    while stack:
        k = stack.pop()
        if k is None:
            end()
        elif isinstance(k, str):
            now.append(k)
        elif k.side:
            end()
        elif k.tag == "br":
            now.append(" ")
        elif k.tag in BLOCK or k.tag == "html":
            end()
            stack.append(None)
            stack.extend(reversed(k.kids))
        else:
            stack.extend(reversed(k.kids))
    end()
    return "\n\n".join(blocks)


def main_text(html: str | None) -> str:
    """The text of the best containers; where these leave none, a form around the page is its frame, however short its lines."""
    if not html:
        return ""
    if text := text_of(best(parse(html))):
        return text
    root = parse(html)
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag in ("form", "fieldset") and not NEGATIVE.search(node.names):
            node.side = False
        if not node.side:
            stack.extend(k for k in node.kids if isinstance(k, Node))
    return text_of(best(root))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without `html_col`, with `text`, the main text of each page, and `n_chars`, its code points.

    Null and empty html give the empty text. Malformed html is read as far as it goes, in time that grows with its
    length. A `header` element goes wherever it stands, an article's own with it. A page without anything that
    looks like an article gives what is left of its body outside menus and the like. Clashing columns `text` and
    `n_chars` of the input are replaced; other columns pass; rows that repeat are read each. One narrow map over the table: no shuffle.
    """
    rest = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    kept = pages.select(*rest, F.col(html_col).alias("_html"))
    schema = kept.drop("_html").withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [main_text(x) for x in part.column("_html").to_pylist()]
                arrays = [part.column(c) for c in rest] + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, [*rest, "text", "n_chars"])

    return kept.mapInArrow(run, schema)
