"""Text of web pages as a reader would see it.

A tree builder with implied end tags, visibility rules, and a renderer that
keeps block spacing, list markers and table columns. Row-local per page.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements nested deeper are laid beside one another in the tree, as browsers do; they
#: stay open and hide what they would hide. No text is lost.
MAX_DEPTH = 200
#: Fixed values of the HTML standard: greatest colspan and rowspan. A rowspan of 0 goes on
#: to the end of its group of rows.
MAX_COLSPAN = 1000
MAX_ROWSPAN = 65534
SPAN = re.compile(r"[ \t\n\f\r]*\+?0*([0-9]+)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript title meta link base object iframe canvas audio video datalist param source track".split())
#: Elements of SVG and MathML whose content is not shown; the rest is inline text.
#: What ``use`` elements repeat is not repeated.
FOREIGN = frozenset(("svg", "math"))
FOREIGN_HIDDEN = frozenset("title desc metadata defs symbol annotation annotation-xml".split())
#: Labels and cells, which stand apart.
FOREIGN_APART = frozenset("text mtr mlabeledtr mtd".split())
#: Inside these markup is HTML again.
INTEGRATION = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: HTML that ends an open SVG or MathML element.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure fieldset form details".split())
LINE = frozenset(
    "html body div section article aside nav header footer main address li dt dd figcaption hgroup legend summary "
    "center caption option optgroup dialog menu search tr td th thead tbody tfoot noframes".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section table ul".split()
)
#: A start tag ends these open elements, up to the nearest scope.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, {"html"}),
}
#: Inside head only these may stand; anything else begins the body.
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
BARRIER = frozenset("table td th caption button object template".split())
STYLE_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attrs", "children", "foreign", "holds_foreign", "home", "gone", "closed")

    def __init__(self, tag: str, attrs: dict, parent: Node | None = None):
        self.tag, self.attrs, self.children = tag, attrs, []
        #: Whether it is inside SVG or MathML, and whether its children are.
        self.foreign = parent is not None and parent.holds_foreign
        self.holds_foreign = tag in FOREIGN or (self.foreign and tag not in INTEGRATION)
        #: For elements below the depth limit: the element of the tree that takes their
        #: content, whether they are hidden, and whether their content is.
        self.home, self.gone, self.closed = self, False, False


class TreeBuilder(HTMLParser):
    """Elements with their implied end tags; text and elements in order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("root", {})
        self.stack = [self.root]
        #: Places of the open elements in the stack, by tag.
        self.places: dict[str, list[int]] = defaultdict(list)

    def _last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def _cut(self, depth: int) -> None:
        """End all elements from this place of the stack on."""
        for node in self.stack[depth:]:
            self.places[node.tag].pop()
            self._mark(node)
        del self.stack[depth:]

    def _close(self, tags, scope) -> None:
        """End the outermost of ``tags`` that is open inside ``scope``."""
        if not any(self.places.get(t) for t in tags):
            return
        floor, found = self._last(scope), len(self.stack)
        for tag in tags:
            places = self.places.get(tag) or []
            i = bisect_right(places, floor)
            if i < len(places):
                found = min(found, places[i])
        self._cut(found)

    def handle_starttag(self, tag, attrs):
        if tag in BREAKOUT:
            while self.stack[-1].holds_foreign:
                self._cut(len(self.stack) - 1)
        if (self.places.get("head") or [4])[0] < 4 and tag not in HEAD_ONLY and tag != "head":
            self._close({"head"}, {"html"})
        if tag in CLOSES_P:
            self._close({"p"}, BARRIER)
        if tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6") and re.fullmatch(r"h[1-6]", self.stack[-1].tag):
            self._cut(len(self.stack) - 1)
        if tag in IMPLIED:
            self._close(*IMPLIED[tag])
        if tag in ("td", "th") and self.stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", {})
        self._push(tag, dict(attrs))

    def _push(self, tag, attrs):
        parent = self.stack[-1]
        node = Node(tag, attrs, parent)
        depth = len(self.stack)
        # The summary of the deepest details is the one thing of it that is shown.
        if parent.home is parent and (depth < MAX_DEPTH or (depth == MAX_DEPTH and tag == "summary" and parent.tag == "details")):
            parent.children.append(node)
        else:
            self._flatten(node, parent)
        if tag not in VOID:
            self.places[tag].append(depth)
            self.stack.append(node)

    def _flatten(self, node: Node, parent: Node) -> None:
        """An element below the limit: empty ones in the tree mark its start and end."""
        node.home = parent.home
        first = node.tag == "summary" and parent.tag == "details" and not any(c.tag == "summary" for c in parent.children)
        node.gone = hidden(node) or (parent.gone if first else parent.closed)
        node.closed = node.gone or (node.tag == "details" and "open" not in node.attrs)
        if parent.home is not parent and first:
            parent.children.append(node)
        self._mark(node)

    def _mark(self, node: Node) -> None:
        if node.home is not node and not node.gone:
            mark = Node(node.tag, node.attrs)
            mark.foreign = node.foreign
            node.home.children.append(mark)

    def handle_startendtag(self, tag, attrs):
        depth, within = len(self.stack), self.stack[-1].holds_foreign
        self.handle_starttag(tag, attrs)
        # Only there a slash ends the element.
        if tag in FOREIGN or (within and tag not in BREAKOUT):
            self._cut(min(depth, len(self.stack)))

    def handle_endtag(self, tag):
        if tag == "br":
            self._push("br", {})
            return
        if tag == "p" and not self.places.get("p"):
            self._push("p", {})
        stop = {"table"} if tag != "table" else frozenset()
        if tag in ("ul", "ol", "dl", "table", "body", "html"):
            stop = frozenset()
        place = self._last((tag,))
        if place and self._last(stop) <= place:
            self._cut(place)

    def handle_data(self, data):
        top = self.stack[-1]
        if top.tag == "head" and data.strip():
            self._cut(len(self.stack) - 1)
            top = self.stack[-1]
        if not top.closed:
            top.home.children.append(data)


def hidden(node: Node) -> bool:
    attrs = node.attrs
    if node.foreign:
        if node.tag in FOREIGN_HIDDEN or (attrs.get("display") or "").strip().lower() == "none":
            return True
        if (attrs.get("visibility") or "").strip().lower() in ("hidden", "collapse"):
            return True
    elif "hidden" in attrs:
        return True
    if node.tag in HIDDEN:
        return True
    if node.tag == "input" and (attrs.get("type") or "").strip().lower() in ("hidden", "password", "checkbox", "radio", "file", "image"):
        return True
    if node.tag == "dialog" and "open" not in attrs:
        return True
    return bool(STYLE_HIDES.search(attrs.get("style") or ""))


class Renderer:
    """Lines of one block flow. ``gap`` is the number of line ends still owed."""

    def __init__(self, pre: bool = False, depth: int = 0):
        self.lines: list[str] = []
        self.current: list[str] = []
        self.space = False
        self.gap = 0
        self.pre = pre
        self.depth = depth
        self.lead = ""

    def text(self, data: str) -> None:
        if self.pre:
            for i, line in enumerate(data.replace("\r\n", "\n").split("\n")):
                if i:
                    self.line_end()
                if line:
                    self._put(line)
            return
        parts = SPACE.split(data)
        for i, word in enumerate(parts):
            if i:
                self.space = True
            if word:
                if self.space and self.current:
                    self.current.append(" ")
                self.space = False
                self._put(word)

    def _put(self, word: str) -> None:
        if not self.current:
            self._settle()
            if self.lead:
                self.current.append(self.lead)
                self.lead = ""
        self.current.append(word)

    def _settle(self) -> None:
        if self.lines and self.gap > 1 and self.lines[-1] != "":
            self.lines.append("")
        self.gap = 0

    def line_end(self) -> None:
        """A forced line break."""
        if not self.current:
            self._settle()
        self.lines.append("".join(self.current).rstrip())
        self.current, self.space = [], False

    def block(self, size: int) -> None:
        """A block border: 1 for a new line, 2 for a blank line as well."""
        if self.current:
            self.lines.append("".join(self.current).rstrip())
            self.current = []
        self.space = False
        self.gap = max(self.gap, size)

    def insert(self, lines: list[str], indent: str = "", marker: str = "") -> None:
        """Finished lines of an inner flow."""
        if not lines and not marker.strip():
            return
        self._settle()
        for i, line in enumerate(lines or [""]):
            self.lines.append(((marker if i == 0 else indent) + line).rstrip())

    def finish(self) -> list[str]:
        self.block(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        while self.lines and not self.lines[0]:
            self.lines.pop(0)
        return self.lines

    def children(self, node: Node) -> None:
        for child in node.children:
            self.text(child) if isinstance(child, str) else self.element(child)

    def element(self, node: Node) -> None:
        tag = node.tag
        if hidden(node):
            return
        if tag == "br":
            self.line_end()
        elif tag == "hr":
            self.block(2)
        elif tag == "img":
            self.text(node.attrs.get("alt") or "")
        elif tag == "input":
            self.text(" " + (node.attrs.get("value") or node.attrs.get("placeholder") or "") + " ")
        elif tag == "wbr":
            pass
        elif node.foreign and tag in FOREIGN_APART:
            self.text(" ")
            self.children(node)
            self.text(" ")
        elif tag in ("ul", "ol", "menu"):
            self.list(node)
        elif tag == "table":
            self.block(2)
            self.insert(table_lines(node, self.depth))
            self.block(2)
        elif tag == "pre":
            self.block(2)
            inner = Renderer(True, self.depth + 1)
            inner.children(node)
            self.insert(inner.finish())
            self.block(2)
        elif tag in ("blockquote", "dd"):
            self.block(2 if tag == "blockquote" else 1)
            inner = Renderer(self.pre, self.depth + 1)
            inner.children(node)
            self.insert(inner.finish(), "  ", "  ")
            self.block(2 if tag == "blockquote" else 1)
        elif tag == "details" and "open" not in node.attrs:
            self.block(2)
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary":
                    self.element(child)
                    break
            self.block(2)
        elif tag == "li":
            self.item(node, "- ")
        elif tag in PARAGRAPH or tag in LINE:
            size = 2 if tag in PARAGRAPH else 1
            self.block(size)
            self.children(node)
            self.block(size)
        else:
            self.children(node)

    def item(self, node: Node, marker: str) -> None:
        self.block(1)
        inner = Renderer(self.pre, self.depth + 1)
        inner.children(node)
        lines = inner.finish()
        if lines:
            self.insert(lines, " " * len(marker), marker)
        self.block(1)

    def list(self, node: Node) -> None:
        self.block(2 if self.depth == 0 else 1)
        number = int(node.attrs["start"]) if re.fullmatch(r"-?\d{1,9}", node.attrs.get("start") or "") else 1
        for child in node.children:
            if isinstance(child, str):
                self.text(child)
            elif child.tag == "li" and not hidden(child):
                value = child.attrs.get("value") or ""
                number = int(value) if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", value) else number
                self.item(child, f"{number}. " if node.tag == "ol" else "- ")
                number += 1
            else:
                self.element(child)
        self.block(2 if self.depth == 0 else 1)


def _span(node: Node, name: str, most: int) -> int:
    found = SPAN.match(node.attrs.get(name) or "")
    if not found:
        return 1
    return min(int(found[1]), most) if len(found[1]) <= len(str(most)) else most


def table_lines(table: Node, depth: int) -> list[str]:
    """Rows of cells in aligned columns, two spaces apart; captions first."""
    captions, rows = [], []
    group = 0  # rows that stand in one thead, tbody or tfoot, or between those

    def walk(node: Node) -> None:
        nonlocal group
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    captions.append(child)
            elif hidden(child):
                continue
            elif child.tag in ("thead", "tbody", "tfoot"):
                group += 1
                walk(child)
                group += 1
            elif child.tag == "tr":
                rows.append((group, child))
            else:
                captions.append(child)

    walk(table)
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # column: rows still covered from above
    before = 0
    for group, row in rows:
        if group != before:
            taken, before = {}, group  # no cell reaches into the next group
        cells, column, following = [], 0, {}
        loose = Node("td", {})
        nodes = []
        for child in row.children:
            if isinstance(child, Node) and child.tag in ("td", "th"):
                nodes.append(child)
            elif isinstance(child, Node) or child.strip():
                loose.children.append(child)
        for cell in nodes + [loose] * bool(loose.children):
            while taken.get(column, 0) > 0:
                column += 1
            wide = max(_span(cell, "colspan", MAX_COLSPAN), 1)
            tall = _span(cell, "rowspan", MAX_ROWSPAN) or len(rows)
            if not hidden(cell):
                inner = Renderer(False, depth + 1)
                inner.children(cell)
                cells.append((column, wide, inner.finish()))
            if tall > 1:
                following |= {column + i: tall for i in range(wide)}
            column += wide
        taken = {c: n - 1 for c, n in (taken | following).items() if n > 1}
        grid.append(cells)
    width: dict[int, int] = {}
    for cells in grid:
        for column, wide, lines in cells:
            if wide == 1:
                longest = max(map(len, lines), default=0)
                width[column] = max(width.get(column, 0), longest)
    columns = sorted({c for cells in grid for c, _, lines in cells if lines})
    start, at = {}, 0
    for c in columns:
        start[c] = at
        at += width.get(c, 0) + 2
    out = []
    if captions:
        head = Renderer(False, depth + 1)
        for part in captions:
            head.text(part) if isinstance(part, str) else head.element(part)
        out += head.finish()
    for cells in grid:
        for i in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for column, _, lines in cells:
                if i < len(lines) and lines[i]:
                    pad = start[column] - len(line)
                    line += " " * (pad if pad >= 2 or not line else 2) + lines[i]
            out.append(line.rstrip())
    return out


def page_text(html: str | None) -> str:
    """Visible text of one page; empty for null, for no markup the text itself."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html.replace("\x00", "�"))
    builder.close()
    out = Renderer()
    out.children(builder.root)
    return "\n".join(out.finish())


def extract(pages: DataFrame, *, html: str = "html") -> DataFrame:
    """All columns plus ``_text``. Null and empty pages give an empty text; broken
    markup never fails. Each row stands on its own: no shuffle, repeated rows stay."""
    columns = pages.columns
    packed = pages.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{html}`").alias("html"))

    def render(batches):
        for batch in batches:
            texts = [page_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])

    out = packed.mapInArrow(render, f"row {packed.schema['row'].dataType.simpleString()}, text string")
    return out.select(*[F.col("row")[c].alias(c) for c in columns], F.col("text").alias("_text"))
