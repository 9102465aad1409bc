"""Layout-aware text of HTML pages: a tree with implied tags, visibility rules, and a block renderer.

The tree builder closes what HTML closes by itself (paragraphs before blocks,
list items, table parts, options) and ignores end tags without a start. The
renderer walks the tree without recursion and emits all visible text: inline
white space collapses, blocks start lines, paragraphs are set apart by an empty
line, list items carry their marker and indentation, and table cells are
aligned in columns.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas datalist meta link base area param source track rp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre ul ol dl table figure menu".split()) | HEADINGS
BLOCKS = PARAGRAPHS | frozenset("html body address article aside center dd details dialog dir div dt fieldset figcaption footer form header hgroup hr legend li main nav optgroup option search section select summary tr caption thead tbody tfoot".split())
ENDS_PARAGRAPH = BLOCKS - frozenset("html body option optgroup select legend caption tr thead tbody tfoot".split())
#: Opening the tag closes these open elements, looking no further up than the scope.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
}
PARAGRAPH_SCOPE = frozenset("table td th caption button object template".split())
#: End tags that reach out of a table cell, and what holds all others in.
TABLE_ENDS = frozenset("table tr td th tbody thead tfoot body html".split())
TABLE_SCOPE = ("td", "th", "table")
#: A quote opens a value only right after the equals sign.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))?)*+)>?", re.S)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
NEEDS_ATTRIBUTES = re.compile(r"hidden|style|span|start|value|type|open", re.I)


#: Characters a table column is padded to, and levels of indentation, at most: no page grows by more than a constant factor.
MOST_WIDTH, MOST_INDENTS = 1000, 40


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    if not NEEDS_ATTRIBUTES.search(text):
        return {}
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        value = m[2] or ""
        if value[:1] in "\"'" and value:
            value = value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:]
        out.setdefault(m[1].lower(), html.unescape(value))
    return out


class Open:
    """The open elements, and for each tag the places in the stack where it stands."""

    def __init__(self, root: Node):
        self.nodes, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        while len(self.nodes) > place:
            self.at[self.nodes.pop().tag].pop()

    def last(self, tags: Iterable[str]) -> int:
        """The topmost place of any of the tags, 0 if none is open."""
        return max((x[-1] for t in tags if (x := self.at.get(t))), default=0)

    def first_above(self, tags: Iterable[str], place: int) -> int:
        """The lowest place above ``place`` of any of the tags, 0 if there is none."""
        found = (x[bisect.bisect_right(x, place)] for t in tags if (x := self.at.get(t)) and x[-1] > place)
        return min(found, default=0)


def tree(source: str) -> Node:
    """Root of the tree; text children are strings."""
    root = Node("#root", {})
    stack, at = Open(root), 0
    n = len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if m is None:
            break
        if m.start() > at:
            stack.nodes[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            _close(stack, tag)
            continue
        _imply(stack, tag)
        node = Node(tag, attributes(m[3]) if m[3] else {})
        stack.nodes[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = RAW_END[tag].search(source, at)
            content = source[at : end.start()]
            if content:
                node.children.append(html.unescape(content) if tag in ("textarea", "title") else content)
            at = end.end()
            continue
        stack.push(node)
    if at < n:
        stack.nodes[-1].children.append(html.unescape(source[at:]))
    return root


def _imply(stack: Open, tag: str) -> None:
    if tag in ENDS_PARAGRAPH:
        p = stack.last(("p",))
        if p > stack.last(PARAGRAPH_SCOPE):
            stack.cut(p)
    if tag in HEADINGS and stack.nodes[-1].tag in HEADINGS:
        stack.cut(len(stack.nodes) - 1)
    if tag == "body" and (head := stack.first_above(("head",), 0)):
        stack.cut(head)
    if tag in CLOSES:
        ends, scope = CLOSES[tag]
        if place := stack.first_above(ends, stack.last(scope)):
            stack.cut(place)


def _close(stack: Open, tag: str) -> None:
    if tag == "br":
        stack.nodes[-1].children.append(Node("br", {}))
        return
    place = stack.last(HEADINGS if tag in HEADINGS else (tag,))
    if place and (tag in TABLE_ENDS or place >= stack.last(TABLE_SCOPE)):
        stack.cut(place)
    elif tag == "p":
        stack.nodes[-1].children.append(Node("p", {}))


def hidden(node: Node) -> bool:
    if node.tag in HIDDEN:
        return True
    a = node.attrs
    return bool(a) and ("hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden") or bool(NO_DISPLAY.search(a.get("style", ""))))


class Frame:
    """Lines of one flow of text: the page, or one table cell."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []
        self.space = False
        self.gap = 0
        self.indent: list[str] = []
        self.marker = ""

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if s == " ":
            self.space = True
            return
        if not s:
            return
        if s[0] == " ":
            self.space, s = True, s[1:]
        trailing = s[-1] == " "
        if self.space and self.words:
            self.words.append(" ")
        self.words.append(s[:-1] if trailing else s)
        self.space = trailing

    def flush(self) -> None:
        if self.words:
            self._add("".join(self.words))
            self.words = []
        self.space = False

    def _add(self, line: str) -> None:
        if self.gap > 1 and self.lines:
            self.lines.append("")
        self.gap = 0
        prefix = "".join(self.indent[-MOST_INDENTS:])
        if self.marker:
            prefix = prefix[: -len(self.marker)] + self.marker
            self.marker = ""
        self.lines.append((prefix + line.replace("\xa0", " ")).rstrip())

    def block(self, gap: int) -> None:
        self.flush()
        self.gap = max(self.gap, gap)

    def verbatim(self, s: str) -> None:
        parts = s.split("\n")
        for p in parts[:-1]:
            self.words.append(p)
            self._add("".join(self.words))
            self.words = []
        if parts[-1]:
            self.words.append(parts[-1])

    def done(self) -> list[str]:
        self.flush()
        if self.marker:
            self._add("")
        return self.lines


def _span(value: str | None) -> int:
    return min(1000, max(1, int(value))) if value and value.strip().isdigit() and len(value.strip()) < 7 else 1


def layout(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table whose cells are (lines, colspan, rowspan): columns padded to their widest single cell, MOST_WIDTH characters at most."""
    grid: list[dict[int, tuple[list[str], int]]] = []
    taken: dict[int, int] = {}
    for row in rows:
        out: dict[int, tuple[list[str], int]] = {}
        col = 0
        for lines, across, down in row:
            while taken.get(col, 0) > 0:
                col += 1
            out[col] = (lines, across)
            for c in range(col, col + across):
                taken[c] = max(taken.get(c, 0), down)
            col += across
        taken = {c: k - 1 for c, k in taken.items() if k > 1}
        grid.append(out)
    width: dict[int, int] = {}
    for row_cells in grid:
        for c, (lines, across) in row_cells.items():
            if across == 1:
                width[c] = max(width.get(c, 0), min(MOST_WIDTH, max((len(x) for x in lines), default=0)))
    text = []
    for row_cells in grid:
        for k in range(max((len(x) for x, _ in row_cells.values()), default=0)):
            line, at = "", 0
            for c in sorted(row_cells):
                while at < c:
                    line += " " * (width.get(at, 0) + 2)
                    at += 1
                lines, across = row_cells[c]
                own = lines[k] if k < len(lines) else ""
                room = sum(width.get(x, 0) for x in range(c, c + across)) + 2 * (across - 1)
                line += own.ljust(room) + "  "
                at = c + across
            text.append(line.rstrip())
    return text


def render(root: Node) -> str:
    """All visible text of the tree."""
    frames, lists, tables, pre = [Frame()], [], [], 0
    work: list[tuple[bool, Node | str]] = [(True, root)]
    while work:
        enter, node = work.pop()
        f = frames[-1]
        if isinstance(node, str):
            if pre:
                f.verbatim(node)
            else:
                f.text(node)
            continue
        tag = node.tag
        if enter:
            if hidden(node):
                continue
            if tag == "br":
                if f.words:
                    f.flush()
                elif f.lines:
                    f.gap = 2
                continue
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            if tag in ("td", "th") and tables:
                frames.append(Frame())
                pre_now, pre = pre, 0
                lists.append(("cell", pre_now))
            elif tag in BLOCKS:
                nested = tag in ("ul", "ol", "menu") and any(x[0] in ("ul", "ol") for x in lists[-2:])
                f.block(2 if tag in PARAGRAPHS and not nested else 1)
                if tag in ("ul", "menu", "ol"):
                    start = node.attrs.get("start", "1")
                    lists.append(["ol" if tag == "ol" else "ul", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
                elif tag == "li":
                    mark = "- "
                    if lists and lists[-1][0] == "ol":
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    f.indent.append(" " * len(mark))
                    f.marker = mark
                elif tag in ("blockquote", "dd"):
                    f.indent.append("  ")
                elif tag == "pre":
                    pre += 1
                    if children and isinstance(children[0], str) and children[0].startswith("\n"):
                        children = [children[0][1:], *children[1:]]
                elif tag == "table":
                    tables.append([])
                elif tag == "tr" and tables:
                    tables[-1].append([])
            work.append((False, node))
            work.extend((True, c) for c in reversed(children))
            continue
        if tag in ("td", "th") and tables:
            cell = frames.pop().done()
            pre = lists.pop()[1]
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append((cell, _span(node.attrs.get("colspan")), _span(node.attrs.get("rowspan"))))
        elif tag == "table":
            f.flush()
            for line in layout(tables.pop()):
                f._add(line)
            f.block(2)
        elif tag in BLOCKS:
            nested = tag in ("ul", "ol", "menu") and any(x[0] in ("ul", "ol") for x in lists[-3:-1])
            f.block(2 if tag in PARAGRAPHS and not nested else 1)
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            elif tag == "li":
                if f.marker:
                    f._add("")
                f.indent.pop()
            elif tag in ("blockquote", "dd"):
                f.indent.pop()
            elif tag == "pre":
                pre -= 1
    return "\n".join(frames[0].done())


def visible_text(source: str | None) -> str:
    """Visible text of a page; a null page has none. Unknown tags are inline, broken markup never raises."""
    return render(tree(source)) if source else ""


def text_column(source: Column) -> Column:
    @F.pandas_udf(StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: visible_text(x if isinstance(x, str) else None))

    return run(source.cast("string"))


def extract(pages: DataFrame, column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``column`` in ``into`` (which it replaces if there is one).

    One row per row; a null page gives an empty text.
    """
    return pages.withColumn(into, text_column(F.col(column)))
