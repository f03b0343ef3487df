"""Visible text of HTML pages, laid out.

A tree is built first, with the end tags and table rows that HTML lets authors leave out. Then the visible nodes are
rendered: blocks on lines of their own, a blank line around paragraphs and headings, list items with their bullets or
numbers and indented by depth, preformatted text as it stands, and tables with their cells in aligned columns. Both
steps use explicit stacks, so deep nesting is no problem, and the markup is read in one pass: a tag or comment that
does not end is not read again from its next character.

What bounds the output: a column is as wide as its widest line of up to ``WIDEST`` characters, longer lines are kept
whole and push what follows to the right; columns without text take no space; and tables inside ``MOST_NESTED``
others are laid out as blocks, a row to a line.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dqengine.llm.common import ship, small_batches

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Never shown. ``noscript`` is shown only where scripts are off, and the content of the others is a fallback.
HIDDEN = frozenset(
    "head title script style template noscript datalist iframe object audio video canvas param".split()
)
#: Not drawn inside ``svg`` and inside ``math``, whose other text is shown.
NOT_DRAWN = {
    "svg": frozenset("title desc metadata defs symbol clippath mask marker pattern".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
#: Blocks, with the blank lines that stand before and after them.
BLOCKS = dict.fromkeys(
    "address article aside center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup "
    "html body li legend main menu nav ol option optgroup section select summary ul table caption hr".split(), 0,
) | dict.fromkeys("p h1 h2 h3 h4 h5 h6 blockquote pre".split(), 1)
#: A start tag on the left ends the open elements on the right, unless one of the elements after the bar is nearer.
_CELLS, _ROWS = frozenset(("td", "th")), frozenset(("tr", "td", "th"))
_GROUPS = frozenset(("thead", "tbody", "tfoot"))
#: What holds only parts of a table, and those parts. Anything else in there is shown before the table.
_FRAME = _GROUPS | {"table", "tr"}
_PARTS = _GROUPS | _ROWS | {"caption", "col", "colgroup"}
_ANYWHERE = frozenset("script style template".split())
ENDS: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "td": (_CELLS, frozenset(("tr", "table"))),
    "th": (_CELLS, frozenset(("tr", "table"))),
    "tr": (_ROWS, frozenset(("table",))),
    **{g: (_ROWS | _GROUPS | {"caption"}, frozenset(("table",))) for g in _GROUPS},
    "body": (frozenset(("head",)), frozenset()),
}
#: A block start tag ends an open paragraph inside these.
BORDERS = frozenset(("td", "th", "table", "caption", "button", "object", "body", "html"))
SPACE = re.compile(r"[ \t\n\r\f]+")
CSS_COMMENT = re.compile(r"/\*.*?(\*/|$)", re.S)
SCREEN = re.compile(r"@media\b\s*(.*)", re.I | re.S)
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)
SEEN = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


def _on_screen(media: str) -> bool:
    """Whether a list of media holds all screens, without further conditions."""
    names = [" ".join(m.split()).lower().removeprefix("only ") for m in media.split(",")]
    return any(name in ("", "all", "screen") for name in names)


def hidden_selectors(css: str) -> set[str]:
    """Selectors of the rules that hide their elements on every screen; rules inside other at-rules do not count."""
    css, at = CSS_COMMENT.sub(" ", css), 0
    out: set[str] = set()
    rules: list[tuple[str, list[str]]] = []  # of the open rules what stands before the brace, and their declarations
    for brace in re.finditer(r"[{}]", css):
        before, at = css[at : brace.start()], brace.end()
        if brace[0] == "{":
            own, _, prelude = before.rpartition(";")
            if rules:
                rules[-1][1].append(own)
            rules.append((prelude.strip(), []))
        elif rules:
            selectors, own = rules.pop()
            media = [SCREEN.fullmatch(outer) for outer, _ in rules]
            if not selectors.startswith("@") and all(m and _on_screen(m[1]) for m in media):
                if NOT_SHOWN.search(";".join([*own, before])):
                    out.update(s.strip().lower() for s in selectors.split(","))
    return out


#: Lines of cells up to this length are aligned; tables inside so many others are blocks.
WIDEST, MOST_NESTED = 60, 6
#: Cells span rows below only in tables of up to so many columns.
MOST_SPANNED = 100
#: Their content is text up to their end tag, with or without character references.
RAW = frozenset("script style xmp iframe noembed noframes".split())
RAW_WITH_REFERENCES = frozenset(("textarea", "title"))
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(
    r"""[\s/]*+([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|(?!["'])[^\s>]++|(?=>)))?"""
)
TAG_END = re.compile(r"[\s/]*+>")


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str | None] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)


class Tree:
    """Builds the tree; open elements are a stack."""

    def __init__(self):
        self.unclosed = False  # a tag has run to the end of the page: quotes are not trusted any more
        self.root = Node("html")
        self.open = [self.root]
        self.count: Counter[str] = Counter()
        self.styles: list[Node] = []
        self.outside: dict[int, Node] = {}  # what holds the elements that stand before the table they were written in

    def feed(self, html: str) -> None:
        """Read a whole page, from left to right."""
        at, length, last = 0, len(html), html.rfind(">")
        while at < length:
            sign = html.find("<", at)
            if sign < 0:
                break
            after = html[sign + 1 : sign + 2]
            name = NAME.match(html, sign + (2 if after == "/" else 1))
            if not name and (after not in ("!", "?", "/") or after == "/" and sign > last):
                # A sign that begins no tag is text.
                stop = html.find("<", sign + 1)
                stop = length if stop < 0 else stop
                self.handle_data(unescape(html[at:stop]))
                at = stop
                continue
            if sign > at:
                self.handle_data(unescape(html[at:sign]))
            if name and after != "/":
                at = self._start_tag(html, sign, name)
            elif name:
                stop = html.find(">", name.end())
                if stop < 0:
                    at = sign
                    break
                self.handle_endtag(name[0].lower())
                at = stop + 1
            else:
                at = self._comment(html, sign)
        if at < length:
            self.handle_data(unescape(html[at:]))

    def _comment(self, html: str, sign: int) -> int:
        """Where a comment or declaration ends; one that does not end takes the rest of the page."""
        if html.startswith("<!--", sign):
            if html.startswith((">", "->"), sign + 4):
                return html.index(">", sign + 4) + 1
            ends = [(html.find(mark, sign + 4), len(mark)) for mark in ("-->", "--!>")]
            return min((at + n for at, n in ends if at >= 0), default=len(html))
        if html[sign : sign + 9].upper() == "<![CDATA[":
            stop = html.find("]]>", sign + 9)
            return len(html) if stop < 0 else stop + 3
        stop = html.find(">", sign + 1)
        return len(html) if stop < 0 else stop + 1

    def _start_tag(self, html: str, sign: int, name: re.Match) -> int:
        """Read one start tag, and the content of an element that holds only text. Returns where to go on."""
        tag, at, found = name[0].lower(), name.end(), []
        if not self.unclosed:
            while part := ATTRIBUTE.match(html, at):
                found.append(part)
                at = part.end()
        end = TAG_END.match(html, at)
        if not end:
            # Cut off, or a quote without its other half: the tag ends at the next sign, whatever stands in quotes.
            self.unclosed = True
            stop = html.find(">", name.end())
            if stop < 0:
                self.handle_data(unescape(html[sign:]))
                return len(html)
            found = [p for p in ATTRIBUTE.finditer(html, name.end(), stop)]
            at, end = stop, TAG_END.match(html, stop)
        attributes = []
        for part in found:
            value = part[2]
            if value is not None:
                value = unescape(value[1:-1] if value[:1] in ("'", '"') and len(value) > 1 else value)
            attributes.append((part[1].lower(), value))
        # The first of two attributes of one name counts.
        attributes = [*dict(reversed(attributes)).items()]
        if html[end.end() - 2] == "/":
            self.handle_startendtag(tag, attributes)
            return end.end()
        self.handle_starttag(tag, attributes)
        drawn = self.count["svg"] or self.count["math"]
        if tag not in RAW | RAW_WITH_REFERENCES or drawn and tag not in ("script", "style"):
            return end.end()
        close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, end.end())
        text = html[end.end() : close.start() if close else len(html)]
        if text:
            self.handle_data(unescape(text) if tag in RAW_WITH_REFERENCES else text)
        return close.start() if close else len(html)

    def _close(self, at: int) -> None:
        for node in self.open[at:]:
            self.count[node.tag] -= 1
        del self.open[at:]

    def _close_until(self, tags: frozenset[str], borders: frozenset[str]) -> None:
        """Close all open elements of these tags that no border shields, the innermost first."""
        at = len(self.open) - 1
        while at > 0 and any(self.count[tag] for tag in tags) and self.open[at].tag not in borders:
            if self.open[at].tag in tags:
                self._close(at)
            at -= 1

    def _table(self) -> int:
        """The place of the innermost open table; only called if there is one."""
        return next(at for at in range(len(self.open) - 1, 0, -1) if self.open[at].tag == "table")

    def _add(self, child: Node | str) -> None:
        """Into the innermost open element, or before the table if it is no part of that."""
        loose = child.strip(" \t\n\r\f") if isinstance(child, str) else child.tag not in _PARTS | _ANYWHERE
        if not loose or self.open[-1].tag not in _FRAME or not self.count["table"]:
            self.open[-1].children.append(child)
            return
        at = self._table()
        table = self.open[at]
        holder = self.outside.get(id(table), self.open[at - 1])
        around = holder.children
        around.insert(next(i for i in range(len(around) - 1, -1, -1) if around[i] is table), child)
        if isinstance(child, Node):
            self.outside[id(child)] = holder

    def _push(self, tag: str, attributes: dict[str, str | None]) -> None:
        if any(self.count[a] and tag in names for a, names in NOT_DRAWN.items()):
            attributes["hidden"] = ""
        node = Node(tag, attributes)
        self._add(node)
        self.open.append(node)
        self.count[tag] += 1
        if tag == "style":
            self.styles.append(node)

    def handle_starttag(self, tag, attrs):
        attributes = dict(attrs)
        if tag == "html":
            self.root.attributes |= attributes
            return
        if tag in _PARTS and self.outside and self.count["table"]:
            for at in range(self._table() + 1, len(self.open)):
                if id(self.open[at]) in self.outside:
                    self._close(at)
                    break
        if tag in ENDS:
            self._close_until(*ENDS[tag])
        if tag in BLOCKS or tag in ("td", "th", "tr"):
            self._close_until(frozenset(("p",)), BORDERS)
        if tag in _CELLS and self.open[-1].tag in _GROUPS | {"table"}:
            self._push("tr", {})
        if tag in VOID:
            self._add(Node(tag, attributes))
        else:
            self._push(tag, attributes)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if (self.count["svg"] or self.count["math"]) and self.open[-1].tag == tag:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag):
        if tag == "br":
            self.handle_starttag("br", [])
        if tag in VOID or not self.count[tag]:
            return
        # An end tag does not reach out of a table cell or a table, unless it ends that one.
        walls = frozenset(("table",)) if tag in _ROWS | _GROUPS else BORDERS
        for at in range(len(self.open) - 1, 0, -1):
            if self.open[at].tag == tag:
                self._close(at)
                return
            if self.open[at].tag in walls and tag not in ("table", "body"):
                return

    def handle_data(self, data):
        self._add(data)

    def hidden(self) -> set[str]:
        """The selectors of what the style sheets of the page hide."""
        out: set[str] = set()
        for node in self.styles:
            if _on_screen(node.attributes.get("media") or ""):
                out |= hidden_selectors("".join(c for c in node.children if isinstance(c, str)))
        return out


class Page:
    """Lines of text with the layout of blocks. Cells of a table are pages of their own."""

    def __init__(self):
        self.lines: list[str] = []
        self.words: list[str] = []
        self.indent: list[str] = []
        self.mark = ""
        self.blank = 0

    def text(self, data: str) -> None:
        self.words.append(data)

    def end_line(self, blank: int = 0) -> None:
        line = SPACE.sub(" ", "".join(self.words)).strip(" ")
        self.words.clear()
        if line:
            self._put(line)
        self.blank = max(self.blank, blank)

    def _put(self, line: str) -> None:
        if self.lines:
            self.lines.extend([""] * self.blank)
        self.blank = 0
        depth = "".join(self.indent)
        if self.mark:
            depth = depth[: len(depth) - len(self.mark)] + self.mark
            self.mark = ""
        self.lines.append((depth + line).rstrip(" "))

    def verbatim(self) -> None:
        """End preformatted text: its lines stay as they are, but for tabs."""
        data = "".join(self.words)
        self.words.clear()
        for line in data.strip("\n").expandtabs(8).split("\n"):
            self._put(line)

    def whole(self) -> str:
        self.end_line()
        return "\n".join(self.lines)


def _shown(node: Node, hidden: set[str], visible: bool) -> tuple[bool, bool]:
    """Whether a node is rendered at all, and whether its own text is visible."""
    attributes = node.attributes
    if node.tag in HIDDEN or "hidden" in attributes or node.tag in hidden:
        return False, False
    if node.tag == "input" or node.tag == "dialog" and "open" not in attributes:
        return False, False
    style = attributes.get("style") or ""
    if NOT_SHOWN.search(style):
        return False, False
    if hidden:
        names = (attributes.get("class") or "").lower().split()
        own = [f".{n}" for n in names] + [f"{node.tag}.{n}" for n in names]
        if attributes.get("id"):
            own += [f"#{attributes['id'].lower()}", f"{node.tag}#{attributes['id'].lower()}"]
        if not hidden.isdisjoint(own):
            return False, False
    seen = SEEN.findall(style)
    return True, (seen[-1].lower() == "visible") if seen else visible


def _span(node: Node, name: str = "colspan") -> int:
    value = node.attributes.get(name) or ""
    return min(max(int(value), 1), 1000) if value.isascii() and value.isdigit() and len(value) < 6 else 1


Cell = tuple[str, int, int]  # text, columns, rows


def _placed(rows: list[list[Cell]]) -> list[list[tuple[list[str], int, int]]]:
    """The cells of each row as (lines, first column, columns); places that cells of rows above span are left free."""
    out = []
    below: list[tuple[int, int, int]] = []  # first column, columns, and rows still to come, by column
    for row in rows:
        cells, held, at = [], [], 0
        taken = iter(below)
        busy = next(taken, None)
        for text, columns, spans in row:
            while busy and busy[0] < at + columns:
                at = max(at, busy[0] + busy[1])
                busy = next(taken, None)
            if text:
                cells.append((text.split("\n"), at, columns))
            if spans > 1 and at + columns <= MOST_SPANNED:
                held.append((at, columns, spans))
            at += columns
        below = sorted((at, columns, spans - 1) for at, columns, spans in [*below, *held] if spans > 1)
        out.append(cells)
    return out


def _table(rows: list[list[Cell]]) -> list[str]:
    """Rows of cells as lines with aligned columns. Lines inside a cell stay below each other."""
    placed = [cells for cells in _placed(rows) if cells]
    widths: dict[int, int] = {}
    for cells in placed:
        for lines, at, columns in cells:
            widths.setdefault(at, 0)
            if columns == 1:
                widths[at] = max(widths[at], max((len(x) for x in lines if len(x) <= WIDEST), default=0))
    left, starts = 0, {}
    for at in sorted(widths):
        starts[at] = left
        left += widths[at] + 2
    out = []
    for cells in placed:
        for i in range(max(len(lines) for lines, _, _ in cells)):
            line, length = [], 0
            for lines, at, _ in cells:
                if i < len(lines) and lines[i]:
                    gap = max(starts[at] - length, 2 if length else 0)
                    line.append(" " * gap + lines[i])
                    length += gap + len(lines[i])
            out.append("".join(line).rstrip(" "))
    return out


def render(html: str) -> str:
    """The visible text of one page."""
    tree = Tree()
    tree.feed(html)
    hidden = tree.hidden()
    pages = [Page()]
    tables: list[list[list[Cell]] | None] = []  # None: laid out as blocks
    counters: list[int | None] = []
    pre = 0
    # (node, whether its text is visible) on entry; (node, None) when its children are done.
    stack: list[tuple[Node | str, bool | None]] = [(tree.root, True)]
    while stack:
        node, visible = stack.pop()
        page = pages[-1]
        if isinstance(node, str):
            if visible:
                page.text(node)
            continue
        tag = node.tag
        if visible is None:  # leave
            if tag in ("ul", "ol", "menu") and counters:
                counters.pop()
            if tag == "text":  # of a drawing, at a place of its own
                page.text(" ")
            if tag == "pre":
                pre -= 1
                page.verbatim()
            if tag in ("td", "th") and tables and tables[-1] is not None:
                tables[-1][-1].append((pages.pop().whole(), _span(node), _span(node, "rowspan")))
            elif tag == "tr" and tables and tables[-1] is None:
                page.end_line()
            elif tag == "table":
                rows = tables.pop()
                page.end_line()
                if rows is not None:
                    lines = _table(rows)
                    for line in lines:
                        page._put(line)
                    page.end_line(1 if lines else 0)
            elif tag in BLOCKS:
                page.end_line(BLOCKS[tag])
                if tag in ("li", "dd", "blockquote") and page.indent:
                    page.indent.pop()
                    page.mark = ""
                if tag in ("ul", "ol", "menu") and not counters:
                    page.end_line(1)
            continue
        shown, own = _shown(node, hidden, visible)
        if not shown:
            continue
        if tag == "br":
            page.text("\n") if pre else page.end_line()
            continue
        if tag in ("img", "wbr"):
            continue
        if tag in ("td", "th"):
            if not tables or not tables[-1]:
                page.text(" ")
                stack.extend((child, own) for child in reversed(node.children))
                continue
            pages.append(Page())
        elif tag == "tr" and tables and tables[-1] is None:
            page.end_line()
        elif tag == "text":
            page.text(" ")
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag == "table":
            page.end_line(0 if len(tables) >= MOST_NESTED else 1)
            tables.append([] if len(tables) < MOST_NESTED else None)
        elif tag in BLOCKS:
            page.end_line(BLOCKS[tag])
            if tag in ("ul", "ol", "menu"):
                if not counters:
                    page.end_line(1)
                start = node.attributes.get("start") or "1"
                counters.append((int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1) if tag == "ol" else None)
            elif tag == "li":
                number = counters[-1] if counters else None
                if counters and number is not None:
                    counters[-1] = number + 1
                page.mark = "- " if number is None else f"{number}. "
                page.indent.append(" " * len(page.mark))
            elif tag in ("dd", "blockquote"):
                page.indent.append("  ")
            elif tag == "pre":
                pre += 1
        stack.append((node, None))
        children = node.children
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
        if tag in _FRAME:  # the space between the cells has no place
            children = [c for c in children if isinstance(c, Node) or c.strip(" \t\n\r\f")]
        stack.extend((child, own) for child in reversed(children))
    return pages[0].whole().strip("\n")


def html_text(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """``page_id`` and ``text`` (the visible text, laid out) of every page.

    Null or empty HTML gives an empty text. Null ids and repeated rows are kept; other columns are not read. Markup
    errors never fail: what cannot be read as a tag is text.
    """
    ship(pages.sparkSession)
    rows = pages.select(
        F.col(f"`{id_column}`").alias("page_id"), F.coalesce(F.col(f"`{html_column}`"), F.lit("")).alias("text")
    )

    def extract(batches):
        for batch in small_batches(batches, "text"):
            texts = [render(html) for html in batch.column("text").to_pylist()]
            yield batch.set_column(1, "text", pa.array(texts, pa.string()))

    return rows.mapInArrow(extract, T.StructType([rows.schema["page_id"], T.StructField("text", T.StringType())]))
