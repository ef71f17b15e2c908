"""Layout-aware rendering of web pages to text.

A tokenizer reads the page once, from left to right, with the attribute states of HTML; a tree builder closes what HTML lets
authors leave open (paragraphs, headings, list items, table rows and cells, options), opens rows that are left out and ignores
end tags that match nothing in reach; visibility rules drop elements that a browser doesn't show. The tree is then laid out:
blocks on lines of their own, headings and paragraphs with an empty line around, list items with markers and indents, tables
with cells in aligned columns (spanned columns and rows included), preformatted text as it stands.

All steps work with stacks of their own and cost time in proportion to the page, at any depth of nesting. Indents stop to grow
at MOST_INDENT columns, and tables more than ALIGNED deep inside cells of others are laid out row by row, unaligned; both keep
all text. As in a browser, a tag that is never closed by `>` is dropped with what follows it.

Null html is an empty page; broken markup never fails; repeated rows are rendered one by one; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerwell.llm.common import table

MOST_INDENT, ALIGNED = 64, 6
#: Blanks that align the cells of a table, for each of its other characters.
PADDING = 4
_NAME = re.compile(r"[a-zA-Z][^ \t\n\r\f/>]*")
_GAP = re.compile(r"[ \t\n\r\f/]*")
_BLANK = re.compile(r"[ \t\n\r\f]*")
_KEY = re.compile(r"=?[^ \t\n\r\f/>=]*")
_BARE = re.compile(r"[^ \t\n\r\f>]*")
_COMMENT_END = re.compile(r"--!?>")
_INTEGER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,10})(?![0-9])")
_CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")
VOID = frozenset("area base br col embed hr img image input link meta param source track wbr".split())
#: What may stand in a head; anything else closes it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Elements whose content is no markup, and those of them that show it.
RAW = frozenset("script style noscript template textarea title xmp iframe noembed noframes".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[ \t\n\r\f/>])", re.I) for name in RAW}
_TEMPLATE = re.compile(r"<(/?)template(?=[ \t\n\r\f/>])", re.I)
#: Never shown, whatever their style.
UNSEEN = frozenset("head script style template noscript iframe object video audio canvas datalist title annotation annotation-xml noembed noframes rp".split())
#: Parts of a drawing whose text is not drawn in place.
UNDRAWN = frozenset("clippath defs desc lineargradient marker mask metadata pattern radialgradient symbol".split())
#: Blocks, and the empty lines around them.
BLOCKS = dict.fromkeys("address article aside body center dd details dialog div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav ol optgroup option section select summary table tbody tfoot thead tr ul".split(), 0)
BLOCKS |= dict.fromkeys("blockquote h1 h2 h3 h4 h5 h6 hr p pre dl figure table ul ol xmp listing plaintext".split(), 1)
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Past these an end tag of an inline element doesn't reach.
SPECIAL = frozenset(BLOCKS) | VOID | RAW | frozenset("td th caption colgroup button object marquee applet".split())
#: Past these no implied end tag reaches.
SCOPE = ("td", "th", "caption", "table", "button", "object", "marquee", "applet")
#: What a start tag closes when it is open, and the elements past which that doesn't reach.
_P = frozenset("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr listing main menu nav ol p plaintext pre section table ul xmp".split())
IMPLIED = {tag: (("p",), SCOPE) for tag in _P}
IMPLIED |= {
    "li": (("li",), ("ul", "ol", "menu", *SCOPE)),
    "dt": (("dt", "dd"), ("dl", *SCOPE)),
    "dd": (("dt", "dd"), ("dl", *SCOPE)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "optgroup", "datalist", *SCOPE)),
    "optgroup": (("option", "optgroup"), ("select", *SCOPE)),
    "button": (("button",), ("td", "th", "caption", "table", "object")),
    "body": (("head",), ()),
}
SECTIONS = frozenset("tbody thead tfoot colgroup".split())
#: What a start tag leaves open inside the nearest table; all else in the table is closed.
INSIDE = dict.fromkeys(("td", "th"), (*(SECTIONS - {"colgroup"}), "table", "tr")) | {"tr": (*(SECTIONS - {"colgroup"}), "table")}
INSIDE |= dict.fromkeys(("tbody", "thead", "tfoot", "caption", "colgroup"), ("table",))
#: Where only rows, cells and captions are laid out as such; other content stands before the table.
GRID = SECTIONS | {"table", "tr"}


@dataclass(slots=True)
class Node:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)


class Open:
    """The open elements, with the places of each tag, so that the nearest one is found at once."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.places: dict[str, list[int]] = defaultdict(list)
        self.special: list[int] = []
        self.push(root)

    def push(self, node: Node) -> None:
        self.places[node.tag].append(len(self.nodes))
        if node.tag in SPECIAL:
            self.special.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, at: int) -> None:
        """Closes all elements from a place on."""
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in SPECIAL:
                self.special.pop()

    def last(self, *tags: str) -> int:
        """The innermost place of any of the tags, or -1."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)

    @property
    def top(self) -> Node:
        return self.nodes[-1]

    def add(self, node: Node) -> None:
        self.top.children.append(node)


def read_tag(page: str, at: int) -> tuple[dict[str, str], bool, int]:
    """Attributes from a place after a tag's name, whether the tag ends itself, and the place after it (-1: never closed)."""
    found: dict[str, str] = {}
    n = len(page)
    while True:
        gap = _GAP.match(page, at)
        at = gap.end()
        if at >= n:
            return found, False, -1
        if page[at] == ">":
            return found, gap[0].endswith("/"), at + 1
        key = _KEY.match(page, at)
        at = _BLANK.match(page, key.end()).end()
        value = ""
        if page[at : at + 1] == "=":
            at = _BLANK.match(page, at + 1).end()
            quote = page[at : at + 1]
            if quote in ('"', "'"):
                stop = page.find(quote, at + 1)
                if stop < 0:
                    return found, False, -1
                value, at = page[at + 1 : stop], stop + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        found.setdefault(key[0].lower(), entities.unescape(value) if "&" in value else value)


def _raw_end(name: str, page: str, at: int) -> int:
    """Where the content of an element without markup ends; templates may hold templates."""
    if name != "template":
        stop = _RAW_END[name].search(page, at)
        return stop.start() if stop else len(page)
    depth = 1
    for m in _TEMPLATE.finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.start()
    return len(page)


def _start(open_: Open, name: str) -> bool:
    """Closes and opens what a start tag implies; False where the tag itself is ignored."""
    if name in ("html", "body", "head") and open_.places.get(name):
        return False
    if open_.top.tag == "head" and name not in HEAD:
        open_.cut(len(open_.nodes) - 1)
    if name in INSIDE:
        k = open_.last("table")
        if k > 0:
            open_.cut(max(k, open_.last(*INSIDE[name])) + 1)
            if name in ("td", "th") and open_.top.tag != "tr":
                row = Node("tr")
                open_.add(row)
                open_.push(row)
    elif name == "table":
        k = open_.last("table")
        if k > max(0, open_.last("td", "th", "caption")):
            open_.cut(k)
    elif name == "form" and open_.top.tag in GRID:
        return False
    if name in IMPLIED:
        tags, until = IMPLIED[name]
        fence = open_.last(*until)
        while (k := open_.last(*tags)) > max(0, fence):
            open_.cut(k)
    if name in HEADINGS and open_.top.tag in HEADINGS:
        open_.cut(len(open_.nodes) - 1)
    return True


def _end(open_: Open, name: str) -> None:
    """Closes the nearest element that an end tag names, if it is in reach."""
    names = HEADINGS if name in HEADINGS else (name,)
    k = open_.last(*names)
    if name in ("table", "body", "html"):
        fence = 0
    elif name in ("tr", "tbody", "thead", "tfoot"):
        fence = open_.last("table")
    elif name in SPECIAL:
        fence = open_.last("td", "th", "caption", "table")
    else:
        fence = open_.special[-1] if open_.special else 0
    if k > 0 and k >= fence:
        open_.cut(k)


def parse(page: str) -> Node:
    """The tree of a page; text is a str among the children."""
    root = Node("html")
    open_ = Open(root)
    at, n = 0, len(page)

    def text(s: str) -> None:
        if s:
            if open_.top.tag == "head" and s.strip(" \t\n\r\f"):
                open_.cut(len(open_.nodes) - 1)
            open_.top.children.append(entities.unescape(s) if "&" in s else s)

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            text(page[at:])
            break
        ending = page.startswith("</", begin)
        m = _NAME.match(page, begin + 1 + ending)
        if not m and not ending and page[begin + 1 : begin + 2] not in ("!", "?"):
            text(page[at : begin + 1])  # a `<` of its own
            at = begin + 1
            continue
        text(page[at:begin])
        foreign = open_.last("svg", "math") > open_.last("foreignobject", "desc", "annotation-xml")
        if not m:
            if page.startswith("<!--", begin):
                stop = _COMMENT_END.search(page, begin + 2)
                if stop and stop.start() == begin + 2 and stop[0] == "--!>":
                    stop = _COMMENT_END.search(page, begin + 4)
                at = stop.end() if stop else n
            elif foreign and page.startswith("<![CDATA[", begin):
                stop = page.find("]]>", begin)
                open_.top.children.append(page[begin + 9 : stop if stop >= 0 else n])
                at = stop + 3 if stop >= 0 else n
            else:
                stop = page.find(">", begin)
                at = stop + 1 if stop >= 0 else n
            continue
        name = m[0].lower()
        attributes, ends_itself, at = read_tag(page, m.end())
        if at < 0:
            break
        if ending and name != "br":
            _end(open_, name)
            continue
        if not _start(open_, name):
            continue
        node = Node(name, attributes)
        open_.add(node)
        if name in VOID or ends_itself and (foreign or name in ("svg", "math")):
            continue
        if name == "plaintext":
            node.children.append(page[at:])
            break
        if name in RAW and not foreign:
            stop = _raw_end(name, page, at)
            if name in ("textarea", "title", "xmp"):
                inner = page[at:stop]
                node.children.append(inner if name == "xmp" else entities.unescape(inner))
            if stop == n:
                break
            at = read_tag(page, stop + 2 + len(name))[2]
            if at < 0:
                break
            continue
        open_.push(node)
    return root


def integer(value: str | None, default: int) -> int:
    """A number as HTML reads it from an attribute; the default where there is none in 32 bits."""
    m = _INTEGER.match(value or "")
    return n if m and abs(n := int(m[1])) < 2**31 else default


def declared(style: str) -> dict[str, str]:
    """The last value of each property of a style attribute."""
    out = {}
    for part in _CSS_COMMENT.sub("", style).lower().split(";"):
        name, _, value = part.partition(":")
        out[name.strip()] = value.partition("!")[0].strip()
    return out


def hidden(node: Node) -> bool:
    """Whether a browser shows nothing of an element."""
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a or a.get("aria-hidden") == "true":
        return True
    if node.tag == "input":
        return a.get("type", "text").lower() in ("hidden", "checkbox", "radio", "file", "image", "password")
    if node.tag == "dialog" and "open" not in a or "popover" in a:
        return True
    return "style" in a and declared(a["style"]).get("display") == "none"


def width(s: str) -> int:
    """Columns that a string takes: wide characters two, combining ones none."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) or unicodedata.category(c) in ("Cf", "Me") else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Lines:
    """Text in the making: lines, with pending space and the empty lines that are due."""

    def __init__(self):
        self.out: list[str] = []
        self.line: list[str] = []
        self.space = False
        self.gap = 0
        self.indent = ""
        self.quiet = False

    def word(self, s: str) -> None:
        if not self.line:
            if self.out and self.gap:
                self.out += [""] * self.gap
            self.gap = 0
            self.line.append(self.indent)
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(s)

    def flow(self, s: str) -> None:
        if self.quiet:
            return
        inner = _SPACE.sub(" ", s)
        if inner[:1] == " ":
            self.space = True
            inner = inner[1:]
        if inner:
            trailing = inner[-1] == " "
            if body := inner.rstrip(" "):
                self.word(body)
            self.space = trailing

    def end(self) -> None:
        if self.line:
            self.out.append("".join(self.line).rstrip())
        self.line, self.space = [], False

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def deeper(self, by: str) -> None:
        if len(self.indent) + len(by) <= MOST_INDENT:
            self.indent += by

    def text(self) -> str:
        self.end()
        return "\n".join(self.out)


def _parts(node: Node) -> tuple[list[list[list[Node]]], list[Node], list]:
    """The sections of a table as rows of cells, its captions, and other content, which a browser puts before the table."""
    sections: list[list[list[Node]]] = [[]]
    captions: list[Node] = []
    before: list = []
    work = list(reversed(node.children))
    while work:
        c = work.pop()
        if c is None:
            sections.append([])
        elif isinstance(c, str):
            if c.strip(" \t\n\r\f"):
                before.append(c)
        elif hidden(c):
            continue
        elif c.tag == "tr":
            row: list[Node] = []
            for x in c.children:
                if isinstance(x, str):
                    if x.strip(" \t\n\r\f"):
                        before.append(x)
                elif not hidden(x):
                    (row if x.tag in ("td", "th") else before).append(x)
            sections[-1].append(row)
        elif c.tag == "caption":
            captions.append(c)
        elif c.tag in SECTIONS:
            work += [None, *reversed(c.children), None]
        else:
            before.append(c)
    return sections, captions, before


def _grid(section: list[list[Node]]) -> list[list[tuple[int, int, Node]]]:
    """(first column, column after the last, cell) of each row, past columns that cells of earlier rows span.

    Neighbouring columns that are spanned until the same row are one entry. A table whose rows pass more entries than in
    proportion to its cells goes on without spanned columns.
    """
    out = []
    spanned: list[tuple[int, int, int]] = []  # first column, column after the last, row after the last
    steps = 64 * sum(map(len, section)) + 65_536
    for r, row in enumerate(section):
        if any(s[2] <= r for s in spanned):
            spanned = [s for s in spanned if s[2] > r]
        steps -= len(spanned)
        placed, col, k, new = [], 0, 0, []
        for cell in row:
            across = min(1000, max(1, integer(cell.attributes.get("colspan"), 1)))
            down = min(65534, max(0, integer(cell.attributes.get("rowspan"), 1)))
            while k < len(spanned) and spanned[k][0] <= col:
                col = max(col, spanned[k][1])
                k += 1
            placed.append((col, col + across, cell))
            col += across
            until = min(r + down, len(section)) if down else len(section)
            if until > r + 1:
                new.append((col - across, col, until))
        if new:
            joined: list[tuple[int, int, int]] = []
            for s in sorted(spanned + new):
                if joined and joined[-1][2] == s[2] and joined[-1][1] >= s[0]:
                    joined[-1] = (joined[-1][0], max(joined[-1][1], s[1]), s[2])
                else:
                    joined.append(s)
            spanned = joined if steps > 0 else []
        out.append(placed)
    return out


def _table(node: Node, to: Lines, level: int) -> list:
    """A table as content to be laid out: what stands before it, its captions, and its rows, aligned or as blocks."""
    sections, captions, before = _parts(node)
    out = [*before, lambda: to.block(1)]
    for c in captions:
        out += [lambda: to.block(0), *c.children, lambda: to.block(0)]
    if sum(len(row) for section in sections for row in section) == 1 or level >= ALIGNED:
        for row in (row for section in sections for row in section):
            out += [lambda: to.block(0), *row, lambda: to.block(0)]
    else:
        out.append(lambda: _aligned(sections, to, level))
    return [*out, lambda: to.block(1)]


def _aligned(sections: list[list[list[Node]]], to: Lines, level: int) -> None:
    """Rows of cells in columns as wide as their widest cell; a cell of many lines spreads over as many rows of text."""
    rows = []
    for section in sections:
        for placed in _grid(section):
            cells = []
            for first, after, cell in placed:
                inner = Lines()
                inner.quiet = to.quiet
                lay([cell], inner, level + 1)
                cells.append((first, after, inner.text().split("\n")))
            rows.append(cells)
    starts = {c: k for k, c in enumerate(sorted({first for row in rows for first, _, _ in row}))}
    left = _columns(rows, starts)
    for row in rows:
        lines: dict[int, list[tuple[int, str]]] = {}
        for first, _, own in row:
            for k, line in enumerate(own):
                if line:
                    lines.setdefault(k, []).append((left[starts[first]], line))
        for k in range(max((len(own) for _, _, own in row), default=0)):
            to.block(0)
            line, at = [], 0
            for start, s in lines.get(k, ()):
                place = max(start, at + 2) if line else start
                line.append(" " * (place - at) + s)
                at = place + width(s)
            if line:
                to.word("".join(line))


def _columns(rows: list[list[tuple[int, int, list[str]]]], starts: dict[int, int]) -> list[int]:
    """Where the columns of a table begin. They are as wide as their widest cell, as long as the blanks that takes stay in
    proportion to the text (PADDING); else wide cells count as less, and reach into the next column, or nothing is aligned."""
    sizes = [[(starts[first], after, max(map(width, own))) for first, after, own in row] for row in rows]
    ordered = sorted(starts)
    room = 4096 + PADDING * sum(len(line) - line.count(" ") for row in rows for _, _, own in row for line in own)
    for most in (1 << 30, 512, 128, 32, 8):
        wide, spanning = [0] * len(starts), []
        for row in sizes:
            for a, after, size in row:
                b = max(a + 1, bisect_left(ordered, after))
                if b == a + 1:
                    wide[a] = max(wide[a], min(size, most))
                else:
                    spanning.append((a, b, min(size, most)))
        for a, b, size in spanning:
            wide[b - 1] += max(0, size - sum(wide[a:b]) - 2 * (b - a - 1))
        left = [0, *accumulate(w + 2 for w in wide)]
        blanks = 0
        for row in rows:
            ends: dict[int, int] = {}
            for first, _, own in row:
                start = left[starts[first]]
                for k, line in enumerate(own):
                    if line:
                        place = max(start, ends[k] + 2) if k in ends else start
                        blanks += place - ends.get(k, 0)
                        ends[k] = place + width(line)
        if blanks <= room:
            return left
    return [0] * len(left)


def _numbered(node: Node) -> list:
    """The children of a list, its items with their markers."""
    items = sum(not isinstance(c, str) and c.tag == "li" for c in node.children)
    back = "reversed" in node.attributes
    number = integer(node.attributes.get("start"), items if back else 1)
    out = []
    for c in node.children:
        if not isinstance(c, str) and c.tag == "li":
            number = integer(c.attributes.get("value"), number) if node.tag == "ol" else number
            out.append((c, f"{number}. " if node.tag == "ol" else "- "))
            number += -1 if back else 1
        else:
            out.append(c)
    return out


def _plain(node: Node) -> str:
    """All text below an element as it stands."""
    out, work = [], list(reversed(node.children))
    while work:
        c = work.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.tag == "br":
            out.append("\n")
        elif not hidden(c):
            work += reversed(c.children)
    return "".join(out)


def lay(content: list, to: Lines, level: int = 0) -> None:
    """Lays out text and elements in order. The stack holds what is still to come: text, elements, (item, marker), and
    functions that end an element."""
    work = list(reversed(content))

    def inside(children: list, after) -> None:
        work.append(after)
        work.extend(reversed(children))

    while work:
        c = work.pop()
        if isinstance(c, str):
            to.flow(c)
        elif isinstance(c, tuple):
            _element(c[0], to, level, inside, c[1])
        elif isinstance(c, Node):
            _element(c, to, level, inside, "- ")
        else:
            c()


def _element(node: Node, to: Lines, level: int, inside, marker: str) -> None:
    tag, a = node.tag, node.attributes
    if hidden(node):
        return
    if "style" in a and (seen := declared(a["style"]).get("visibility")) in ("hidden", "collapse", "visible"):
        before, to.quiet = to.quiet, seen != "visible"

        def heard() -> None:
            to.quiet = before

        inside([], heard)
    if tag == "br":
        if not to.line:
            to.gap = min(2, to.gap + 1) if to.out else 0
        to.end()
    elif tag == "hr":
        to.block(1)
        if not to.quiet:
            to.word("---")
        to.block(1)
    elif tag in ("img", "image"):
        if alt := a.get("alt", "").strip():
            to.flow(alt)
    elif tag == "input":
        to.flow(a.get("value", ""))
    elif tag == "svg":
        inside(_drawn(node), lambda: None)
    elif tag in ("pre", "xmp", "listing", "plaintext"):
        to.block(1)
        for k, line in enumerate([] if to.quiet else _plain(node).strip("\n").split("\n")):
            to.end()
            if line.strip():
                to.word(line.rstrip())
            elif k:
                to.out.append("")
        to.block(1)
    elif tag == "table":
        inside(_table(node, to, level), lambda: None)
    elif tag == "li":
        to.block(0)
        outer = to.indent
        to.deeper(" " * len(marker))
        size, first = len(to.indent), len(to.out) + to.gap * bool(to.out)

        def marked() -> None:
            to.block(0)
            if first < len(to.out):
                to.out[first] = outer + marker + to.out[first][size:].lstrip()
            to.indent = outer

        inside(_numbered(node), marked)
    elif tag in BLOCKS:
        gap = 0 if tag in ("ul", "ol") and to.indent else BLOCKS[tag]
        to.block(gap)
        outer = to.indent
        if tag in ("blockquote", "dd"):
            to.deeper("  ")

        def closed() -> None:
            to.block(gap)
            to.indent = outer

        inside(_numbered(node), closed)
    elif tag in ("td", "th"):

        def spaced() -> None:
            to.space = True

        inside(node.children, spaced)
    else:
        inside(node.children, lambda: None)


def _drawn(node: Node) -> list:
    """The labels of a drawing, as content to be laid out."""
    out, work = [], list(reversed(node.children))
    while work:
        c = work.pop()
        if isinstance(c, str) or hidden(c) or c.tag in UNDRAWN:
            continue
        if c.tag in ("text", "foreignobject"):
            out += [" ", *c.children, " "]
        else:
            work += reversed(c.children)
    return out


def _title(root: Node) -> str | None:
    work = [root]
    while work:
        node = work.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        if node.tag not in ("svg", "math"):
            work += (c for c in reversed(node.children) if not isinstance(c, str))
    return None


def _rendered(root: Node) -> str:
    to = Lines()
    lay(_numbered(root), to)
    return to.text()


def render(page: str | None) -> str:
    """The visible text of a page."""
    return _rendered(parse(page or ""))


def title(page: str | None) -> str | None:
    return _title(parse(page or ""))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, texts = [], []
        for page in batch.column(2):
            root = parse(page.as_py() or "")
            names.append(_title(root)), texts.append(_rendered(root))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), pa.array(names, pa.string()), pa.array(texts, pa.string())], ["page_id", "url", "title", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, title and text for each row of pages (page_id, url, html)."""
    return pages.select("page_id", "url", "html").mapInArrow(_run, "page_id bigint, url string, title string, text string")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
