"""HTML extraction by layout-aware rendering: a small tree builder, then a text layout.

The builder handles what pages leave out: end tags implied by the next start tag or the parent's end, an implied
body, void elements, unclosed and misplaced end tags, raw text in script and style, comments, and entities; the same rules
hold inside elements that are not displayed. The renderer emits
all visible text: nothing in head, script, style, template and the like, in elements with `hidden` or an inline
style of display:none or visibility:hidden (until an element that is visible again), and no form values; of SVG the
text elements and foreign objects that are drawn, of MathML all but annotations. Blocks begin on
a new line, paragraphs and headings stand between blank lines (which collapse), lists get bullets or numbers and an indent,
`pre` keeps its blanks, and the cells of a table are padded to columns.

Work and memory are linear in the page; nesting is no recursion, and displayed depth over MAX_DEPTH is kept flat. A null page
has a null title and an empty text; an empty page, or one without visible text, an empty text.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import with_columns

MAX_DEPTH = 512
MAX_COLUMN = 80  # cells are padded up to this width

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
ESCAPABLE = frozenset(("title", "textarea"))
UNSEEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas datalist select textarea title".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure fieldset hr".split())
BLOCK = SPACED | frozenset("""html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li main menu
nav option search section summary caption thead tbody tfoot tr td th""".split())
CLOSES_P = BLOCK - frozenset("html body option caption thead tbody tfoot tr td th".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
# start tag -> open elements that it ends, and the elements at which the search for them stops
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "td": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "th": (frozenset(("td", "th")), frozenset(("table", "tr"))),
    "tr": (frozenset(("tr", "td", "th", "caption")), frozenset(("table", "thead", "tbody", "tfoot"))),
    "thead": (frozenset(("thead", "tbody", "tfoot", "caption", "tr", "td", "th")), frozenset(("table",))),
    "tbody": (frozenset(("thead", "tbody", "tfoot", "caption", "tr", "td", "th")), frozenset(("table",))),
    "tfoot": (frozenset(("thead", "tbody", "tfoot", "caption", "tr", "td", "th")), frozenset(("table",))),
}
WALLS = frozenset("table td th caption html body".split())  # an end tag inside does not close what is outside
APART = frozenset(("template", "object"))  # nor does any tag inside these
TABLE = frozenset("table tr td th thead tbody tfoot caption".split())
FOREIGN = frozenset(("svg", "math"))
INTEGRATION = frozenset("foreignobject mi mo mn ms mtext".split())  # hold HTML in foreign elements
BREAKOUT = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby
s small span strong strike sub sup table tt u ul var""".split())  # end foreign elements
DRAWN = frozenset(("text", "foreignobject"))
UNDRAWN = frozenset("desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
SHOWN, MUTE, DARK = range(3)  # MUTE: SVG outside DRAWN

_TOKEN = re.compile(r"""<(?:!--(?P<comment>.*?)(?:--!?>|\Z)|(?P<end>/)?(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+)))?""")
_BLANKS = re.compile(r"[ \t\n\r\f]+")
_HIDDEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_INVISIBLE = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)


class Node:
    __slots__ = ("tag", "children", "shown", "start", "light")

    def __init__(self, tag: str, shown: bool | None = None, start: int = 1, light: int = SHOWN):
        self.tag, self.children, self.shown, self.start, self.light = tag, [], shown, start, light  # shown: None as the parent


def _visibility(tag: str, rest: str) -> tuple[bool, bool | None, int]:
    """(displayed, own visibility or None, number of a list's first item) of a start tag."""
    if tag in UNSEEN:
        return False, None, 1
    if "=" not in rest and "hidden" not in rest.lower():
        return True, None, 1
    shown, start, displayed = None, 1, True
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        name, value = name.lower(), a or b or c
        if name == "hidden" and value.lower() != "until-found":
            displayed = False
        elif name == "style" and value:
            value = unescape(value)
            if _HIDDEN.search(value):
                displayed = False
            if found := _INVISIBLE.findall(value):
                shown = found[-1].lower() == "visible"
        elif name == "start" and re.fullmatch(r"-?\d{1,9}", value or ""):
            start = int(value)
    return displayed, shown, start


def build(page: str) -> tuple[Node, str | None]:
    """(tree, title) of a page. Undisplayed elements are open like others, but hold no children and are in no tree."""
    root = Node("html")
    stack: list[Node] = [root]
    places: dict[str, list[int]] = {}  # open elements by tag, ascending
    title: str | None = None
    at, n = 0, len(page)

    def last(tags) -> int:
        return max((places[x][-1] for x in tags if places.get(x)), default=0)

    def cut(place: int) -> None:
        while len(stack) > place:
            places[stack.pop().tag].pop()

    def close(names: frozenset, stops: frozenset) -> None:
        stop = max(last(stops), last(APART))
        inside = [x[i] for x in map(places.get, names) if x and (i := bisect_right(x, stop)) < len(x)]
        if inside:
            cut(min(inside))

    def foreign() -> bool:
        return last(FOREIGN) > last(INTEGRATION)

    def text(piece: str) -> None:
        if not piece:
            return
        if stack[-1].tag == "head" and not _BLANKS.fullmatch(piece):
            cut(len(stack) - 1)
        if stack[-1].light == SHOWN:
            stack[-1].children.append(unescape(piece) if "&" in piece else piece)

    while at < n:
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            break
        text(page[at:found.start()])
        at = found.end()
        name = found["name"]
        if not name:
            continue
        tag = name.lower()
        if stack[-1].tag == "head" and not found["end"] and tag not in HEAD_ONLY and tag != "head":
            cut(len(stack) - 1)  # a head without an end
        top = stack[-1]
        if found["end"]:
            if tag == "br" or tag == "p" and not places.get("p"):
                if top.light == SHOWN:
                    top.children.append(Node(tag))
            elif places.get(tag):
                place = places[tag][-1]
                if place >= last(APART) and place >= last(("table",) if tag in TABLE else WALLS) or tag == "table" and place >= last(APART):
                    cut(place)
            continue
        rest = found["rest"]
        alien = bool(places.get("svg") or places.get("math")) and foreign()
        if alien and tag in BREAKOUT:
            while foreign():
                cut(last(FOREIGN))
            alien, top = False, stack[-1]
        if tag in RAW or tag in ESCAPABLE:
            if alien and rest.endswith("/"):
                continue
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            inner, at = (page[at:end.start()], end.end()) if end else (page[at:], n)
            if tag == "title" and title is None and not alien:
                title = _BLANKS.sub(" ", unescape(inner)).strip(" ")
            continue
        if tag in ("html", "body"):
            continue
        displayed, shown, start = _visibility(tag, rest)
        if not alien and tag in CLOSES_P:
            close(frozenset(("p",)), WALLS)
        if not alien and tag in ENDS:
            close(*ENDS[tag])
        top = stack[-1]
        if top.light == DARK or not displayed or alien and tag in UNDRAWN:
            light = DARK
        elif tag == "svg":
            light = MUTE
        else:
            light = SHOWN if tag in DRAWN else top.light
        if tag in VOID:
            if light == SHOWN:
                top.children.append(Node(tag, shown))
            continue
        node = Node(tag, shown, start, light)
        if light != DARK:
            if light < top.light:
                top.children.append(" ")
            top.children.append(node)
        if alien and rest.endswith("/"):
            continue
        if light or top.light or len(stack) < MAX_DEPTH:
            places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root, title


class _Lines:
    """Text laid out in lines. Blank lines collapse to one, and white space to one blank outside `pre`."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = False  # a blank is due before the next word
        self.spaced = False  # a blank line is due before the next line
        self.indent: list[str] = []
        self.mark = ""

    def words(self, text: str) -> None:
        folded = _BLANKS.sub(" ", text)
        if folded[:1] == " ":
            self.gap = True
            folded = folded[1:]
        if not folded:
            return
        if self.parts and self.gap:
            self.parts.append(" ")
        self.gap = folded[-1] == " "
        self.parts.append(folded[:-1] if self.gap else folded)

    def fresh(self) -> None:
        """End the line if anything stands on it."""
        self.gap = False
        if self.parts:
            self.line("".join(self.parts))
            self.parts = []

    def line(self, text: str) -> None:
        if self.spaced and self.lines:
            self.lines.append("")
        self.spaced = False
        pad = "".join(self.indent)
        if self.mark:
            pad = pad[:-len(self.mark)] + self.mark if len(pad) >= len(self.mark) else self.mark
            self.mark = ""
        self.lines.append((pad + text).rstrip(" "))

    def blank(self) -> None:
        self.fresh()
        self.spaced = True


def _table(rows: list[list[str]]) -> list[str]:
    """Rows of cell texts as lines, cells padded to their column's width."""
    split = [[cell.split("\n") for cell in row] for row in rows]
    widths: list[int] = []
    for row in split:
        for i, cell in enumerate(row):
            width = min(MAX_COLUMN, max(map(len, cell)))
            if i == len(widths):
                widths.append(width)
            widths[i] = max(widths[i], width)
    lines = []
    for row in split:
        for k in range(max(map(len, row), default=0)):
            lines.append("  ".join((cell[k] if k < len(cell) else "").ljust(widths[i]) for i, cell in enumerate(row)).rstrip(" "))
    return lines


def render(root: Node) -> str:
    """The visible text of a tree."""
    out = _Lines()
    tables: list[list[list[str]]] = []
    # work: nodes to open, and closures as (function,) to run after an element's children
    work: list = [(root, True, False, None)]
    while work:
        item = work.pop()
        if callable(item):
            out = item(out) or out
            continue
        node, shown, pre, lists = item
        if isinstance(node, str):
            if shown:
                if pre:
                    first, *more = node.replace("\r\n", "\n").split("\n")
                    if first:
                        out.parts.append(first)
                    for piece in more:
                        out.line("".join(out.parts))
                        out.parts = [piece] if piece else []
                else:
                    out.words(node)
            continue
        tag = node.tag
        shown = shown if node.shown is None else node.shown
        if tag == "br":
            if shown:
                if out.parts:
                    out.fresh()
                elif not out.spaced and out.lines and out.lines[-1]:
                    out.line("")
            continue
        if tag == "hr":
            out.blank()
            if shown:
                out.line("---")
            out.spaced = True
            continue
        after = []
        if tag in ("td", "th", "caption") and tables:
            outer, out = out, _Lines()

            def end_cell(inner, outer=outer, tag=tag):
                inner.fresh()
                cell = "\n".join(inner.lines)
                if tag == "caption":
                    outer.blank()
                    for line in inner.lines:
                        outer.line(line)
                else:
                    if not tables[-1]:
                        tables[-1].append([])
                    tables[-1][-1].append(cell)
                return outer
            after.append(end_cell)
            lists = None
        elif tag == "tr" and tables:
            tables[-1].append([])
        elif tag == "table":
            out.blank()
            tables.append([])

            def end_table(now):
                now.blank()
                for line in _table([row for row in tables.pop() if row]):
                    now.line(line)
                now.spaced = True
            after.append(end_table)
        elif tag in BLOCK:
            nested = tag in ("ul", "ol") and lists is not None
            if tag in SPACED and not nested:
                out.blank()
            else:
                out.fresh()
            if tag == "li":
                mark = f"{lists[0]}. " if lists and lists[1] else "- "
                if lists:
                    lists[0] += 1
                out.indent.append(" " * len(mark))
                out.mark = mark if shown else ""
            elif tag in ("blockquote", "dd"):
                out.indent.append("  ")

            def end_block(now, tag=tag, nested=nested):
                now.fresh()
                if tag in ("li", "blockquote", "dd"):
                    now.indent.pop()
                    if tag == "li":
                        now.mark = ""
                if tag in SPACED and not nested:
                    now.spaced = True
            after.append(end_block)
            if tag in ("ul", "ol"):
                lists = [node.start, tag == "ol"]
            pre = pre or tag == "pre"
        work.extend(after)
        work.extend((child, shown, pre, lists) for child in reversed(node.children))
    out.fresh()
    return "\n".join(out.lines).strip("\n")


def extract(page: str | None) -> tuple[str | None, str]:
    """(title, visible text) of a page."""
    if not page:
        return None, ""
    root, title = build(page)
    return title, render(root)


def extract_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """`pages` (or its columns `keep`) with title and text, which replace columns of the same name."""
    def compute(column: pa.Array) -> list[pa.Array]:
        found = [extract(page) for page in column.to_pylist()]
        return [pa.array([t for t, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())]

    return with_columns(pages, html, [T.StructField("title", T.StringType()), T.StructField("text", T.StringType())], compute, keep)
