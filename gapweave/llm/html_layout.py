"""All visible text of a page, laid out: blocks apart, lists marked, table cells aligned.

A tree builder with implied tags reads the page.  What is not displayed (by name, by
attribute, by inline style or by a simple rule of the page's own style sheet, in a closed
details) goes with all inside it; hidden elements keep what is made visible inside them.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .shared import prepare

#: Elements deeper than this become children of the one at this depth, as in browsers.
DEPTH = 512
#: The widest a column of a table gets; a longer line reaches into the next one, which then follows after two spaces.
WIDEST = 160

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/](?P<other>[^>]*+)(?:>|\Z)", re.S
)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([\w-]+)", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*([\w-]+)", re.I)
_MEDIA = re.compile(r"@media([^{]*)\{((?:[^{}]*\{[^{}]*\})*[^{}]*)\}", re.I)
_REMARK = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_SPACE = re.compile(r"[ \t\n\r\f]+")

# Fixed values of the HTML standard: which elements have no content, hold raw text, close others, are not rendered.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNRENDERED = frozenset("head script style template noscript title meta link base iframe object embed video audio canvas svg math datalist noembed noframes param source track area map rp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption optgroup option".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset menu dir".split())
LISTS = frozenset("ul ol menu dir".split())
ENDS_P = BLOCKS - frozenset("body html tbody td tfoot th thead tr caption option optgroup legend".split())
#: A start tag closes an open element of the first set, unless one of the second is nearer.
_CELLS, _TABLE = frozenset(["td", "th"]), frozenset(["table"])
_SECTIONS = frozenset(["thead", "tbody", "tfoot"])
CLOSES = {
    "li": (frozenset(["li"]), LISTS), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "td": (_CELLS, _TABLE | {"tr"}), "th": (_CELLS, _TABLE | {"tr"}), "tr": (frozenset(["tr", "caption", "colgroup"]), _TABLE),
    "thead": (_SECTIONS | {"caption", "colgroup"}, _TABLE), "tbody": (_SECTIONS | {"caption", "colgroup"}, _TABLE), "tfoot": (_SECTIONS | {"caption", "colgroup"}, _TABLE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist", "optgroup"])), "optgroup": (frozenset(["optgroup", "option"]), frozenset(["select"])),
}
#: What an end tag does not reach across.
BARRIERS = frozenset("table td th caption template body html".split())


class Node:
    """An element with its children (nodes and strings)."""

    __slots__ = ("attrs", "children", "name")

    def __init__(self, name: str, attrs: dict[str, str] | None = None):
        self.name, self.attrs, self.children = name, attrs or {}, []


class Builder:
    """The open elements and the tree so far."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]

    def close(self, names: frozenset[str], barriers: frozenset[str]) -> None:
        """Close the nearest open element of names and all inside it."""
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name in names:
                del self.open[k:]
                return
            if self.open[k].name in barriers:
                return

    def push(self, node: Node, stays: bool) -> None:
        self.open[-1].children.append(node)
        if stays and len(self.open) < DEPTH:
            self.open.append(node)

    def start(self, name: str, attrs: dict[str, str]) -> None:
        if name == "html" or name == "body" and any(n.name == "body" for n in self.open):
            return
        if name in BLOCKS and self.open[-1].name == "head" or name == "body":
            self.close(frozenset(["head"]), frozenset())
        if name in ENDS_P:
            self.close(frozenset(["p"]), BARRIERS)
        if name in CLOSES:
            self.close(*CLOSES[name])
        inside = self.open[-1].name
        if name in ("td", "th") and inside in ("table", *_SECTIONS):
            self.start("tr", {})
        elif name == "tr" and inside == "table":
            self.start("tbody", {})
        self.push(Node(name, attrs), name not in VOID)

    def end(self, name: str) -> None:
        if name == "br":
            self.push(Node("br"), False)
        elif name not in ("html", "body"):
            tables = _TABLE | _SECTIONS | _CELLS | {"tr", "caption"}
            self.close(frozenset([name]), _TABLE - {name} if name in tables else BARRIERS - {name})

    def text(self, text: str) -> None:
        if text:
            self.open[-1].children.append(text)


def parse(html: str) -> Node:
    """The tree of a page; unclosed, misnested and stray tags end as the builder's rules say."""
    b, at = Builder(), 0
    while m := _TOKEN.search(html, at):
        b.text(unescape(html[at : m.start()]))
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            b.end(name)
            continue
        attrs = {k.lower(): unescape(x or y or z) for k, x, y, z in _ATTR.findall(m["attrs"])} if m["attrs"].strip(" /\n\t\r\f") else {}
        b.start(name, attrs)
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            raw = html[at : close.start() if close else len(html)]
            b.text(unescape(raw) if name in ("textarea", "title") else raw)
            at = at + len(raw)
    b.text(unescape(html[at:]))
    return b.root


#: What a selector or an inline style says: whether an element is gone (display) and whether it is hidden (visibility); None where it says nothing.
Look = tuple[bool | None, bool | None]


def _look(css: str) -> Look:
    """The last display and visibility of a list of declarations."""
    d, v = _DISPLAY.findall(css), _VISIBILITY.findall(css)
    return (d[-1].lower() == "none" if d else None, v[-1].lower() in ("hidden", "collapse") if v else None)


def sheet(root: Node) -> dict[str, Look]:
    """What the page's own style sheets say by simple selector (name, .class or #id); only rules that hold on every screen count."""
    found: dict[str, Look] = {}
    todo = [root]
    while todo:
        node = todo.pop()
        if node.name == "style":
            css = _REMARK.sub(" ", "".join(c for c in node.children if isinstance(c, str)))
            css = _MEDIA.sub(lambda m: m[2] if m[1].strip().lower() in ("", "all", "screen", "only screen") else " ", css)
            for selectors, body in _RULE.findall(css):
                gone, dim = _look(body)
                if gone is None and dim is None:
                    continue
                for one in map(str.strip, selectors.split(",")):
                    if re.fullmatch(r"[.#]?[\w-]+", one):
                        old = found.get(one, (None, None))
                        found[one] = (old[0] if gone is None else gone, old[1] if dim is None else dim)
        todo += reversed([c for c in node.children if isinstance(c, Node)])
    return found


def shown(node: Node, rules: dict[str, Look], dim: bool) -> bool | None:
    """Whether an element's own text is hidden (dim, which it inherits); None if the element is gone with all inside it.

    Inline style goes before id, class and name, as far as simple rules tell.
    """
    a = node.attrs
    if node.name in UNRENDERED or (node.name == "dialog" and "open" not in a):
        return None
    gone = hides = None
    if a and "style" in a:
        gone, hides = _look(a["style"])
    if rules:
        names = [f"#{a['id']}"] if "id" in a else []
        for one in (*names, *(f".{c}" for c in a.get("class", "").split()), node.name):
            if one in rules:
                gone, hides = (old if old is not None else new for old, new in zip((gone, hides), rules[one]))
    if gone or (gone is None and "hidden" in a):
        return None
    return dim if hides is None else hides


class Page:
    """Lines of text with white space collapsed, blocks kept apart and prefixes for lists."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False
        self.indent = ""
        self.mark = ""

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            self.now.append(first)
            for line in rest:
                self.flush(keep=True)
                self.now.append(line)
            return
        text = _SPACE.sub(" ", text)
        if text[:1] == " " and (not self.now or self.now[-1][-1:] in (" ", "")):
            text = text[1:]
        if text:
            self.now.append(text)

    def flush(self, keep: bool = False) -> None:
        """End the line; keep: also one without text."""
        line = "".join(self.now).rstrip()
        self.now = []
        if not line and not keep:
            return
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append((self.indent[: len(self.indent) - len(self.mark)] + self.mark + line).rstrip() if line or self.mark else "")
        self.mark = ""

    def space(self) -> None:
        """A blank line before the next text."""
        self.flush()
        self.gap = True

    def done(self) -> list[str]:
        self.flush()
        return self.lines


def _span(node: Node, name: str, most: int) -> int:
    """A cell's colspan or rowspan, 1 unless it is a number; 0 is kept."""
    value = node.attrs.get(name, "1").strip()
    return min(int(value[:9]), most) if value.isascii() and value.isdigit() else 1


def _grid(rows: list[tuple[int, list[Node]]]) -> list[list[tuple[int, int, Node]]]:
    """By row: (column, columns, cell).  Cells go to the next column that none from above reaches into; rowspans end with their section."""
    grid, below, section = [], {}, None
    left = {}
    for number, _ in rows:
        left[number] = left.get(number, 0) + 1
    for number, cells in rows:
        if number != section:
            below, section = {}, number
        line, at = [], 0
        taken, below = below, {c: n - 1 for c, n in below.items() if n > 1}
        for cell in cells:
            wide, high = max(1, _span(cell, "colspan", 1000)), _span(cell, "rowspan", 65534) or left[number]
            while at in taken:
                at += 1
            line.append((at, wide, cell))
            if high > 1:
                below |= dict.fromkeys(range(at, at + wide), high - 1)
            at += wide
        left[number] -= 1
        grid.append(line)
    return grid


def _table(node: Node, rules: dict[str, Look], dim: bool) -> list[str]:
    """Rows of a table with cells aligned by column; captions and what else is not in a cell come first."""
    lines, rows, hides, sections = [], [], [], 0
    todo = [(c, dim, 0) for c in reversed(node.children)]
    while todo:
        x, dim, section = todo.pop()
        if isinstance(x, str):
            if x.strip() and not dim:
                lines += [_SPACE.sub(" ", x).strip()]
        elif (own := shown(x, rules, dim)) is not None:
            if x.name == "tr":
                cells = [(c, d) for c in x.children if isinstance(c, Node) and c.name in _CELLS and (d := shown(c, rules, own)) is not None]
                rows.append((section, [c for c, _ in cells]))
                hides.append([d for _, d in cells])
                lines += render([c for c in x.children if not (isinstance(c, Node) and c.name in _CELLS)], rules, own)
            elif x.name in _SECTIONS:
                sections += 1
                todo += [(c, own, sections) for c in reversed(x.children)]
            elif x.name not in ("colgroup", "col"):
                lines += render([x], rules, dim)
    grid = [[(at, wide, render(cell.children, rules, d) or [""]) for (at, wide, cell), d in zip(line, dims)] for line, dims in zip(_grid(rows), hides)]
    longest = lambda own: max((len(x) for x in own if len(x) <= WIDEST), default=0)
    width: dict[int, int] = {}
    for line in grid:
        for at, wide, own in line:
            if wide == 1:
                width[at] = max(width.get(at, 0), longest(own))
    for wide, at, own in sorted(((w, at, own) for line in grid for at, w, own in line if w > 1), key=lambda x: x[:2]):
        inside = [c for c in range(at, at + wide) if width.get(c)] or [at]
        if (more := longest(own) - sum(width.get(c, 0) + 2 for c in inside) + 2) > 0:
            width[inside[-1]] = min(WIDEST, width.get(inside[-1], 0) + more)
    columns = sorted(c for c, w in width.items() if w)
    begin = [0]
    for c in columns:
        begin.append(begin[-1] + width[c] + 2)
    for line in grid:
        for k in range(max((len(own) for *_, own in line), default=0)):
            out = ""
            for at, _, own in line:
                piece, start = own[k] if k < len(own) else "", begin[bisect_left(columns, at)]
                if piece:
                    out = out + "  " if out and len(out) + 2 > start else out.ljust(start)
                    out += piece
            lines.append(out.rstrip())
    return lines


#: Kinds of input whose value is on show.
_SHOWN_INPUT = frozenset("submit button reset text search email url tel number date".split())


def _walk(page: Page, children: list, rules: dict[str, Look], pre: bool, lists: int, dim: bool) -> None:
    for c in children:
        if isinstance(c, str):
            if not dim:
                page.text(c, pre)
            continue
        own = shown(c, rules, dim)
        if own is None:
            continue
        name, inside = c.name, c.children
        if name == "details" and "open" not in c.attrs:
            inside = [x for x in inside if isinstance(x, Node) and x.name == "summary"][:1]
        if name == "br":
            page.flush(keep=True)
        elif name == "input":
            if not own and c.attrs.get("type", "text").lower() in _SHOWN_INPUT:
                page.text(c.attrs.get("value", ""), pre)
        elif name == "table":
            page.space()
            for line in _table(c, rules, own):
                page.now = [line]
                page.flush(keep=True)
            page.space()
        elif name in LISTS:
            page.flush() if lists else page.space()
            number = int(s) if (s := c.attrs.get("start", "1")).isdecimal() and len(s) < 9 else 1
            outer, page.indent = page.indent, page.indent + "  "
            for item in inside:
                if isinstance(item, Node) and item.name == "li" and (hides := shown(item, rules, own)) is not None:
                    page.flush()
                    page.mark = "" if hides else f"{number}. " if name == "ol" else "- "
                    page.indent = outer + " " * len(page.mark)
                    _walk(page, item.children, rules, pre, lists + 1, hides)
                    page.flush(keep=bool(page.mark))
                    number += 1
                else:
                    _walk(page, [item], rules, pre, lists + 1, own)
            page.flush()
            page.indent = outer
            page.gap |= not lists
        elif name in BLOCKS:
            spaced = name in SPACED
            page.space() if spaced else page.flush()
            outer = page.indent
            if name in ("blockquote", "dd"):
                page.indent += "  "
            _walk(page, inside, rules, pre or name == "pre", lists, own)
            page.space() if spaced else page.flush()
            page.indent = outer
        elif name == "q":
            mark = "" if own else '"'
            page.text(mark, pre)
            _walk(page, inside, rules, pre, lists, own)
            page.text(mark, pre)
        else:
            _walk(page, inside, rules, pre or name == "textarea", lists, own)


def render(children: list, rules: dict[str, Look], dim: bool = False) -> list[str]:
    page = Page()
    _walk(page, children, rules, False, 0, dim)
    return page.done()


def to_text(html: str | None) -> str:
    """The visible text of a page; null and empty pages have none."""
    if not html:
        return ""
    # A level of nesting takes at most three calls.
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * DEPTH + 1000))
    root = parse(html.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�"))
    return "\n".join(render(root.children, sheet(root)))


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per row: id and text.  Null and empty pages have an empty text; repeated rows stay; very long pages are read whole; other columns are not read."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textops.chunks(batches, "_html"):
            made = [to_text(x) for x in batch.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(made, pa.string())], ["_id", "text"])

    rows = pages.select(F.col(id_col).alias("_id"), F.col(html_col).alias("_html"))
    schema = T.StructType([T.StructField("_id", pages.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)
