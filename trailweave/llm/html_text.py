"""Layout-aware text of web pages: a tree builder with implied tags, visibility rules, and a renderer."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from heapq import heappop, heappush
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._text import pieces

#: Fixed values of HTML: elements by how they are parsed or shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes title datalist object audio video canvas rp area base link meta param source track desc defs metadata annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure hr".split())
CLOSES_P = BLOCK - frozenset("body dd dt html li tbody td tfoot th thead tr caption option optgroup legend summary".split())
#: A start tag ends open elements of these names, up to one of those that bound the search.
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption"}, {"table"}),
    "colgroup": ({"colgroup", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
IN_HEAD = frozenset("base link meta script style template title noscript head html".split())
SCOPE = frozenset("table td th caption html template button object".split())

_ASIDE = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)", re.DOTALL)  # comments and declarations
_END = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z)")
_START = re.compile(r"<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_OPEN = re.compile(r"<(?=[a-zA-Z/!?])")
_NAME_ENDS, _MARKS = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.IGNORECASE)
_SPACES = re.compile(r"[ \t\n\r\f]+")


MOST_INDENT = 80  # characters; what is nested deeper begins there, too
MOST_TABLES = 8  # within one another that are aligned; those within are blocks like others
MOST_WIDTH = 100  # of a column that others are aligned by


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(self.attrs)}

    def shown(self) -> tuple[bool, str]:
        """Whether the element is laid out at all, and its own ``visibility``, if it sets one."""
        if self.tag in HIDDEN:
            return False, ""
        if not self.attrs:
            return self.tag != "dialog", ""
        attrs = self.attributes()
        style = {name.lower(): value.lower() for name, value in _STYLE.findall(attrs.get("style", ""))}
        here = "hidden" not in attrs and style.get("display") != "none" and (self.tag != "dialog" or "open" in attrs)
        return here, style.get("visibility", "")

    def in_view(self) -> list:
        """The children that the element shows: of a closed ``details`` the summary, of a drop-down list the chosen option."""
        if self.tag == "details" and "open" not in self.attributes():
            return [x for x in self.children if isinstance(x, Node) and x.tag == "summary"][:1]
        if self.tag == "select":
            attrs = self.attributes()
            options, work = [], list(reversed(self.children))
            while work:
                x = work.pop()
                if isinstance(x, Node) and x.tag == "optgroup":
                    work.extend(reversed(x.children))
                elif isinstance(x, Node) and x.tag == "option":
                    options.append(x)
            if "multiple" in attrs or attrs.get("size", "0") not in ("", "0", "1"):
                return options
            chosen = [x for x in options if "selected" in x.attributes()][-1:] or [x for x in options if "disabled" not in x.attributes()][:1]
            return chosen[0].children if chosen else []
        return self.children


class Open:
    """The stack of open elements, with the places of each tag, so that none is looked for step by step."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.stack[-1].children.append(node)
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """The place of the innermost open element of some tags, or 0."""
        return max((at[-1] for tag in tags if (at := self.places.get(tag))), default=0)

    def cut(self, place: int) -> None:
        for node in self.stack[place:]:
            self.places[node.tag].pop()
        del self.stack[place:]

    def close(self, tags, bounds) -> bool:
        """Closes the outermost open element of ``tags`` above the nearest of ``bounds``, with all in it."""
        bound = self.last(bounds)
        found = [at[k] for tag in tags if (at := self.places.get(tag)) and (k := bisect_right(at, bound)) < len(at)]
        if found:
            self.cut(min(found))
        return bool(found)

    def end(self, tag: str) -> bool:
        """Closes the innermost element of the tag, with all in it, unless something that bounds its scope is within."""
        place = self.last((tag,))
        if not place or tag not in UNBOUND and self.last(SCOPE - {tag}) > place:
            return False
        self.cut(place)
        return True


UNBOUND = frozenset("table tr tbody thead tfoot html body".split())


class Tags:
    """Where start tags of a page end: quotes hide what is in them.  Tags without an end are told without reading on to the page's end for each."""

    def __init__(self, html: str):
        self.html = html
        self.ends: dict[int, int | None] = {}  # by the mark that comes next, past the tag's ``>``
        self.name = (0, -1)  # where an end of a name was looked for, and found

    @cached_property
    def marks(self) -> list[int]:
        return [m.start() for m in _MARKS.finditer(self.html)]

    @cached_property
    def quotes(self) -> dict[str, list[int]]:
        return {q: [p for p in self.marks if self.html[p] == q] for q in "\"'"}

    def start_tag(self, at: int) -> tuple[int, int] | None:
        """Past a start tag's name, and past its ``>``; null if it has none."""
        if not self.name[0] <= at < self.name[1]:
            m = _NAME_ENDS.search(self.html, at)
            self.name = (at, m.start() if m else len(self.html))
        name_end, passed = self.name[1], []
        k = bisect_left(self.marks, name_end)
        while k < len(self.marks) and k not in self.ends:
            passed.append(k)
            mark = self.marks[k]
            if self.html[mark] == ">":
                self.ends[k] = mark + 1
                break
            same = self.quotes[self.html[mark]]
            other = bisect_left(same, mark + 1)
            k = bisect_left(self.marks, same[other] + 1) if other < len(same) else len(self.marks)
        end = self.ends.get(k)
        for p in passed:
            self.ends[p] = end  # tags that come to one mark end alike
        return None if end is None else (name_end, end)


def parse(html: str) -> Node:
    """The page's tree.  What a start tag ends by implication is closed first; end tags without a start are ignored, but for ``br`` and ``p``, which stand for an empty element.  A start tag without ``>`` is text."""
    root = Node("html")
    tree = Open(root)
    tags, whole = Tags(html), True
    at = here = 0  # text begins, and the next tag is looked for
    while opened := _OPEN.search(html, here):
        begin = opened.start()
        start, end, attrs = "", "", ""
        if html[begin + 1] in "!?":
            stop = _ASIDE.match(html, begin).end()
        elif html[begin + 1] == "/":
            m = _END.match(html, begin)
            stop, end = (m.end(), m[1]) if m else (None, "")
        elif whole and (m := _START.match(html, begin)):
            stop, start, attrs = m.end(), m[1], m[2]
        else:
            whole = False  # one tag has no end: others may have none
            found = tags.start_tag(begin)
            stop = found and found[1]
            if found:
                start, attrs = html[begin + 1 : found[0]], html[found[0] : found[1] - 1]
        if stop is None:
            here = begin + 1
            continue
        if begin > at:
            text = html[at:begin]
            if tree.places.get("head") and text.strip():
                tree.close({"head"}, set())
            tree.stack[-1].children.append(text)
        at = here = stop
        if end:
            tag = end.lower()
            if tag == "br" or not tree.end(tag) and tag == "p":
                tree.stack[-1].children.append(Node(tag))
        elif start:
            tag = start.lower()
            if tree.places.get("head") and tag not in IN_HEAD:
                tree.close({"head"}, set())
            if tag in CLOSES_P:
                tree.close({"p"}, SCOPE)
            if tag in IMPLIED_END:
                tree.close(*IMPLIED_END[tag])
            if tag in ("html", "body") and (tag == "html" or tree.places.get("body")):
                continue
            if tag in ("td", "th") and tree.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                tree.push(Node("tr"))
            node = Node(tag, attrs)
            if tag in VOID:
                tree.stack[-1].children.append(node)
            elif tag in RAW:
                tree.stack[-1].children.append(node)
                stop = _raw_end(tag).search(html, at)
                node.children.append(html[at : stop.start()])
                at = here = stop.end()
            else:
                tree.push(node)
    if at < len(html):
        tree.stack[-1].children.append(html[at:])
    return root


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.IGNORECASE)


class Flow:
    """Lines of text under construction: collapses white space and keeps blocks apart."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # between what is written and what comes next on the line
        self.blank = False  # before what comes next
        self.indents = [""]
        self.bullet = ""

    def inline(self, text: str) -> None:
        words = _SPACES.split(text)
        if len(words) == 1 and not words[0]:
            return
        if not words[0]:
            self.space = bool(self.line)
        body = " ".join(w for w in words if w)
        if body:
            self._open()
            self.line.append((" " if self.space else "") + body)
            self.space = not words[-1]

    def _open(self) -> None:
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = self.space = False
            self.line.append(self.indents[-1] + self.bullet)
            if self.bullet:
                self.indent(len(self.bullet))
                self.bullet = ""

    def indent(self, more: int) -> None:
        """Moves what follows in the innermost element to the right."""
        self.indents[-1] = (self.indents[-1] + " " * more)[:MOST_INDENT]

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.blank |= spaced

    def verbatim(self, text: str) -> None:
        for k, row in enumerate(text.split("\n")):
            if k:
                if not self.line:
                    self.lines.append("")
                self.end_line()
            if row:
                self._open()
                self.line.append(row)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


@dataclass
class Cell:
    text: str
    columns: int = 1  # that it spans
    rows: int = 1  # 0: to the end of the table
    at: int = 0  # its first column

    @classmethod
    def of(cls, node: Node) -> Cell:
        attrs = node.attributes() if node.attrs else {}
        columns, rows = (int(x) if (x := attrs.get(name, "").strip()).isascii() and x.isdigit() and len(x) < 9 else 1 for name in ("colspan", "rowspan"))
        return cls("", min(max(columns, 1), 1000), min(rows, 65534))


class Taken:
    """Columns that cells of rows above reach into: regions side by side, each until some row, and the runs that they make up."""

    def __init__(self):
        self.regions: dict[int, tuple[int, int]] = {}  # by first column: past the last one, and until which row
        self.firsts: list[int] = []
        self.starts: list[int] = []  # of runs without a gap
        self.ends: list[int] = []
        self.expiring: list[tuple[int, int, int]] = []

    def free(self, column: int) -> int:
        """The first column from here on that isn't taken."""
        k = bisect_right(self.starts, column) - 1
        return self.ends[k] if k >= 0 and self.ends[k] > column else column

    def _put(self, first: int, last: int, until: int) -> None:
        self.regions[first] = (last, until)
        insort(self.firsts, first)
        heappush(self.expiring, (until, first, last))

    def _cover(self, first: int, last: int) -> None:
        """Joins free columns to the runs beside them."""
        k = bisect_left(self.starts, first)
        if k and self.ends[k - 1] == first:
            self.ends[k - 1] = last
            k -= 1
        else:
            self.starts.insert(k, first)
            self.ends.insert(k, last)
        if k + 1 < len(self.starts) and self.starts[k + 1] == last:
            self.ends[k] = self.ends[k + 1]
            del self.starts[k + 1], self.ends[k + 1]

    def add(self, first: int, last: int, until: int) -> None:
        """Takes columns until a row; those that are taken already stay so until the later of both rows."""
        k = bisect_right(self.firsts, first) - 1
        k = k if k >= 0 and self.regions[self.firsts[k]][0] > first else k + 1
        at = first
        while at < last:
            start = self.firsts[k] if k < len(self.firsts) else last
            if at < start:  # free up to the next region
                stop = min(start, last)
                self._cover(at, stop)
                self._put(at, stop, until)
                k, at = k + 1, stop
                continue
            end, before = self.regions[start]
            stop = min(end, last)
            if before < until:
                del self.firsts[k], self.regions[start]
                parts = [(start, at, before), (at, stop, until), (stop, end, before)]
                for a, b, u in parts:
                    if a < b:
                        self._put(a, b, u)
                        k += 1
            else:
                k += 1
            at = stop

    def expire(self, row: int) -> None:
        """Gives back what is taken until this row."""
        while self.expiring and self.expiring[0][0] <= row:
            until, first, last = heappop(self.expiring)
            if self.regions.get(first) != (last, until):
                continue  # it was taken anew since
            del self.regions[first], self.firsts[bisect_left(self.firsts, first)]
            k = bisect_right(self.starts, first) - 1
            start, end = self.starts[k], self.ends[k]
            self.starts[k : k + 1], self.ends[k : k + 1] = [a for a, b in ((start, first), (last, end)) if a < b], [b for a, b in ((start, first), (last, end)) if a < b]


def place(rows: list[list[Cell]]) -> None:
    """Gives each cell its first column: the next one that no cell to its left, and none from a row above, takes."""
    taken = Taken()
    for r, row in enumerate(rows):
        taken.expire(r)
        column = 0
        for cell in row:
            cell.at = taken.free(column)
            column = cell.at + cell.columns
        for cell in row:
            until = min(r + cell.rows, len(rows)) if cell.rows else len(rows)
            if until > r + 1:
                taken.add(cell.at, cell.at + cell.columns, until)


def aligned(rows: list[list[Cell]]) -> list[str]:
    """A table's rows as lines; cells of a column begin at the same place, and cells of several lines take several.

    Columns are aligned by cells of up to ``MOST_WIDTH`` characters.  A table of which that would make far more than
    its text has gets its cells side by side or, those of several lines, one below the other.
    """
    place(rows)
    rows = [row for row in rows if any(c.text for c in row)]
    starts = sorted({c.at for row in rows for c in row})
    number = {at: k for k, at in enumerate(starts)}
    width = [0] * len(starts)
    spans: list[tuple[int, int, int]] = []
    lines_of: dict[int, list[str]] = {}
    for row in rows:
        for c in row:
            lines_of[id(c)] = c.text.split("\n")
            size = max(map(len, lines_of[id(c)]))
            first, last = number[c.at], bisect_right(starts, c.at + c.columns - 1)
            if last - first == 1:
                width[first] = max(width[first], min(size, MOST_WIDTH))
            else:
                spans.append((first, last, size))
    before = [0]
    for w in width:
        before.append(before[-1] + w + 3)
    for first, last, size in spans:  # only those that have no room in their columns as they are
        if size > before[last] - before[first] - 3:
            width[last - 1] = max(width[last - 1], min(width[last - 1] + size - (before[last] - before[first] - 3), MOST_WIDTH))
    before = [0]
    for w in width:
        before.append(before[-1] + w + 3)
    content = sum(len(c.text) + 3 for row in rows for c in row)
    cost = sum(max((len(lines_of[id(c)]) for c in row), default=0) * (before[number[row[-1].at]] + 3) for row in rows)
    lines = []
    for row in rows:
        cells = [lines_of[id(c)] for c in row]
        high = max(map(len, cells), default=0)
        if cost > 8 * content + 10_000:
            lines += [" | ".join(c[0] for c in cells)] if high == 1 else [x for c in cells for x in c]
            continue
        for i in range(high):
            line, at = [], 0  # at: the next column
            for c, own in zip(row, cells, strict=True):
                first = number[c.at]
                line += [" " * width[k] for k in range(at, first)]
                at = max(bisect_right(starts, c.at + c.columns - 1), first + 1)
                line.append((own[i] if i < len(own) else "").ljust(before[at] - before[first] - 3))
            lines.append(" | ".join(line).rstrip())
    return lines


def render(root: Node) -> str:
    """All visible text: blocks on lines of their own, paragraphs and the like apart, lists marked and indented, tables aligned.

    Elements, attributes and inline styles decide what is visible (``display``, ``visibility`` with those that reset it,
    ``hidden``; closed dialogs and details, options not chosen); style sheets don't.  What is nested deeper than ``MOST_INDENT`` or ``MOST_TABLES``
    is there, too, but not indented or aligned further, so that a page takes time and space in proportion to its length.
    """
    flows = [Flow()]
    lists: list[list] = []  # [ordered, number]
    tables: list[list[list[Cell]]] = []
    seen = [True]
    pre = drawings = shown_text = inner = 0  # open elements of some kinds; inner: tables that are blocks
    work: list = [root]
    while work:
        item = work.pop()
        flow = flows[-1]
        if isinstance(item, str):
            if seen[-1] and (not drawings or shown_text):
                text = unescape(item) if "&" in item else item
                flow.verbatim(text) if pre else flow.inline(text)
            continue
        if isinstance(item, Node):
            tag = item.tag
            here, visibility = item.shown()
            if not here:
                continue
            if tag == "br":
                flow.end_line() if flow.line else flow.lines.append("") if flow.lines else None
                continue
            if tag == "input":
                attrs = item.attributes()
                if seen[-1] and attrs.get("type", "").lower() in ("submit", "reset", "button"):
                    flow.inline(attrs.get("value", ""))
                continue
            if tag == "wbr" or tag in VOID - {"hr"}:
                continue
            cell = None
            if tag == "table" and len(tables) >= MOST_TABLES:
                inner += 1
            if tag in ("td", "th") and tables and not inner:
                cell = Cell.of(item)
                flows.append(Flow())
            elif tag == "table" and not inner:
                flow.block(True)
                tables.append([])
            elif tag == "tr" and tables and not inner:
                tables[-1].append([])
            elif tag in BLOCK and tag != "option":
                flow.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            elif tag == "option":
                flow.block(False)
            if tag in ("ul", "ol"):
                start = item.attributes().get("start", "") if item.attrs else ""
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                flow.indents.append(flow.indents[-1])
                flow.bullet = mark
            elif tag in ("blockquote", "dd"):
                flow.indents.append(flow.indents[-1])
                flow.indent(2)
            elif tag == "pre":
                pre += 1
            elif tag == "q" and seen[-1]:
                flow.inline('"')
            elif tag == "svg":
                drawings += 1
            elif tag == "text":
                shown_text += 1
            if tag == "hr":
                if seen[-1]:
                    flow.inline("---")
                flow.block(True)
                continue
            seen.append(visibility == "visible" if visibility in ("visible", "hidden", "collapse") else seen[-1])
            work.append((tag, cell))
            work.extend(reversed(item.in_view()))
            continue
        tag, cell = item
        seen.pop()
        if cell:
            cell.text = flows.pop().text()
            if not tables[-1]:
                tables[-1].append([])
            tables[-1][-1].append(cell)
            continue
        if tag == "table" and inner:
            inner -= 1
        elif tag == "table":
            rows = tables.pop()
            flow.block(True)
            flow.verbatim("\n".join(aligned(rows)))
            flow.block(True)
            continue
        if tag == "li":
            flow.end_line()
            flow.bullet = ""
            flow.indents.pop()
        elif tag in ("ul", "ol"):
            lists.pop()
        elif tag in ("blockquote", "dd"):
            flow.end_line()
            flow.indents.pop()
        elif tag == "pre":
            pre -= 1
        elif tag == "q" and seen[-1]:
            flow.inline('"')
        elif tag == "svg":
            drawings -= 1
        elif tag == "text":
            shown_text -= 1
            flow.inline(" ") if drawings else None
        if tag in BLOCK and tag != "tr":
            flow.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
    return flows[0].text()


def page_text(html: str | None) -> str | None:
    return None if html is None else render(parse(html))


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns and the ``text`` of each whole ``html``; null stays null, a page without visible text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in pieces(batch.column("__html")):
                part = batch.slice(i, j - i)
                texts = pa.array([page_text(x) for x in part.column("__html").to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), texts], [*keep, "text"])

    given = pages.select(*keep, F.col("html").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[:-1])
    return given.mapInArrow(run, f"{schema}, text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all ``pages``."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
