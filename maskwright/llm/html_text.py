"""HTML extraction: a tree builder with implied tags, and a renderer of all that is visible.

The text keeps the layout: blocks stand on lines of their own, with an empty line where a browser
leaves a margin; list items are marked or numbered and indented; cells of a table stand under each
other. Nothing is judged to be boilerplate. Building and rendering take no recursion. Time and memory
go with the page and, in a table, with the columns and the cells that reach down into a row.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.common import extended, in_arrow, texts

#: Element names by how HTML treats them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes object audio video canvas".split())
#: Parts of drawings and formulas that are never shown where they stand.
FOREIGN_UNSEEN = {
    "svg": frozenset("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter script style".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
#: Elements of drawings and formulas whose content is HTML again.
INTEGRATION = {"svg": frozenset("foreignobject desc title".split()), "math": frozenset("mi mo mn ms mtext".split())}
#: HTML start tags that end a drawing or formula.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Their elements that stand apart from what is beside them.
APART = frozenset("text mfrac mtr mtd".split())
#: Blocks with an empty line around, and without.
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl menu pre table figure fieldset xmp".split())
PLAIN = frozenset("html body div section article aside header footer nav main address center form dir li dt dd details summary figcaption legend hgroup search dialog hr caption thead tbody tfoot tr td th option optgroup".split())
CLOSE_P = frozenset("address article aside blockquote center details dialog dir div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul xmp search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
IN_HEAD = frozenset("base link meta title style script template noscript".split())
#: A start tag of the first kind ends an open element of the second, unless one of the third is in between.
ENDS = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"tr", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
}
#: Elements through which no end tag and no implied end reaches.
BARRIER = frozenset("td th caption table template button".split())
#: Characters of a table's column, but for the last cell of a row; longer lines are broken there.
WIDEST = 60
#: Levels of lists and quotations that are set further in, as a page has a width.
LEVELS = 40
#: The most columns and rows that a cell takes, and inputs whose value isn't shown as text.
ACROSS, DOWN = 1000, 65_534
UNSHOWN = frozenset("hidden password checkbox radio file image range color".split())
BUTTONS = frozenset("submit button reset".split())

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>")
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
DISPLAY = re.compile(r"(?:^|[;\s])display\s*:\s*([a-z-]+)", re.I)
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)", re.I)
UNQUOTED = re.compile(r"=\s*[^\s\"'][^\s]*/$")
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    """An element; its children are nodes and strings. ``foreign``: svg or math, of which it is a part."""

    __slots__ = ("attributes", "children", "foreign", "tag")

    def __init__(self, tag: str, attributes: dict[str, str], foreign: str = "") -> None:
        self.tag, self.attributes, self.children, self.foreign = tag, attributes, [], foreign

    def inside(self) -> str:
        """svg or math, if its children are parts of that."""
        kind = self.foreign
        if kind and (self.tag in INTEGRATION[kind] or self.tag == "annotation-xml" and "html" in self.attributes.get("encoding", "").lower()):
            return ""
        return kind


def attributes_of(raw: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of a name counting."""
    out: dict[str, str] = {}
    if raw and not raw.isspace():
        for name, a, b, c in ATTRIBUTE.findall(raw):
            out.setdefault(name.lower(), unescape(a or b or c))
    return out


def events(html: str, inside: Callable[[], str] = str):
    """Text, ("", name, attributes, closed) of start tags and ("/", name, {}, False) of end tags, in order.

    ``closed``: a start tag with a closing slash. ``inside`` says of what kind the element open then is: in
    drawings and formulas no element is raw text, and there are CDATA sections.
    """
    at, end = 0, len(html)
    while at < end:
        open_ = html.find("<", at)
        if open_ < 0:
            yield html[at:]
            return
        if open_ > at:
            yield html[at:open_]
        if html.startswith("<!--", open_):
            close = html.find("-->", open_ + 4)
            at = end if close < 0 else close + 3
        elif html.startswith("<![CDATA[", open_) and inside():
            close = html.find("]]>", open_ + 9)
            yield html[open_ + 9 : end if close < 0 else close].replace("&", "&amp;")
            at = end if close < 0 else close + 3
        elif html.startswith(("<!", "<?"), open_):
            close = html.find(">", open_)
            at = end if close < 0 else close + 1
        elif m := TAG.match(html, open_):
            slash, name, rest = m.groups()
            name = name.lower()
            at = m.end()
            raw = not slash and name in RAW and not inside()
            yield slash, name, {} if slash else attributes_of(rest), not slash and closing(rest)
            if raw:
                close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(html, at)
                stop = close.start() if close else end
                yield html[at:stop]
                after = html.find(">", stop)
                at = end if after < 0 else after + 1
                yield "/", name, {}, False
        elif html.startswith("</", open_) or open_ + 1 < end and html[open_ + 1].isascii() and html[open_ + 1].isalpha():
            close = html.find(">", open_)  # a broken tag
            at = end if close < 0 else close + 1
        else:
            yield "<"
            at = open_ + 1


def closing(rest: str) -> bool:
    """Whether a tag ends with a slash that isn't the end of an unquoted value."""
    return rest.endswith("/") and not UNQUOTED.search(rest)


class Builder:
    """Open elements from the root down."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        #: where the open elements of each tag stand
        self.places: dict[str, list[int]] = {}
        self.body: Node | None = None

    def push(self, tag: str, attributes: dict[str, str], foreign: str = "", closed: bool = False) -> None:
        node = Node(tag, attributes, foreign)
        self.open[-1].children.append(node)
        if not closed if foreign else tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def cut(self, at: int) -> None:
        """Ends the open elements from a place on."""
        for node in self.open[at:]:
            self.places[node.tag].pop()
        del self.open[at:]

    def last(self, tags: set[str] | frozenset[str]) -> int:
        """Where the innermost open element of some tags stands, or 0."""
        return max((own[-1] for tag in tags if (own := self.places.get(tag))), default=0)

    def inside(self) -> str:
        return self.open[-1].inside()

    def close(self, tags: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> bool:
        """Ends the innermost open element of those tags and all within, if no barrier is met first."""
        at = self.last(tags)
        if not at or at < self.last(barrier):
            return False
        self.cut(at)
        return True

    def into_body(self) -> None:
        """The body begins with the first content, said or not."""
        if self.body is None:
            self.close({"head"}, set())
            self.push("body", {})
            self.body = self.open[-1]

    def start(self, tag: str, attributes: dict[str, str], closed: bool = False) -> None:
        if kind := self.inside():
            if tag not in BREAKOUT and not (tag == "font" and attributes.keys() & {"color", "face", "size"}):
                self.push(tag, attributes, tag if tag in ("svg", "math") and self.open[-1].tag == "annotation-xml" else kind, closed)
                return
            while self.inside():
                self.cut(len(self.open) - 1)
        if tag in ("svg", "math"):
            if self.body is None:
                self.into_body()
            self.push(tag, attributes, tag, closed)
            return
        if tag == "html":
            return
        if tag == "head":
            if self.body is None and len(self.open) == 1:
                self.push("head", {})
            return
        if tag == "body":
            if self.body is None:
                self.into_body()
                self.body.attributes.update(attributes)
            return
        if self.body is None:
            if tag in IN_HEAD:
                if len(self.open) == 1:
                    self.push("head", {})
                self.push(tag, attributes)
                return
            self.into_body()
        if tag in CLOSE_P:
            self.close({"p"}, BARRIER)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.cut(len(self.open) - 1)
        if tag in ENDS:
            ends, until = ENDS[tag]
            if tag in ("tr", "thead", "tbody", "tfoot"):
                self.close({"td", "th"}, {"table"})
                if tag != "tr":
                    self.close({"tr"}, {"table"})
            self.close(ends, until)
            if tag in ("td", "th") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
                self.push("tr", {})
        self.push(tag, attributes)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag == "head":
            self.close({"head"}, set())
        elif tag == "p":
            if not self.close({"p"}, BARRIER):
                self.start("p", {})
                self.end("p")
        elif tag in HEADINGS:
            self.close(HEADINGS, BARRIER)
        elif tag in ("td", "th"):
            self.close({tag}, {"table"})
        elif tag in ("tr", "thead", "tbody", "tfoot", "caption"):
            self.close({tag}, {"table"})
        elif tag == "table":
            self.close({"table"}, set())
        elif tag not in ("html", "body"):
            self.close({tag}, BARRIER - {tag})

    def text(self, raw: str) -> None:
        if self.body is None and self.open[-1].tag not in IN_HEAD:
            if raw.isspace():
                return
            self.into_body()
        own = self.open[-1]
        own.children.append(raw if own.tag in ("script", "style") and not own.foreign else unescape(raw))


def tree(html: str) -> Node:
    """The element tree of a page or a piece of one."""
    builder = Builder()
    for event in events(html.replace("\r\n", "\n").replace("\r", "\n"), builder.inside):
        if isinstance(event, str):
            builder.text(event)
        elif event[0]:
            builder.end(event[1])
        else:
            builder.start(*event[1:])
    return builder.root


def hidden(node: Node, parent: Node | None) -> bool:
    """Whether an element and all in it are not laid out at all."""
    a = node.attributes
    if node.tag in UNSEEN or "hidden" in a or node.tag == "dialog" and "open" not in a:
        return True
    if node.foreign and (node.tag in FOREIGN_UNSEEN[node.foreign] or a.get("display") == "none"):
        return True
    if "style" in a and (said := DISPLAY.findall(a["style"])) and said[-1].lower() == "none":
        return True
    return parent is not None and parent.tag == "details" and "open" not in parent.attributes and node.tag != "summary"


def visible(node: Node, inherited: bool) -> bool:
    """Whether an element's own text is drawn; what is in it may say otherwise again."""
    said = VISIBILITY.findall(node.attributes.get("style", ""))
    own = said[-1].lower() if said else node.attributes.get("visibility", "") if node.foreign else ""
    return own == "visible" if own in ("hidden", "collapse", "visible") else inherited


class Flow:
    """Lines under construction. A gap waits until something follows it."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space, self.gap, self.mark = False, 0, ""

    def put(self, text: str, indent: str) -> None:
        if not self.line:
            if self.lines and self.gap > 1 and self.lines[-1]:
                self.lines.append("")
            self.gap = 0
            self.line.append(self.mark or indent)
            self.mark = ""
        elif self.space:
            self.line.append(" ")
        self.space = False
        self.line.append(text)

    def words(self, text: str, indent: str) -> None:
        """Text with its white space run together."""
        plain = SPACES.sub(" ", text)
        if plain.strip(" "):
            if plain[0] == " ":
                self.space = bool(self.line)
            self.put(plain.strip(" "), indent)
            self.space = plain[-1] == " "
        elif plain and self.line:
            self.space = True

    def verbatim(self, text: str, indent: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                self.newline(indent)
            if line:
                self.put(line, indent)

    def newline(self, indent: str = "") -> None:
        """A line break, which may leave an empty line."""
        if self.line or self.gap < 2:
            if not self.line:
                self.lines.append("")
            self.finish()

    def finish(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).replace("\xa0", " ").rstrip())
            self.line = []
        self.space = False

    def block(self, margin: bool) -> None:
        self.finish()
        if self.lines:
            self.gap = max(self.gap, 2 if margin else 1)


def wrapped(line: str) -> list[str]:
    """A line in pieces of at most ``WIDEST`` characters, broken at spaces; a longer word stays whole."""
    out = []
    while len(line) > WIDEST:
        cut = line.rfind(" ", 1, WIDEST + 1)
        if cut < 0:
            cut = line.find(" ", WIDEST)
        if cut < 0:
            break
        out.append(line[:cut])
        line = line[cut + 1 :]
    return [*out, line]


class Table:
    """Rows of cells (first column, lines). Columns that cells of rows above still take are passed over."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[int, list[str]]]] = []
        #: first column, end and last row of what reaches down into the row at hand, by column; and what the row adds
        self.above: list[tuple[int, int, int]] = []
        self.own: list[tuple[int, int, int]] = []
        self.next, self.at = 0, 0

    def row(self) -> None:
        """Begins a row."""
        n = len(self.rows)
        left = [x for x in self.above if x[2] >= n] if self.above else []
        for x in self.own:
            if left and left[-1][1] == x[0] and left[-1][2] == x[2]:
                left[-1] = (left[-1][0], x[1], x[2])
            else:
                left.append(x)
        if self.own:
            left.sort()
        self.above, self.own = left, []
        self.rows.append([])
        self.next = self.at = 0

    def group(self) -> None:
        """Ends a group of rows, which no cell reaches beyond."""
        self.above, self.own = [], []

    def add(self, lines: list[str], across: int, down: int) -> None:
        column = self.next
        while self.at < len(self.above) and self.above[self.at][0] <= column:
            column = max(column, self.above[self.at][1])
            self.at += 1
        self.rows[-1].append((column, lines))
        self.next = column + across
        if down > 1:
            self.own.append((column, column + across, len(self.rows) - 2 + down))

    def render(self) -> list[str]:
        """Lines in which every column's cells begin under each other.

        Only the columns in which cells begin take room. Before the last cell of a row, lines longer than
        ``WIDEST`` are broken, so the lines of a table are as long as its columns are many, not its texts.
        """
        laid = [[(c, [y for x in lines for y in wrapped(x)] if i + 1 < len(row) else lines) for i, (c, lines) in enumerate(row)] for row in self.rows]
        width: dict[int, int] = {}
        for row in laid:
            for i, (column, lines) in enumerate(row):
                wide = max((len(x) for x in lines if len(x) <= WIDEST), default=0) if i + 1 < len(row) else 0
                width[column] = max(width.get(column, 0), wide)
        start, at = {}, 0
        for column in sorted(width):
            start[column] = at
            at += width[column] + 2
        out = []
        for row in laid:
            for k in range(max((len(lines) for _, lines in row), default=0)):
                line, size = [], 0
                for column, lines in row:
                    if k < len(lines) and lines[k]:
                        gap = max(start[column] - size, 2 if size else 0)
                        line.append(" " * gap + lines[k])
                        size += gap + len(lines[k])
                out.append("".join(line).rstrip())
        return out


def number(text: str | None, default: int) -> int:
    """A whole number of an attribute, if it fits in 32 bits."""
    m = re.match(r"\s*([+-]?\d{1,10})(?!\d)", text or "")
    return int(m[1]) if m and abs(int(m[1])) < 1 << 31 else default


def span(text: str | None, most: int, none: int) -> int:
    """Columns or rows that a cell takes, by HTML's limits; ``none`` for a zero."""
    m = re.match(r"\s*\+?(\d+)", text or "")
    digits = m[1].lstrip("0") if m else "1"
    return (most if len(digits) > 6 else min(int(digits), most)) if digits else none


def render(root: Node) -> str:
    """The visible text of a tree, laid out."""
    flows, tables, lists = [Flow()], [], []
    indents, pre = [""], 0
    todo: list = [(root, None, False, True)]
    while todo:
        node, parent, leaving, shown = todo.pop()
        flow = flows[-1]
        if isinstance(node, str):
            if not shown or parent.tag == "details" and "open" not in parent.attributes:
                continue
            (flow.verbatim if pre else flow.words)(node, indents[-1])
            continue
        tag = node.tag
        if node.foreign:
            if leaving or not hidden(node, parent):
                if tag in APART or parent is not None and parent.tag == "mfrac":
                    flow.space = bool(flow.line)
                if tag == "foreignobject":
                    flow.block(False)
                if not leaving:
                    shown = visible(node, shown)
                    todo.append((node, parent, True, shown))
                    todo.extend((c, node, False, shown) for c in reversed(node.children))
            continue
        if not leaving:
            if hidden(node, parent):
                continue
            shown = visible(node, shown)
            if tag == "br":
                flow.newline()
                continue
            if tag in ("hr", "input"):
                if tag == "hr":
                    flow.block(False)
                elif shown and (kind := node.attributes.get("type", "").lower()) not in UNSHOWN:
                    said = node.attributes.get("value") or (node.attributes.get("placeholder", "") if kind not in BUTTONS else "")
                    flow.space = flow.space or bool(flow.line)  # a box of its own
                    flow.words(said, indents[-1])
                    flow.space = bool(flow.line)
                continue
            if tag in MARGIN or tag in PLAIN:
                flow.block(tag in MARGIN and not (tag in LISTS and lists))
            if tag in LISTS:
                lists.append([tag, number(node.attributes.get("start"), 1)])
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1]
                if kind[0] == "ol":
                    kind[1] = number(node.attributes.get("value"), kind[1])
                    flow.mark = f"{indents[-1]}{kind[1]}. "
                    kind[1] += 1
                else:
                    flow.mark = f"{indents[-1]}- "
                indents.append(indents[-1] + " " * 2 if len(indents) < LEVELS else indents[-1])
            elif tag in ("dd", "blockquote"):
                indents.append(indents[-1] + " " * 2 if len(indents) < LEVELS else indents[-1])
            elif tag in ("pre", "textarea", "xmp"):
                pre += 1
            elif tag == "table":
                tables.append(Table())
                indents.append("")
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("thead", "tbody", "tfoot") and tables:
                tables[-1].group()
            elif tag in ("td", "th") and tables:
                flows.append(Flow())
            todo.append((node, parent, True, shown))
            todo.extend((c, node, False, shown) for c in reversed(node.children))
            continue
        if tag in LISTS:
            lists.pop()
        elif tag == "li":
            indents.pop()
            flow.mark = ""
        elif tag in ("dd", "blockquote"):
            indents.pop()
        elif tag in ("pre", "textarea", "xmp"):
            pre -= 1
        elif tag in ("td", "th") and tables:
            flow.finish()
            flows.pop()
            if not tables[-1].rows:
                tables[-1].row()
            tables[-1].add([x for x in flow.lines if x], span(node.attributes.get("colspan"), ACROSS, 1), span(node.attributes.get("rowspan"), DOWN, DOWN))
            continue
        elif tag == "table":
            indents.pop()
            flow.finish()
            rows = tables.pop().render()
            if rows and flow.lines and flow.gap > 1 and flow.lines[-1]:
                flow.lines.append("")
            if rows:
                flow.gap = 0
            flow.lines += [indents[-1] + x for x in rows]
        if tag in MARGIN or tag in PLAIN:
            flow.block(tag in MARGIN and not (tag in LISTS and lists))
    flows[0].finish()
    return "\n".join(flows[0].lines).strip("\n")


def extract(html: str) -> str:
    """The visible text of a page."""
    return render(tree(html))


def extracted(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html`` in ``into``, in its place.

    Null and empty pages give an empty text; broken markup is read as far as it goes. The other
    columns pass through, rows stay one by one, and there is no shuffle.
    """
    kept = [c for c in pages.columns if c not in (html, into)]
    rows = pages.select(*kept, F.col(html).cast("string").alias(html))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = pa.array([extract(x) for x in texts(batch.column(html))], pa.string())
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=[*kept, into])

    return in_arrow(rows, work, extended(pages.select(*kept).schema, **{into: T.StringType()}), rows=128)
