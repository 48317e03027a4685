"""HTML extraction by layout-aware rendering.

A tokenizer and tree builder with implied tags (a paragraph ends where a block
begins, list items, definition parts, options, table rows and cells end where
the next begins, cells without a row get one), then a renderer that emits all
visible text: block spacing, bullets and numbers of lists, quotes, preformatted
text as it stands, and table cells in aligned columns. Invisible: what the
document's head, scripts, styles, templates and unrendered elements hold, elements
with ``hidden``, with ``display:none`` or ``visibility:hidden`` in their style,
closed dialogs, and what a closed ``details`` holds besides its summary.

One pass over the pages, a page at a time, without recursion: tables in table
cells wait on a stack, so any depth of them is laid out alike (a line in a cell
is handled once for each table around it).

Defined cases: null or empty pages give empty text; text without any tag is one
block; a page cut anywhere renders what it has; repeated rows render alike;
other columns are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ckptlake.llm import _text

#: Elements by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template title iframe noembed noframes noscript object audio video canvas svg math datalist param source track link meta base".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul caption optgroup xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote hr figure xmp".split())
ENDS_P = BLOCKS - frozenset("body html li dd dt td th tr tbody thead tfoot caption option optgroup legend p".split()) | {"p"}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span label abbr cite q sub sup mark".split())
#: What a start tag closes, and the elements beyond which it doesn't look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "optgroup", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
}
CLOSES["thead"] = CLOSES["tfoot"] = CLOSES["tbody"]
#: What may stand in a colgroup; any other start tag ends it, and text does.
IN_COLGROUP = frozenset("col template".split())

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if source and not source.isspace():
        for name, a, b, c in _ATTRIBUTE.findall(source):
            found.setdefault(name.lower(), html.unescape(a or b or c))
    return found


def parse(page: str) -> Node:
    """The tree of a page. Children are nodes and strings."""
    root = Node("html", {})
    stack, at, end = [root], 0, len(page)

    def close(tags: set[str], fence: set[str]) -> None:
        """Pop through the outermost open element of tags inside the innermost one of fence."""
        cut = None
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in fence:
                break
            if stack[k].tag in tags:
                cut = k
        if cut:
            del stack[cut:]

    while at < end:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            if stack[-1].tag == "colgroup" and not text.isspace():
                stack.pop()
            stack[-1].children.append(html.unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        closing, tag = m.group(1), m.group(2) or m.group(4)
        if closing:
            closing = closing.lower()
            if closing == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p", {}))
            elif closing == "br":
                stack[-1].children.append(Node("br", {}))
            elif closing not in ("html", "body"):
                crossed = False
                for k in range(len(stack) - 1, 0, -1):
                    name = stack[k].tag
                    if name == closing:
                        if closing in FORMATTING and crossed:
                            del stack[k]
                        else:
                            del stack[k:]
                        break
                    if name in ("td", "th", "table", "caption") and closing not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "caption"):
                        break
                    crossed |= name in BLOCKS
            continue
        if not tag:
            continue
        tag, source = tag.lower(), m.group(3) or m.group(5) or ""
        if tag in ("html", "body"):
            if tag == "body":
                close({"head"}, set())
            root.attributes = {**_attributes(source), **root.attributes}
            continue
        if len(stack) > 1 and stack[-1].tag == "head" and tag not in UNSEEN:
            stack.pop()
        if stack[-1].tag == "colgroup" and tag not in IN_COLGROUP:
            stack.pop()
        if tag in ENDS_P:
            close({"p"}, {"table", "td", "th", "caption", "button", "object"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            stack[-1].children.append(row := Node("tr", {}))
            stack.append(row)
        if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit() and len(stack[-1].tag) == 2 and stack[-1].tag[0] == "h" and stack[-1].tag[1].isdigit():
            stack.pop()
        node = Node(tag, _attributes(source))
        stack[-1].children.append(node)
        if tag in RAW:
            stop = _RAW_END[tag].search(page, at)
            inner = page[at : stop.start()] if stop else page[at:]
            node.children.append(html.unescape(inner) if tag in ("textarea", "title") else inner)
            at = stop.end() if stop else end
        elif tag not in VOID and not (source.endswith("/") and tag not in BLOCKS and tag not in FORMATTING):
            stack.append(node)
    return root


def visible(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attributes or node.tag == "dialog" and "open" not in node.attributes:
        return False
    style = node.attributes.get("style")
    return not (style and _NO_DISPLAY.search(style))


class _Page:
    """Lines laid out so far, and the line being filled."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.prefixes: list[tuple[str, str]] = []  # (of the first line, of the others)
        self.fresh: list[bool] = []
        self.gap = 0
        self.blank = True
        self.raw = False  # the line began in preformatted text

    def break_line(self, gap: int = 0) -> None:
        text = "".join(self.now)
        text = text.rstrip(" ") if self.raw else text.strip(" ")
        self.now, self.blank, self.raw = [], True, False
        if text:
            self.put(text)
        self.gap = max(self.gap, gap)

    def put(self, text: str) -> None:
        if self.lines and self.gap:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        head = "".join(first if new else rest for (first, rest), new in zip(self.prefixes, self.fresh, strict=True))
        self.fresh = [False] * len(self.fresh)
        self.lines.append((head + text).rstrip(" "))

    def put_all(self, lines: list[str]) -> None:
        """Lines without blanks at their ends."""
        if self.prefixes:
            for line in lines:
                self.put(line)
        elif lines:
            self.put(lines[0])
            self.lines.extend(lines[1:])

    def text(self, words: str) -> None:
        words = _SPACE.sub(" ", words)
        if self.blank and words[:1] == " ":
            words = words[1:]
        if words:
            self.now.append(words)
            self.blank = words[-1] == " "


def render(root: Node) -> list[str]:
    """The lines of a tree's visible text. A step that needs the lines of a part yields the step that makes them."""
    steps, lines = [_lines(root)], None
    while steps:
        try:
            steps.append(steps[-1].send(lines))
            lines = None
        except StopIteration as done:
            steps.pop()
            lines = done.value
    return lines


def _lines(root: Node):
    page = _Page()
    todo: list[tuple] = [("open", root, False)]
    lists: list[list] = []
    while todo:
        what, node, pre = todo.pop()
        if what == "text":
            if not pre:
                page.text(node)
                continue
            parts = node.expandtabs(8).replace("\r\n", "\n").split("\n")
            for k, part in enumerate(parts):
                if k:
                    line = "".join(page.now)
                    page.now, page.blank, page.raw = [], True, False
                    page.put(line)
                if part:
                    page.raw |= not page.now
                    page.now.append(part)
                    page.blank = False
            continue
        tag = node.tag
        if what == "close":
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
            page.break_line(1 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists) else 0)
            if tag in ("li", "blockquote", "dd"):
                page.prefixes.pop()
                page.fresh.pop()
            continue
        if not visible(node):
            continue
        if tag == "br":
            if page.now:
                page.break_line()
            elif page.lines:
                page.gap = max(page.gap, 1)
            continue
        if tag == "hr":
            page.break_line(1)
            page.put("-" * 20)
            page.gap = 1
            continue
        if tag == "img":
            page.text(node.attributes.get("alt", ""))
            continue
        if tag == "input":
            if node.attributes.get("type", "text").lower() not in ("hidden", "checkbox", "radio", "file", "password", "image"):
                page.text(node.attributes.get("value", ""))
            continue
        if tag == "table":
            page.break_line(1)
            page.put_all((yield _table(node)))
            page.gap = max(page.gap, 1)
            continue
        block = tag in BLOCKS
        if block:
            page.break_line(1 if tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists) else 0)
            if tag in ("ul", "ol", "menu", "dir"):
                start = node.attributes.get("start", "1")
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0]:
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                page.prefixes.append((mark, " " * len(mark)))
                page.fresh.append(True)
            elif tag in ("blockquote", "dd"):
                page.prefixes.append(("> ", "> ") if tag == "blockquote" else ("  ", "  "))
                page.fresh.append(True)
            todo.append(("close", node, pre))
        inner = pre or tag in ("pre", "xmp", "textarea")
        children = node.children
        if tag in ("pre", "textarea") and children and isinstance(children[0], str) and children[0].startswith("\n"):
            children = [children[0][1:], *children[1:]]
        if tag == "details" and "open" not in node.attributes:
            children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
        for child in reversed(children):
            todo.append(("text" if isinstance(child, str) else "open", child, inner))
    page.break_line()
    return page.lines


def _number(value: str | None, most: int) -> int:
    return min(most, max(1, int(value))) if value and re.fullmatch(r"\d{1,6}", value) else 1


def _table(table: Node):
    """Caption, then rows of aligned cells. A column's cells are padded to its widest, up to 60 characters."""
    lines, rows, loose = [], [], []
    todo = table.children[::-1]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            if part.strip():
                loose.append(part)
        elif part.tag == "tr":
            rows.append(part)
        elif part.tag in ("tbody", "thead", "tfoot"):
            if visible(part):
                todo.extend(reversed(part.children))
        elif part.tag != "colgroup":
            loose.append(part)
    if loose:
        outside = Node("div", {})
        outside.children = loose
        lines += yield _lines(outside)
    grid: list[list[list[str] | None]] = []
    held: dict[int, int] = {}  # column -> rows that a cell above still takes
    for row in rows:
        if not visible(row):
            continue
        out: list[list[str] | None] = []

        def skip(out=out):
            while held.get(len(out), 0):
                held[len(out)] -= 1
                out.append(None)

        for cell in row.children:
            if not isinstance(cell, Node):
                if cell.strip():
                    skip()
                    out.append([_SPACE.sub(" ", cell).strip()])
                continue
            if not visible(cell):
                continue
            skip()
            wide, tall = _number(cell.attributes.get("colspan"), 1000), _number(cell.attributes.get("rowspan"), 65534)
            inner = Node("div", {})
            inner.children = cell.children if cell.tag in ("td", "th") else [cell]
            for k in range(wide):
                if tall > 1:
                    held[len(out)] = tall - 1
                out.append((yield _lines(inner)) if not k else None)
        skip()
        grid.append(out)
    widths: dict[int, int] = {}
    for row in grid:
        for k, cell in enumerate(row):
            widths[k] = max(widths.get(k, 0), *(min(60, len(x)) for x in cell or [""]), 0)
    for row in grid:
        if len(widths) == 1:
            lines += [line for x in row[0] or [] if (line := x.rstrip(" "))] if row else []
            continue
        for k in range(max((len(c) for c in row if c), default=0)):
            cells = [(c[k] if c and k < len(c) else "").ljust(widths[i]) for i, c in enumerate(row)]
            if line := "  ".join(cells).rstrip(" "):
                lines.append(line)
    return lines


def page_text(page: str | None) -> str:
    return "\n".join(render(parse(page))) if page else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_lines) of every page."""
    _text.ship(pages.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [page_text(p) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string()), pa.array([t.count("\n") + bool(t) for t in texts], pa.int64())], ["page_id", "text", "n_lines"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).cast("string").alias("html")).mapInArrow(run, "page_id long, text string, n_lines long")
