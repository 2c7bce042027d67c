"""HTML extraction by layout-aware rendering.

A tree builder reads tags, comments and raw-text elements, supplies implied tags (open paragraphs,
list items, table rows and cells end where HTML says so) and ignores stray end tags. A renderer walks
the visible elements and lays text out: blocks stand apart, list items carry marks, preformatted text
keeps its spaces, and table cells are padded to the width of their columns.

Lines of more than WIDE characters do not widen a column; they run over it. The padding of a page's
tables is at most PADDING times its source: a table that would need more than is left is laid out
with two spaces between its cells, without columns.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from reelquarry.llm.common import prepare, slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes datalist audio video canvas object map annotation annotation-xml".split())
#: Blocks with an empty line around them, and other blocks.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset hr".split())
BLOCK = SPACED | frozenset("address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav optgroup option search section summary tbody td tfoot th thead tr caption".split())
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends these open elements, looked for up to the nearest of the scope.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset("ul ol menu dir".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "option": (frozenset({"option"}), frozenset({"select", "optgroup", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "td", "th"}), frozenset({"table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
}
IMPLIED["thead"] = IMPLIED["tfoot"] = IMPLIED["tbody"]
SCOPE = frozenset("table td th caption html template".split())
#: Characters up to which a line widens its column, and padding of all tables of a page by source characters.
WIDE, PADDING = 100, 8
#: Columns up to which cells span columns and rows; spans that reach further end there.
SPANNED = 256
#: Deeper elements become children of the last one at this depth, as browsers do.
MAX_DEPTH = 256
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    children: list = field(default_factory=list)


def _attributes(raw: str) -> dict:
    found: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        found.setdefault(name.lower(), html.unescape(value.strip("\"'") if value[:1] in "\"'" else value))
    return found


def build(source: str) -> tuple[Node, list[str]]:
    """The tree of a page and the text of its style elements."""
    root, styles = Node("#root"), []
    stack = [root]
    at = 0

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(html.unescape(piece))

    def close(tags: frozenset, scope: frozenset) -> None:
        """Ends the outermost open element of `tags` inside the nearest of `scope`."""
        cut = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in scope:
                break
            if stack[i].tag in tags:
                cut = i
        if cut is not None:
            del stack[cut:]

    def opened(tag: str, attrs: dict) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        # one more for hidden elements, whose content must not come out
        if tag not in VOID and len(stack) < MAX_DEPTH + (tag in HIDDEN):
            stack.append(node)
        return node

    while (m := _TOKEN.search(source, at)) is not None:
        text(source[at : m.start()])
        at = max(m.end(), m.start() + 1)
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not any(n.tag == "p" for n in stack):
                stack[-1].children.append(Node("p"))
            else:
                scope = SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else frozenset({"table"} - {tag})
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag or (tag in HEADINGS and stack[i].tag in HEADINGS):
                        del stack[i:]
                        break
                    if stack[i].tag in scope:
                        break
            continue
        if tag in ENDS_PARAGRAPH:
            close(frozenset({"p"}), SCOPE)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in IMPLIED:
            close(*IMPLIED[tag])
            if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                opened("tr", {})
        if tag == "body" or tag in BLOCK and tag != "html":
            close(frozenset({"head"}), frozenset({"#none"}))
        node = opened(tag, _attributes(m[3]))
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            raw = source[at : end.start() if end else len(source)]
            if tag == "style":
                styles.append(raw)
            node.children.append(html.unescape(raw) if tag in ("textarea", "title") else raw)
            if stack[-1] is node:
                stack.pop()
            at = end.end() if end else len(source)
    text(source[at:])
    return root, styles


def _style(text: str) -> dict:
    pairs = (d.split(":", 1) for d in text.lower().split(";") if ":" in d)
    return {k.strip(): v.replace("!important", "").strip() for k, v in pairs}


_AT_RULE = re.compile(r"@([\w-]+)([^{};]*)([{;])")


def _on_screen(css: str) -> str:
    """Style text without comments and without at-rules that don't apply to a screen; @media for screens keeps its rules."""
    css, out, at = re.sub(r"/\*.*?\*/", "", css, flags=re.S), [], 0
    while (m := _AT_RULE.search(css, at)) is not None:
        out.append(css[at : m.start()])
        at = m.end()
        if m[3] == "{":
            depth = 1
            while depth and (b := re.compile("[{}]").search(css, at)):
                depth += 1 if b[0] == "{" else -1
                at = b.end()
            if depth:
                at = len(css)
            medium = m[2].lower()
            if m[1].lower() in ("media", "supports", "layer") and ("print" not in medium or "not print" in medium or "screen" in medium):
                out.append(_on_screen(css[m.end() : at - 1 if not depth else at]))
    return "".join(out) + css[at:]


class Sheet:
    """Display and visibility of simple selectors: tag, .class, #id and a tag with one of them."""

    def __init__(self, styles: list[str]):
        self.rules: list[tuple[str, str, str, dict]] = []
        for css in styles:
            for selectors, body in _RULE.findall(_on_screen(css)):
                wanted = {k: v for k, v in _style(body).items() if k in ("display", "visibility")}
                for s in selectors.split(",") if wanted else ():
                    m = re.fullmatch(r"\s*([a-zA-Z][\w-]*|\*)?(?:\.([\w-]+))?(?:#([\w-]+))?\s*", s)
                    if m and any(m.groups()):
                        self.rules.append(((m[1] or "*").lower(), m[2] or "", m[3] or "", wanted))

    def of(self, node: Node) -> dict:
        found: dict = {}
        classes = node.attrs.get("class", "").split()
        for tag, cls, ident, wanted in self.rules:
            if tag in ("*", node.tag) and (not cls or cls in classes) and (not ident or ident == node.attrs.get("id")):
                found |= wanted
        if "hidden" in node.attrs:
            found.setdefault("display", "none")
        return found | (_style(node.attrs["style"]) if "style" in node.attrs else {})


class Canvas:
    """Lines of text; collapses white space and empty lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0

    @property
    def line(self) -> str:
        if len(self.parts) > 1:
            self.parts = ["".join(self.parts)]
        return self.parts[0] if self.parts else ""

    @line.setter
    def line(self, text: str) -> None:
        self.parts = [text] if text else []

    def write(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if not self.parts or self.parts[-1].endswith(" "):
            text = text.lstrip(" ")
        if text:
            if not self.parts and self.gap and self.lines:
                self.lines += [""] * (self.gap - 1)
            if not self.parts:
                self.gap = 0
            self.parts.append(text)

    def end(self, gap: int = 1) -> None:
        if self.line.strip(" "):
            self.lines.append(self.line.rstrip(" "))
        self.line = ""
        self.gap = max(self.gap, gap)

    def feed(self) -> None:
        """A line break; it shows even on an empty line."""
        if self.line.strip(" "):
            self.end()
        else:
            self.line = ""
            self.gap = min(self.gap + 1, 2)

    def place(self, lines: list[str], first: str = "", rest: str = "") -> None:
        """Adds finished lines with a prefix."""
        self.end()
        if not lines and not first:
            return
        if self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 1
        for i, x in enumerate(lines or [""]):
            self.lines.append(((first if i == 0 else rest) + x).rstrip(" "))

    def done(self) -> list[str]:
        self.end()
        return self.lines


class Renderer:
    def __init__(self, styles: list[str]):
        self.sheet = Sheet(styles)
        self.padding = 0

    def render(self, node: Node, canvas: Canvas, pre: bool = False, shown: bool = True) -> None:
        for child in node.children:
            if isinstance(child, str):
                if shown:
                    self._text(child, canvas, pre)
                continue
            style = self.sheet.of(child)
            if child.tag in HIDDEN or style.get("display") == "none" or (child.tag == "dialog" and "open" not in child.attrs):
                continue
            visible = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), shown)
            if child.tag == "svg":
                # of a drawing only its text elements are text
                for part in _below(child):
                    if part.tag == "text":
                        self.render(Node("#part", {}, ["\n", *part.children, "\n"]), canvas, False, visible)
                continue
            self._element(child, canvas, pre, visible, style.get("display", ""))

    @staticmethod
    def _text(text: str, canvas: Canvas, pre: bool) -> None:
        if not pre:
            canvas.write(text)
            return
        for i, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if i:
                canvas.lines.append(canvas.line.rstrip(" "))
                canvas.line = ""
            if line and not canvas.line and canvas.gap and canvas.lines:
                canvas.lines += [""] * (canvas.gap - 1)
            canvas.gap = 0
            canvas.line += line.expandtabs(8)

    def _inner(self, node: Node, pre: bool, shown: bool) -> list[str]:
        canvas = Canvas()
        self.render(node, canvas, pre, shown)
        return canvas.done()

    def _element(self, node: Node, canvas: Canvas, pre: bool, shown: bool, display: str) -> None:
        tag = node.tag
        if tag == "br":
            canvas.feed()
        elif tag == "input":
            if shown and node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
                canvas.write(f" {node.attrs.get('value', '')} ")
        elif tag == "select":
            options = [n for n in _below(node) if n.tag == "option"]
            picked = [n for n in options if "selected" in n.attrs] or options[:1]
            for n in picked:
                canvas.write(" ")
                self.render(n, canvas, pre, shown)
                canvas.write(" ")
        elif tag == "details" and "open" not in node.attrs:
            canvas.end()
            self.render(Node("details", {}, [n for n in node.children if isinstance(n, Node) and n.tag == "summary"][:1]), canvas, pre, shown)
            canvas.end()
        elif tag in ("ul", "ol", "menu", "dir"):
            canvas.end(2)
            self._list(node, canvas, pre, shown)
            canvas.end(2)
        elif tag == "table":
            canvas.end(2)
            self._table(node, canvas, pre, shown)
            canvas.end(2)
        elif tag in ("dd", "blockquote"):
            canvas.end(2 if tag == "blockquote" else 1)
            canvas.place(self._inner(node, pre, shown), "  ", "  ")
            canvas.end(2 if tag == "blockquote" else 1)
        elif tag == "pre":
            canvas.end(2)
            lines = self._inner(node, True, shown)
            canvas.place(lines[1:] if lines[:1] == [""] else lines)
            canvas.end(2)
        else:
            block = (tag in BLOCK and display != "inline") or display in ("block", "flex", "grid", "list-item", "table")
            if block:
                canvas.end(2 if tag in SPACED else 1)
            elif tag in ("td", "th"):
                canvas.write(" ")
            self.render(node, canvas, pre or tag in ("textarea", "xmp"), shown)
            if block:
                canvas.end(2 if tag in SPACED else 1)

    def _list(self, node: Node, canvas: Canvas, pre: bool, shown: bool) -> None:
        start = node.attrs.get("start", "1")
        number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, Node) and child.tag == "li":
                style = self.sheet.of(child)
                if style.get("display") == "none":
                    continue
                mark = f"{number}. " if node.tag == "ol" else "- "
                number += 1
                visible = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), shown)
                lines = self._inner(child, pre, visible)
                if lines:
                    # indentation comes from the same allowance as the padding of tables
                    self.padding -= len(mark) * len(lines)
                    canvas.place(lines, mark, " " * len(mark) if self.padding >= 0 else "")
            else:
                self.render(Node("#part", {}, [child]), canvas, pre, shown)

    def _table(self, node: Node, canvas: Canvas, pre: bool, shown: bool) -> None:
        rows: list[list[tuple[list[str], int]]] = []
        down: dict[int, int] = {}

        def walk(part: Node, visible: bool) -> None:
            for child in part.children:
                if isinstance(child, str):
                    if child.strip() and visible:
                        canvas.write(child)
                        canvas.end()
                    continue
                style = self.sheet.of(child)
                if child.tag in HIDDEN or style.get("display") == "none":
                    continue
                seen = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), visible)
                if child.tag in ("tbody", "thead", "tfoot"):
                    walk(child, seen)
                elif child.tag == "tr":
                    row(child, seen)
                elif child.tag not in ("col", "colgroup"):
                    self.render(Node("#part", {}, [child]), canvas, pre, visible)
                    canvas.end()

        def row(tr: Node, visible: bool) -> None:
            cells: list[tuple[list[str], int]] = []
            at = 0

            def skip() -> None:
                nonlocal at
                begin = at
                while down.get(at, 0):
                    down[at] -= 1
                    at += 1
                if at > begin:
                    cells.append(([], at - begin))

            for cell in tr.children:
                if isinstance(cell, str) and not cell.strip():
                    continue
                part = cell if isinstance(cell, Node) else Node("td", {}, [cell])
                style = self.sheet.of(part)
                if part.tag in HIDDEN or style.get("display") == "none":
                    continue
                skip()
                seen = {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), visible)
                span, tall = (int(v) if re.fullmatch(r"[1-9]\d{0,2}", v := part.attrs.get(k, "1")) else 1 for k in ("colspan", "rowspan"))
                span = max(1, min(span, SPANNED - at))
                cells.append((self._inner(part, pre, seen), span))
                for c in range(at, at + span):
                    if tall > 1 and c < SPANNED:
                        down[c] = tall - 1
                at += span
            skip()
            if cells:
                rows.append(cells)

        walk(node, shown)
        canvas.place(self._aligned(rows) or ["  ".join(lines[i] for lines, _ in cells if i < len(lines)).rstrip(" ") for cells in rows for i in range(max((len(lines) for lines, _ in cells), default=0))])

    def _aligned(self, rows: list[list[tuple[list[str], int]]]) -> list[str] | None:
        """Lines with the cells of a column under each other; None if that takes more padding than is left."""

        def widest(lines: list[str]) -> int:
            return max((n for n in map(len, lines) if n <= WIDE), default=0)

        width: dict[int, int] = {}
        for cells in rows:
            at = 0
            for lines, span in cells:
                if span == 1 and lines:
                    width[at] = max(width.get(at, 0), widest(lines))
                at += span
        for cells in rows:
            at = 0
            for lines, span in cells:
                if lines:
                    short = widest(lines) - sum(width.get(c, 0) for c in range(at, at + span)) - 2 * (span - 1)
                    if short > 0:
                        width[at + span - 1] = width.get(at + span - 1, 0) + short
                at += span
        out: list[str] = []
        left = self.padding
        if left < 0:
            return None
        for cells in rows:
            last = max((k for k, (lines, _) in enumerate(cells) if lines), default=-1)
            rooms, at = [], 0
            for _, span in cells[:last]:
                rooms.append(sum(width.get(c, 0) for c in range(at, at + span)) + 2 * (span - 1))
                at += span
            for i in range(max((len(lines) for lines, _ in cells), default=0)):
                line = [lines[i] if i < len(lines) else "" for lines, _ in cells[: last + 1]]
                left -= sum(max(room - len(x), 0) + 2 for room, x in zip(rooms, line, strict=False))
                if left < 0:
                    return None
                out.append("  ".join([*(x.ljust(room) for x, room in zip(line, rooms, strict=False)), *line[last:]]).rstrip(" "))
        self.padding = left
        return out


def _below(node: Node) -> Iterator[Node]:
    for child in node.children:
        if isinstance(child, Node):
            yield child
            yield from _below(child)


def render(source: str | None) -> str:
    """The visible text of a page; null or empty source gives an empty text."""
    if not source:
        return ""
    root, styles = build(source.replace("\0", ""))
    canvas = Canvas()
    renderer = Renderer(styles)
    renderer.padding = PADDING * len(source)
    renderer.render(root, canvas)
    return "\n".join(canvas.done()).strip("\n")


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """(page_id, url, html) -> page_id, url, text, n_chars, n_lines; each row on its own, without a shuffle."""
    prepare(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            texts = [render(h) for h in batch.column(2).to_pylist()]
            columns = [batch.column(0).cast(pa.int64()), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_lines"])

    return pages.select("page_id", "url", column).mapInArrow(run, "page_id long, url string, text string, n_chars long, n_lines long")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
