"""Operator 6: visible text of HTML with its layout: a tree builder with implied tags, then a renderer.

The builder closes what HTML lets authors leave open (head, p, li, dt, dd, tr, td, th, option, table sections), opens table
rows that are missing, ignores end tags without a start, and reads raw-text elements up to their end tag. Hidden
are elements that a browser shows nothing of (head, script, style, template, ...), the ``hidden`` attribute, ``display:none`` and
``visibility:hidden`` styles, hidden inputs and comments. Formulas, labels of drawings and all options of a select are text. The renderer keeps block spacing, preformatted text, nested lists with
bullets or numbers, and tables as aligned columns, spans included. What stands in a table but in no cell comes before it, as in browsers.

Defined results: null or empty html gives empty text; html cut off anywhere is rendered as far as it goes; nesting has no
limit (the walk keeps its own stack); repeated rows give repeated results.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import text_slices

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")

# fixed values of the HTML language
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = set("head title script style template noscript iframe object audio video canvas datalist noembed noframes area meta link base param source track".split())
#: inside svg and math: elements that are not shown
UNSEEN = {"svg": set("title desc defs metadata symbol clippath mask pattern marker filter lineargradient radialgradient".split()), "math": {"annotation", "annotation-xml"}}
BLOCKS = set("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure footer form header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table ul h1 h2 h3 h4 h5 h6".split())
SPACED = set("p blockquote dl figure ol ul menu pre table h1 h2 h3 h4 h5 h6 hr fieldset".split())
#: what may stand in head; anything else ends it
IN_HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())
CLOSES_P = (BLOCKS - {"dd", "dt", "li", "body", "html", "option", "optgroup", "legend"}) | {"dd", "dt", "li"}
SCOPES = set("table td th caption html body button object template".split())
#: start tag -> open elements that it ends
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th", "caption", "colgroup"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: tables in tables that are aligned; deeper ones are rendered as blocks, with all their text
DEEPEST = 60
#: the standard's greatest column span
WIDEST = 1000
SECTIONS = {"thead", "tbody", "tfoot"}
#: table part -> open elements that it goes into
INTO = {"td": {"tr", "table"} | SECTIONS, "th": {"tr", "table"} | SECTIONS, "tr": {"table"} | SECTIONS} | {s: {"table"} for s in SECTIONS}


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def parse(source: str) -> Node:
    root = Node("html")
    stack = [root]
    opened: Counter[str] = Counter()  # tags of the open elements: what isn't open is not searched for

    def push(node: Node) -> None:
        stack.append(node)
        opened[node.tag] += 1

    def cut(at: int) -> None:
        opened.subtract(e.tag for e in stack[at:])
        del stack[at:]

    def close(tags: set[str], scopes: set[str]) -> None:
        """End the open elements down to the outermost of ``tags`` that is inside the nearest of ``scopes``."""
        last = None
        for i in range(len(stack) - 1, 0, -1) if any(opened[t] for t in tags) else ():
            if stack[i].tag in tags:
                last = i
            elif stack[i].tag in scopes:
                break
        if last is not None:
            cut(last)

    def back(tags: set[str]) -> None:
        """End what was left open inside the nearest of ``tags`` of this table."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                cut(i + 1)
            if stack[i].tag in tags or stack[i].tag in ("table", "template"):
                break

    def add_text(s: str) -> None:
        s = html.unescape(s)
        if stack[-1].tag == "head" and s.strip(" \t\n\r\f"):
            cut(len(stack) - 1)
        stack[-1].children.append(s)

    at, n = 0, len(source)
    while at < n:
        found = _TOKEN.search(source, at)
        if not found:
            add_text(source[at:])
            break
        if found.start() > at:
            add_text(source[at : found.start()])
        at = found.end()
        if found[1]:
            tag = found[1].lower()
            if tag == "br":
                if stack[-1].tag == "head":
                    cut(len(stack) - 1)
                stack[-1].children.append(Node("br"))
                continue
            stop = {"table"} if tag in ("td", "th", "tr") or tag in SECTIONS else SCOPES - {tag}
            if not opened[tag] and (tag != "p" or not any(opened[t] for t in stop)):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in stop and tag not in ("body", "html", "table"):
                    if tag == "p":
                        stack[-1].children.append(Node("p"))
                    break
        elif found[2]:
            tag = found[2].lower()
            attributes = {a[1].lower(): html.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(found[3] or "")}
            if tag in ("html", "body"):
                root.attributes |= attributes
                close({"head"}, set())
                continue
            if stack[-1].tag == "head" and tag not in IN_HEAD:
                cut(len(stack) - 1)
            if tag in CLOSES_P:
                close({"p"}, SCOPES)
            if tag in SECTIONS:
                close({"tr", "td", "th", "caption", "colgroup"} | SECTIONS, {"table"})
            elif tag in IMPLIED:
                close(IMPLIED[tag], {"table"} if tag == "tr" else {"ul", "ol", "menu"} | SCOPES if tag == "li" else {"dl"} | SCOPES if tag in ("dt", "dd") else {"tr", "table"} if tag in ("td", "th") else {"select", "datalist"})
            if tag in INTO:
                back(INTO[tag])
            if tag in ("td", "th") and stack[-1].tag in SECTIONS | {"table"}:
                row = Node("tr")
                stack[-1].children.append(row)
                push(row)
            for kind, unseen in UNSEEN.items():
                if tag in unseen and opened[kind]:
                    attributes["hidden"] = ""
            node = Node(tag, attributes)
            stack[-1].children.append(node)
            if tag in RAW:
                end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(source, at)
                text = source[at : end.start()] if end else source[at:]
                at = end.end() if end else n
                node.children.append(html.unescape(text) if tag in ("title", "textarea") else text)
            elif tag == "form" and stack[-1].tag in SECTIONS | {"table", "tr"}:
                pass  # between the parts of a table it holds nothing
            elif tag not in VOID and not (found[3] or "").endswith("/"):
                push(node)
    return root


def hidden(node: Node) -> bool:
    a = node.attributes
    return node.tag in HIDDEN or "hidden" in a or bool(a.get("style") and _HIDING.search(a["style"])) or (node.tag == "dialog" and "open" not in a)


class Page:
    """Lines of output under construction."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False
        self.prefixes: list[str] = [""]
        self.mark: str | None = None
        self.blocks = 0

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(s.split("\n")):
                if i:
                    self.end(force=True)
                if part:
                    self.line.append(part)
            return
        for i, w in enumerate(_BLANK.split(s)):
            if i:
                self.space = True
            if w:
                if self.space and self.line and not self.line[-1].endswith(" "):
                    self.line.append(" ")
                self.line.append(w)
                self.space = False

    def end(self, force: bool = False) -> None:
        """End the line; an empty one is only kept where it was asked for."""
        if self.line or force:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            lead = self.prefixes[-1]
            if self.mark is not None:
                lead, self.mark = self.mark, None
            self.lines.append((lead + "".join(self.line)).rstrip())
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end()
        if spaced:
            self.gap = True


def render(root: Node, depth: int = 0) -> tuple[str, dict[str, int]]:
    page, n = Page(), {"blocks": 0, "lists": 0, "tables": 0}
    stack: list[tuple] = [("open", root, False)]
    counters: list[list] = []
    while stack:
        what, node, pre = stack.pop()
        if what == "text":
            page.text(node, pre)
            continue
        tag = node.tag
        block = tag in BLOCKS or tag == "tr"
        if what == "close":
            if block:
                page.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and len(counters) > 1))
            if tag == "text":
                page.space = True
            if tag in ("ul", "ol", "menu"):
                counters.pop()
            if tag in ("li", "blockquote", "dd"):
                page.prefixes.pop()
                page.mark = None if tag == "li" else page.mark
            continue
        if hidden(node):
            continue
        if tag == "br":
            page.end(force=True)
            continue
        if tag == "input":
            if node.attributes.get("type", "").lower() in ("button", "submit", "reset") and node.attributes.get("value"):
                page.text(node.attributes["value"], False)
            continue
        if tag in ("option", "optgroup") and node.attributes.get("label"):
            node.children = [node.attributes["label"], *(node.children if tag == "optgroup" else [])]
        if tag == "text":  # a label of a drawing
            page.space = True
        if tag == "table" and depth < DEEPEST:
            page.block(True)
            n["tables"] += 1
            for line in table_lines(node, n, depth + 1):
                page.line = [line]
                page.end()
            page.block(True)
            continue
        if block:
            page.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and counters))
            n["blocks"] += 1
        if tag in ("ul", "ol", "menu"):
            n["lists"] += 1
            start = node.attributes.get("start", "")
            counters.append([tag == "ol", int(start) if re.fullmatch(r"-?[0-9]{1,4000}", start) else 1])
        elif tag == "li":
            ordered, value = counters[-1] if counters else (False, 1)
            mark = f"{value}. " if ordered else "- "
            if counters:
                counters[-1][1] += 1
            page.mark = page.prefixes[-1] + mark
            page.prefixes.append(page.prefixes[-1] + " " * len(mark))
        elif tag == "blockquote":
            page.prefixes.append(page.prefixes[-1] + "> ")
        elif tag == "dd":
            page.prefixes.append(page.prefixes[-1] + "    ")
        pre = pre or tag in ("pre", "textarea", "listing", "xmp", "plaintext")
        stack.append(("close", node, pre))
        stack += [("text" if isinstance(c, str) else "open", c, pre) for c in reversed(node.children)]
    page.end()
    return "\n".join(page.lines).strip("\n"), n


def _rows(table: Node) -> list[Node]:
    found = {"thead": [], "": [], "tfoot": []}
    for c in table.children:
        if isinstance(c, Node) and not hidden(c):
            if c.tag == "tr":
                found[""].append(c)
            elif c.tag in SECTIONS:
                found[c.tag if c.tag != "tbody" else ""] += [r for r in c.children if isinstance(r, Node) and r.tag == "tr" and not hidden(r)]
    return found["thead"] + found[""] + found["tfoot"]


def _outside(table: Node) -> Node:
    """What stands in a table, its sections and rows but in no cell. Browsers move it out, also out of hidden rows."""
    out, todo = Node("div"), [table]
    while todo:
        node = todo.pop()
        if isinstance(node, Node) and (node is table or node.tag in SECTIONS | {"tr"}):
            todo += reversed(node.children)
        elif isinstance(node, str) and not node.isspace() or isinstance(node, Node) and node.tag not in ("td", "th", "colgroup", "col"):
            out.children.append(node)
    return out


def table_lines(table: Node, n: dict[str, int], depth: int = 1) -> list[str]:
    """A table as aligned columns; text outside of cells stands before it."""
    out = []
    outside = _outside(table)
    if outside.children:
        text, found = render(outside, depth)
        for k in ("lists", "tables"):
            n[k] += found[k]
        out += text.split("\n") if text else []
    grid: dict[tuple[int, int], list[str]] = {}
    taken: dict[int, int] = {}  # column -> first row that no cell above reaches into
    wide: dict[tuple[int, int], int] = {}
    rows = _rows(table)
    for r, row in enumerate(rows):
        c = 0
        for cell in row.children:
            if not isinstance(cell, Node) or cell.tag not in ("td", "th") or hidden(cell):
                continue
            while taken.get(c, 0) > r:
                c += 1
            spans = [int(v) if (v := cell.attributes.get(k, "1").strip()).isascii() and v.isdigit() and len(v) < 4000 else 1 for k in ("colspan", "rowspan")]
            across, down = max(1, min(spans[0], WIDEST)), spans[1] or len(rows)  # a row span of 0 goes to the table's end
            inner = Node("div")
            inner.children = cell.children
            text, found = render(inner, depth)
            for k in ("lists", "tables"):
                n[k] += found[k]
            grid[r, c], wide[r, c] = text.split("\n"), across
            for j in range(c, c + across):
                taken[j] = max(taken.get(j, 0), min(r + down, len(rows)))
            c += across
    if not grid:
        return out
    columns = 1 + max(c for _, c in grid)  # a span has no columns of its own
    wide = {(r, c): min(n, columns - c) for (r, c), n in wide.items()}
    widths = [0] * columns
    for (r, c), lines in grid.items():
        if wide[r, c] == 1:
            widths[c] = max(widths[c], *map(len, lines))
    for (r, c), lines in grid.items():
        lack = max(map(len, lines)) - sum(widths[c : c + wide[r, c]]) - 3 * (wide[r, c] - 1)
        if wide[r, c] > 1 and lack > 0:
            widths[min(columns, c + wide[r, c]) - 1] += lack
    for r in range(1 + max(r for r, _ in grid)):
        cells = {c: grid[r, c] for c in range(columns) if (r, c) in grid}
        for i in range(max(map(len, cells.values()), default=1)):
            parts, c = [], 0
            while c < columns:
                span = wide.get((r, c), 1)
                width = sum(widths[c : c + span]) + 3 * (min(span, columns - c) - 1)
                line = cells.get(c, [])
                parts.append((line[i] if i < len(line) else "").ljust(width))
                c += span
            out.append(" | ".join(parts).rstrip())
    return out


def extract(source: str | None) -> tuple[str, dict[str, int]]:
    return render(parse(source)) if source else ("", {"blocks": 0, "lists": 0, "tables": 0})


def html_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_lists, n_tables: a row for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "html"):
            found = [extract(h) for h in part.column("html").to_pylist()]
            columns = [part.column("page_id"), part.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([len(t) for t, _ in found], pa.int64())]
            columns += [pa.array([n[k] for _, n in found], pa.int64()) for k in ("blocks", "lists", "tables")]
            yield pa.record_batch(columns, names=["page_id", "url", "text", "n_chars", "n_blocks", "n_lists", "n_tables"])

    return pages.select(pages["page_id"].cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_lists long, n_tables long")
