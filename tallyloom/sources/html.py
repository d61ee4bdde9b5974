"""HTML filings as ordered blocks, with the standard library's parser."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from tallyloom.operators import tables

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("script style noscript svg iframe head title meta link".split())
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_BLOCKISH = frozenset("p div li section article header footer td th span b strong font center".split())
_BREAKS = _HEADINGS | _BLOCKISH - frozenset("span b strong font".split()) | frozenset("tr table tbody thead ul ol dl dt dd blockquote pre form fieldset nav aside main body html".split())
_HEADING = re.compile(r"\s*(?:part\s+[ivx]+\b|item\s+\d+[a-z]?\b|note\s+\d+[a-z]?\b)", re.I)
SECTION_CHARS = 120
HEADING_WORDS = 25
CAPTION_WORDS = 30


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict | None = None, parent: Node | None = None) -> None:
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def walk(self):
        for c in self.children:
            if isinstance(c, Node):
                yield c
                yield from c.walk()

    def text(self) -> str:
        parts: list[str] = []
        stack: list = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                parts.append(x)
            elif x.tag not in _SKIP:
                stack.extend(reversed(x.children))
        return tables.clean(" ".join(parts))

    def nearest(self, tag: str) -> Node | None:
        n = self.parent
        while n is not None and n.tag != tag:
            n = n.parent
        return n


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")

    def handle_starttag(self, tag, attrs):
        n = Node(tag, dict(attrs), self.at)
        self.at.children.append(n)
        if tag not in _VOID:
            self.at = n

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, dict(attrs), self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    t = _Tree()
    t.feed(html)
    t.close()
    return t.root


def problem(html: str) -> str | None:
    """Why a page holds no filing: viewer_stub, near_empty; null if it does."""
    n = len(parse(html).text().split())
    if n < 100 and ("XBRL Viewer" in html or "loadViewer" in html):
        return "viewer_stub"
    return "near_empty" if n < 20 else None


def _cells(row: Node) -> list[str]:
    out: list[str] = []
    for c in row.walk():
        if c.tag in ("td", "th") and c.nearest("tr") is row:
            span = str(c.attrs.get("colspan") or 1)
            text = c.text()
            for _ in range(max(1, min(int(span), 20)) if span.isdigit() else 1):
                if not out or out[-1] != text:  # spans and repeats fold into one cell
                    out.append(text)
    while out and not out[-1]:
        out.pop()
    return out


def _before(table: Node) -> list[str]:
    """Up to three short texts before a table, nearest first, looking up to three levels out."""
    out: list[str] = []
    n = table
    for _ in range(3):
        if n.parent is None:
            break
        at = next(i for i, c in enumerate(n.parent.children) if c is n)
        for c in reversed(n.parent.children[:at]):
            if isinstance(c, Node) and (c.tag in _SKIP or c.tag == "table"):
                continue
            text = tables.clean(c) if isinstance(c, str) else c.text()
            if len(text.split()) > CAPTION_WORDS and isinstance(c, Node):
                return out
            if text:
                out.append(text)
            if len(out) == 3:
                return out
        n = n.parent
    return out


def _table(node: Node, section: str) -> dict | None:
    rows = [r for r in node.walk() if r.tag == "tr" and r.nearest("table") is node]
    grid = [cs for cs in map(_cells, rows) if any(cs)]
    if len(rows) < 2 or len(grid) < 2 or max(map(len, grid)) < 2 or not tables.is_statement(grid):
        return None
    notes: list[str] = []
    while len(grid) > 2 and len(own := [c for c in grid[-1] if c]) == 1 and tables.is_footnote(own[0]):
        notes.insert(0, own[0])
        grid.pop()
    own_caption = next((c.text() for c in node.walk() if c.tag == "caption"), "")
    if own_caption:
        caption, units = own_caption, tables.units_in(own_caption)
    else:
        near = _before(node)
        units = next((u for t in near if (u := tables.units_in(t))), "")
        caption = next((t for t in near if not tables.units_in(t)), near[0] if near else "")
    t = tables.table_block(grid, caption, units, section)
    return t and t | {"footnotes": notes}


def blocks(html: str) -> list[dict]:
    """Text and table blocks in reading order; sections carry on from their headings."""
    root = parse(html)
    body = next((n for n in root.walk() if n.tag == "body"), root)
    out: list[dict] = []
    state = {"section": "", "held": []}

    def flush() -> None:
        text = tables.clean(" ".join(state["held"]))
        state["held"] = []
        if text:
            out.append({"kind": "text", "text": text, "page": None, "section": state["section"]})

    def start(heading: str) -> None:
        flush()
        if heading:
            state["section"] = heading[:SECTION_CHARS]
            state["held"].append(heading)

    def heading_of(n: Node) -> str:
        text = n.text()
        return text if len(text.split()) <= HEADING_WORDS else ""

    def visit(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                state["held"].append(c)
            elif c.tag in _SKIP:
                continue
            elif c.tag == "table":
                flush()
                t = _table(c, state["section"])
                if t:
                    out.append(t)
                else:
                    visit(c)
                flush()
            elif c.tag in _HEADINGS:
                start(heading_of(c))
            elif c.tag in _BLOCKISH and sum(1 for _, _ in zip(c.walk(), range(20))) < 20 and (h := heading_of(c)) and _HEADING.match(h):
                start(h)
            else:
                if c.tag in _BREAKS or c.tag == "br":
                    state["held"].append(" ")
                visit(c)

    visit(body)
    flush()
    return out


def flat_text(html: str) -> str:
    return "\n\n".join(b["text"] if b["kind"] == "text" else tables.grid_text([b["headers"], *b["rows"]]) for b in blocks(html))
