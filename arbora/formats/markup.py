"""HTML and XML.

HTML goes through a reduced tree builder on ``html.parser`` tokens: html, head and body are made up, void elements close, an open
p, li, dt, dd, option, row or cell closes where the next begins, rows get a tbody. Formatting elements are not reopened after they
were closed out of order, and misplaced table content stays where it was found: there paths can differ from a full HTML5 parser's.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser
from xml.parsers import expat

from arbora.model import Limits

from .tree import Artifact, Budget, Node, Source, cell_name, document

# Fixed values of HTML: elements by how they nest.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, "thead": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, "tfoot": {"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}}
SCOPE = {"li": {"ul", "ol", "menu", "table"}, "dt": {"dl", "table"}, "dd": {"dl", "table"}, "option": {"select", "datalist"}, "optgroup": {"select"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"}}
UNSEEN = frozenset(("script", "style", "noscript", "template"))
FENCE = frozenset("table td th caption button object applet marquee template html".split())


class Element:
    __slots__ = ("attributes", "children", "counts", "number", "parent", "tag", "text")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None, parent: Element | None = None, text: str | None = None) -> None:
        self.tag, self.attributes, self.parent, self.text = tag, attributes or {}, parent, text
        self.children: list[Element] = []
        #: Its number among the siblings of its tag, and how many children of each tag it has.
        self.number = 1
        self.counts: dict[str, int] = {}

    def add(self, child: Element) -> None:
        child.number = self.counts[child.tag] = self.counts.get(child.tag, 0) + 1
        self.children.append(child)

    def find(self, tag: str) -> Element | None:
        stack = [self]
        while stack:
            e = stack.pop()
            if e.tag == tag:
                return e
            stack.extend(reversed(e.children))
        return None

    def place(self) -> str:
        """Tags from the root, each with its number among the siblings of that tag."""
        parts, e = [], self
        while e.parent is not None:
            parts.append(f"{e.tag}[{e.number}]")
            e = e.parent
        return "/" + "/".join(reversed(parts))

    def words(self, unseen: frozenset[str] = UNSEEN) -> str:
        """Texts joined by blanks, white space squeezed."""
        out, stack = [], [self]
        while stack:
            e = stack.pop()
            if e.text is not None:
                out.append(e.text)
            elif e.tag not in unseen:
                stack.extend(reversed(e.children))
        return " ".join(" ".join(out).split())


class _Builder(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style", "noscript", "xmp", "iframe", "noembed", "noframes")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.top = Element("")
        self.html = Element("html", parent=self.top)
        self.top.add(self.html)
        self.head = Element("head", parent=self.html)
        self.body: Element | None = None
        self.html.add(self.head)
        self.open: list[Element] = [self.html, self.head]
        self.after_head = False

    def _into_body(self, attributes: dict[str, str] | None = None) -> None:
        if self.body is None:
            self.body = Element("body", attributes, self.html)
            self.html.add(self.body)
            self.open = [self.html, self.body]

    def _in_head(self) -> bool:
        return self.body is None

    def _pop_to(self, index: int) -> None:
        del self.open[index:]

    def _close(self, tags: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        """Close the outermost open element of ``tags`` that no element of ``stop`` shuts in."""
        found = None
        for i in range(len(self.open) - 1, 1, -1):
            tag = self.open[i].tag
            if tag in tags:
                found = i
            elif tag in stop:
                break
        if found is not None:
            self._pop_to(found)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given: dict[str, str] = {}
        for k, v in attrs:
            given.setdefault(k, v or "")
        if tag == "html":
            self.html.attributes = given | self.html.attributes
            return
        if tag == "head":
            return
        if tag == "body":
            if self.body is None:
                self._into_body(given)
            return
        if self._in_head():
            if tag in HEAD and not self.after_head or tag in HEAD - {"noscript"}:
                e = Element(tag, given, self.head)
                self.head.add(e)
                if tag not in VOID:
                    self.open = [self.html, self.head, e]
                return
            self._into_body()
        if tag == "image":
            tag = "img"
        if tag in CLOSES_P:
            self._close({"p"}, FENCE)
        if tag[0] == "h" and tag[1:] in "123456" and len(tag) == 2 and re.fullmatch("h[1-6]", self.open[-1].tag):
            self.open.pop()
        if tag in ("a", "button", "nobr"):
            self._close({tag}, FENCE)
        if tag in CLOSED_BY:
            self._close(CLOSED_BY[tag], SCOPE[tag])
            if tag in ("li", "dd", "dt"):
                self._close({"p"}, FENCE | {"li", "dd", "dt"})
        here = self.open[-1]
        if tag in ("tr", "td", "th") and here.tag == "table":
            here = self._push("tbody", {})
        if tag in ("td", "th") and here.tag in ("tbody", "thead", "tfoot"):
            here = self._push("tr", {})
        self._push(tag, given)

    def _push(self, tag: str, attributes: dict[str, str]) -> Element:
        e = Element(tag, attributes, self.open[-1])
        self.open[-1].add(e)
        if tag not in VOID:
            self.open.append(e)
        return e

    def handle_endtag(self, tag: str) -> None:
        if tag == "head":
            self.after_head = True
            return
        if tag in ("body", "html"):
            self._into_body()
            return
        if self._in_head():
            if len(self.open) > 2 and self.open[-1].tag == tag:
                self.open.pop()
            if tag != "br":
                return
            self._into_body()
        if tag == "br":
            self._push("br", {})
            return
        if re.fullmatch("h[1-6]", tag):
            for i in range(len(self.open) - 1, 1, -1):
                if re.fullmatch("h[1-6]", self.open[i].tag):
                    self._pop_to(i)
                    break
                if self.open[i].tag in FENCE:
                    break
            return
        for i in range(len(self.open) - 1, 1, -1):
            if self.open[i].tag == tag:
                self._pop_to(i)
                return
            if self.open[i].tag in FENCE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th"):
                break
        if tag == "p":
            self._push("p", {})
            self.open.pop()

    def handle_data(self, data: str) -> None:
        if self._in_head() and len(self.open) == 2:
            if not data.strip(" \t\n\f\r"):
                return
            self._into_body()
        self.open[-1].add(Element("", parent=self.open[-1], text=data))


def dom(data: bytes | str) -> Element:
    """The document's root; it always has html, head and body."""
    b = _Builder()
    text = data if isinstance(data, str) else data.decode("utf-8", "replace")
    b.feed(text.removeprefix("﻿"))
    b.close()
    b._into_body()
    return b.top


#: Elements that become paragraphs, and what they are called.
PARAGRAPHS = {"p": "p", "blockquote": "blockquote", "pre": "pre", "figcaption": "figcaption", "li": "list-item"}


def _nodes(body: Element, budget: Budget) -> list[Node]:
    out: list[Node] = []
    stack = list(reversed(body.children))
    while stack:
        e = stack.pop()
        tag = e.tag
        if e.text is not None or tag in UNSEEN:
            continue
        node, inside = None, True
        if re.fullmatch("h[1-6]", tag):
            node = Node("section", e.words(), level=int(tag[1]), locator={"path": e.place()})
        elif tag in PARAGRAPHS and (text := e.words()):
            node, inside = Node("paragraph", text=text, locator={"path": e.place()}, attributes={"element": PARAGRAPHS[tag]}), False
        elif tag == "table":
            node, inside = _table(e, budget), False
        elif tag == "img":
            kept = {k: v for k in ("src", "alt", "width", "height") if (v := e.attributes.get(k))}
            node = Node("image", e.attributes.get("alt", ""), locator={"path": e.place()}, attributes=kept or None)
        elif tag == "a" and (href := e.attributes.get("href")):
            node, inside = Node("link", e.words(), locator={"path": e.place()}, attributes={"href": href}), False
        if node:
            budget.node()
            out.append(node)
        if inside:
            stack.extend(reversed(e.children))
    return out


def _table(element: Element, budget: Budget) -> Node:
    table = Node("table", locator={"path": element.place()})
    stack = list(reversed(element.children))
    while stack:
        e = stack.pop()
        if e.tag != "tr":
            stack.extend(reversed(e.children))
            continue
        number = len(table.children) + 1
        row = Node("row", str(number), locator={"path": e.place()})
        for cell in e.children:
            if cell.tag in ("td", "th"):
                name = cell_name(len(row.children) + 1, number)
                row.children.append(Node("cell", name, cell.words(), locator={"path": cell.place(), "cell": name}, attributes={"role": "header"} if cell.tag == "th" else None))
        if row.children:
            table.children.append(row)
            budget.node(1 + len(row.children))
    return table


def read_html(source: Source, limits: Limits) -> Artifact:
    top = dom(source.data)
    root = document(source)
    root.children = _nodes(top.find("body") or top, Budget(limits))
    title = top.find("title")
    words = title.words() if title else ""
    return Artifact(source, "html", "text/html", root, {"title": words} if words else {})


def _local(name: str) -> str:
    head, colon, tail = name.partition(":")
    return tail if head and colon and tail else name


def read_xml(source: Source, limits: Limits) -> Artifact:
    root = document(source)
    budget = Budget(limits)
    stack: list[tuple[Node, str, dict[str, int]]] = [(root, "", {})]
    p = expat.ParserCreate()
    p.buffer_text = True

    def start(name: str, attributes: dict[str, str]) -> None:
        budget.depth(len(stack))
        node, path, seen = stack[-1]
        name = _local(name)
        seen[name] = seen.get(name, 0) + 1
        path = f"{path}/{name}[{seen[name]}]"
        child = Node("element", name, locator={"path": path}, attributes={_local(k): v for k, v in attributes.items()} or None)
        node.children.append(child)
        stack.append((child, path, {}))
        budget.node()

    def chunk(data: str) -> None:
        node = stack[-1][0]
        if len(stack) > 1 and (data := data.strip()):
            node.text = f"{node.text} {data}" if node.text else data

    def declared(version: str, encoding: str | None, standalone: int) -> None:
        if encoding and encoding.lower() != "utf-8":
            raise ValueError(f"parse XML: encoding {encoding} is not supported")

    def other(data: str) -> None:
        if data.startswith("&"):
            raise ValueError(f"parse XML: entity {data} is not defined")

    p.StartElementHandler = start
    p.EndElementHandler = lambda name: stack.pop()
    p.CharacterDataHandler = chunk
    p.XmlDeclHandler = declared
    p.DefaultHandler = other  # entities aren't expanded
    # these end a chunk of text
    p.CommentHandler = p.ProcessingInstructionHandler = lambda *_: None
    p.StartCdataSectionHandler = p.EndCdataSectionHandler = lambda: None
    try:
        p.Parse(source.data, True)
    except expat.ExpatError as e:
        raise ValueError(f"parse XML: {e}") from None
    if len(stack) != 1 or not root.children:
        raise ValueError("parse XML: incomplete document")
    return Artifact(source, "xml", "application/xml", root)
