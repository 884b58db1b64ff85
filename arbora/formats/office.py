"""DOCX, PPTX and XLSX packages: ZIP parts read as XML events by one small builder for prose and one for sheets."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from xml.parsers import expat

from arbora.functions.text import PART_MEDIA
from arbora.model import LimitError, Limits

from .containers import Zip, is_link
from .tree import Artifact, Budget, Node, Source, cell_name, document

TYPES = {"docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document", "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}
#: Core properties and their metadata keys.
CORE = {"title": "title", "subject": "subject", "creator": "creator", "description": "description", "keywords": "keywords", "lastModifiedBy": "last_modified_by", "revision": "revision", "created": "created", "modified": "modified"}
MAIN = {"word": "word/document.xml", "ppt": "ppt/presentation.xml", "xl": "xl/workbook.xml"}


class Attributes(dict):
    """Attributes by local name; ``ref`` is the relationship id, in whatever prefix it came."""

    def __init__(self, pairs: list[str]) -> None:
        super().__init__()
        self.ref = ""
        for key, value in zip(pairs[::2], pairs[1::2], strict=True):
            space, _, local = key.rpartition(" ")
            self.setdefault(local, value)
            if local == "id" and "relationships" in space and not self.ref:
                self.ref = value
        self.ref = self.ref or self.get("id", "")


def events(data: bytes, start: Callable[[str, Attributes], None], text: Callable[[str], None] = lambda _: None, end: Callable[[str], None] = lambda _: None) -> None:
    p = expat.ParserCreate(namespace_separator=" ")
    p.buffer_text = p.ordered_attributes = True
    p.StartElementHandler = lambda name, pairs: start(name.rpartition(" ")[2], Attributes(pairs))
    p.CharacterDataHandler = text
    p.EndElementHandler = lambda name: end(name.rpartition(" ")[2])
    p.DefaultHandler = lambda _: None  # entities aren't expanded
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        raise ValueError(str(e)) from None


@dataclass
class Link:
    type: str
    target: str
    external: bool


class Package:
    def __init__(self, source: Source, limits: Limits) -> None:
        self.source, self.limits = source, limits
        self.zip = Zip(source.data, limits)

    def has(self, part: str) -> bool:
        return part in self.zip.entries

    def links(self, part: str) -> dict[str, Link]:
        """A part's relationships by id, internal targets resolved."""
        folder, base = posixpath.split(part)
        rels = posixpath.join(folder, "_rels", f"{base}.rels")
        out: dict[str, Link] = {}
        if not self.has(rels):
            return out

        def start(name: str, a: Attributes) -> None:
            if name == "Relationship" and a.get("Id") and a.get("Target"):
                external = a.get("TargetMode", "").lower() == "external"
                target = a["Target"]
                if not external:
                    target = posixpath.normpath(target).lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
                out[a["Id"]] = Link(a.get("Type", ""), target, external)

        events(self.zip.read(rels), start)
        return out

    def core(self) -> dict[str, str]:
        out: dict[str, str] = {}
        if not self.has("docProps/core.xml"):
            return out
        now = [""]

        def start(name: str, _: Attributes) -> None:
            now[0] = CORE.get(name, "")

        def text(data: str) -> None:
            if now[0] and (data := data.strip()):
                out[now[0]] = out.get(now[0], "") + data

        def end(name: str) -> None:
            if name in CORE:
                now[0] = ""

        try:
            events(self.zip.read("docProps/core.xml"), start, text, end)
        except ValueError:
            pass
        return out

    def resources(self, out: Artifact, *prefixes: str) -> None:
        for name, info in self.zip.entries.items():
            if name.lower().endswith("vbaproject.bin"):
                out.warn("macro_ignored", "Office macro project was not executed or exposed", path=name)
            elif not name.startswith(prefixes) or info.orig_filename.endswith("/"):
                continue
            elif info.flag_bits & 1:
                out.warn("encrypted_part_skipped", "encrypted Office package part was not exposed", path=name)
            elif is_link(info):
                out.warn("package_link_skipped", "linked Office package part was not exposed", path=name)
            else:
                out.resource("part", name, posixpath.basename(name), PART_MEDIA.get(posixpath.splitext(name)[1].lower(), ""), info.file_size)
        out.resources.sort(key=lambda r: r["locator"]["path"])


def heading_level(style: str) -> int:
    found = re.fullmatch(r"(heading|title)(\+?[0-9]+)?", style.replace(" ", "").lower())
    if not found or found[1] == "heading" and not found[2]:
        return 0
    level = int(found[2] or 1)
    return level if 1 <= level <= 9 else 0


@dataclass
class _Paragraph:
    number: int
    text: list[str] = field(default_factory=list)
    style: str = ""
    links: list[str] = field(default_factory=list)


class Prose:
    """Paragraphs and tables of a Word or drawing part. A table in a cell becomes the cell's child."""

    def __init__(self, package: Package, part: str, slide: int = 0) -> None:
        self.base = {"path": part} | ({"slide": slide} if slide else {})
        self.top = "/slide" if slide else "/document"
        self.word = not slide
        self.links = package.links(part)
        self.budget = Budget(package.limits)
        self.nodes: list[Node] = []
        self.tables: list[list[Node | None]] = []  # table, open row, open cell
        self.paragraph: _Paragraph | None = None
        self.typing = False
        self.paragraphs = self.seen_tables = 0
        events(package.zip.read(part), self.start, self.text, self.end)

    def start(self, name: str, a: Attributes) -> None:
        p = self.paragraph
        if name == "p":
            self.paragraphs += 1
            self.paragraph = _Paragraph(self.paragraphs)
        elif name == "t":
            self.typing = True
        elif name == "tbl":
            self.seen_tables += 1
            self.tables.append([Node("table", f"Table {self.seen_tables}", locator=self.base | {"subpath": f"{self.top}/table[{self.seen_tables}]"}), None, None])
            self.budget.node()
        elif name == "tr" and self.tables:
            table = self.tables[-1][0]
            number = len(table.children) + 1
            self.tables[-1][1] = Node("row", str(number), locator=self.base | {"subpath": f"{table.locator['subpath']}/row[{number}]"})
            self.budget.node()
        elif name == "tc" and self.tables and self.tables[-1][1]:
            row = self.tables[-1][1]
            column = len(row.children) + 1
            cell = cell_name(column, int(row.name))
            self.tables[-1][2] = Node("cell", cell, locator=self.base | {"subpath": f"{row.locator['subpath']}/cell[{column}]", "cell": cell})
            self.budget.node()
        elif p is None:
            return
        elif name == "br" or name == "cr" and self.word:
            p.text.append("\n")
        elif name == "tab" and self.word:
            p.text.append("\t")
        elif name == "pStyle" and self.word:
            p.style = a.get("val", "")
        elif name == ("hyperlink" if self.word else "hlinkClick") and a.ref in self.links:
            p.links.append(self.links[a.ref].target)

    def text(self, data: str) -> None:
        if self.typing and self.paragraph:
            self.paragraph.text.append(data)

    def end(self, name: str) -> None:
        if name == "t":
            self.typing = False
        elif name == "p" and self.paragraph:
            self.finish(self.paragraph)
            self.paragraph = None
        elif name == "tbl" and self.tables:
            table = self.tables.pop()[0]
            holder = self.tables[-1][2] if self.tables else None
            (holder.children if holder else self.nodes).append(table)
        elif name in ("tr", "tc") and self.tables:
            table, row, cell = self.tables[-1]
            if name == "tc" and row and cell:
                row.children.append(cell)
                self.tables[-1][2] = None
            elif name == "tr" and row:
                table.children.append(row)
                self.tables[-1][1] = None

    def finish(self, p: _Paragraph) -> None:
        text = "".join(p.text).strip()
        if not text:
            return
        if self.tables and (cell := self.tables[-1][2]):
            cell.text = f"{cell.text}\n{text}" if cell.text else text
            return
        marks = ({"style": p.style} if p.style else {}) | ({"links": " ".join(p.links)} if p.links else {})
        where = self.base | {"subpath": f"{self.top}/paragraph[{p.number}]"}
        level = heading_level(p.style)
        self.nodes.append(Node("section", text, level=level, locator=where, attributes=marks or None) if level else Node("paragraph", text=text, locator=where, attributes=marks or None))
        self.budget.node()


#: What auxiliary Word parts are called.
LABELS = {"header": "Header", "footer": "Footer", "footnotes": "Footnotes", "endnotes": "Endnotes", "comments": "Comments"}


def _label(part: str) -> str | None:
    """The section of an auxiliary part, None for any other."""
    base = posixpath.basename(part).removesuffix(".xml")
    if not part.startswith("word/") or not part.endswith(".xml"):
        return None
    return next((LABELS[k] for k in ("header", "footer") if base.startswith(k)), None) or (LABELS.get(base) if base not in ("header", "footer") else None)


def _docx(package: Package) -> Artifact:
    root = document(package.source)
    root.children = Prose(package, MAIN["word"]).nodes
    extra = sorted(x for x in package.zip.entries if _label(x))
    for part in extra:
        if nodes := Prose(package, part).nodes:
            root.children.append(Node("section", _label(part), level=2, locator={"path": part}, children=nodes))
    return Artifact(package.source, "docx", TYPES["docx"], root, {"parts": str(1 + len(extra))})


def part_number(part: str) -> int:
    found = re.fullmatch(r"[^0-9]*([0-9]+)", posixpath.splitext(posixpath.basename(part))[0])
    return int(found[1]) if found else 0


def _slides(package: Package) -> list[str]:
    links, out = package.links(MAIN["ppt"]), []

    def start(name: str, a: Attributes) -> None:
        link = links.get(a.ref)
        if name == "sldId" and link and not link.external and package.has(link.target):
            out.append(link.target)

    events(package.zip.read(MAIN["ppt"]), start)
    return out or sorted((x for x in package.zip.entries if x.startswith("ppt/slides/slide") and x.endswith(".xml")), key=part_number)


def _pptx(package: Package) -> Artifact:
    root = document(package.source)
    parts = _slides(package)
    for number, part in enumerate(parts, 1):
        nodes = Prose(package, part, number).nodes
        title = next((n.text for n in nodes if n.kind == "paragraph" and n.text.strip()), f"Slide {number}")
        slide = Node("slide", title, locator={"path": part, "slide": number}, children=nodes)
        for _, link in sorted(package.links(part).items()):
            if not link.external and link.type.endswith("/notesSlide") and package.has(link.target):
                if notes := Prose(package, link.target, number).nodes:
                    slide.children.append(Node("section", "Speaker notes", level=2, locator={"path": link.target, "slide": number}, children=notes))
        root.children.append(slide)
    return Artifact(package.source, "pptx", TYPES["pptx"], root, {"slides": str(len(parts))})


def _shared(package: Package) -> list[str]:
    """The table of strings, runs joined, phonetic readings left out."""
    out: list[str] = []
    if not package.has("xl/sharedStrings.xml"):
        return out
    budget = Budget(package.limits)
    state = {"item": False, "phonetic": False, "text": False}
    runs: list[str] = []

    def start(name: str, _: Attributes) -> None:
        if name == "si":
            state["item"] = True
            runs.clear()
        elif name == "rPh":
            state["phonetic"] = True
        elif name == "t":
            state["text"] = state["item"] and not state["phonetic"]

    def text(data: str) -> None:
        if state["text"]:
            runs.append(data)

    def end(name: str) -> None:
        if name == "t":
            state["text"] = False
        elif name == "rPh":
            state["phonetic"] = False
        elif name == "si":
            state["item"] = False
            out.append("".join(runs))
            budget.bytes(len(out[-1].encode()))
            budget.node(what="shared strings")

    events(package.zip.read("xl/sharedStrings.xml"), start, text, end)
    return out


class Sheet:
    """A worksheet's rows and cells as they stand; sparse rows aren't padded and formulas aren't evaluated."""

    def __init__(self, package: Package, name: str, part: str, shared: list[str]) -> None:
        self.base = {"path": part, "sheet": name}
        self.shared, self.links = shared, package.links(part)
        self.budget = Budget(package.limits, 2)
        self.table = Node("table", name, locator=self.base | {"subpath": "/worksheet/sheetData"})
        self.row: Node | None = None
        self.cell: dict | None = None
        self.number = 0
        self.into = ""
        self.hyperlinks: dict[str, str] = {}
        self.merged: list[str] = []
        events(package.zip.read(part), self.start, self.text, self.end)
        if self.merged:
            self.table.attributes = {"merged_ranges": " ".join(self.merged)}
        for row in self.table.children:
            for cell in row.children:
                if target := self.hyperlinks.get(cell.name):
                    cell.attributes = (cell.attributes or {}) | {"hyperlink": target}

    def start(self, name: str, a: Attributes) -> None:
        if name == "row":
            given = a.get("r", "")
            self.number = int(given) if re.fullmatch(r"\+?[0-9]+", given) and int(given) > 0 else self.number + 1
            self.row = Node("row", str(self.number), locator=self.base | {"subpath": f"/worksheet/sheetData/row[{self.number}]"})
            self.budget.node()
        elif name == "c" and self.row is not None:
            self.cell = {"ref": a.get("r") or cell_name(len(self.row.children) + 1, self.number), "type": a.get("t", ""), "style": a.get("s", ""), "v": [], "f": [], "t": []}
        elif name in ("v", "f", "t") and self.cell:
            self.into = name
        elif name == "hyperlink":
            if a.ref in self.links:
                self.hyperlinks[a.get("ref", "")] = self.links[a.ref].target
            elif a.get("location"):
                self.hyperlinks[a.get("ref", "")] = f"#{a['location']}"
        elif name == "mergeCell" and a.get("ref"):
            self.merged.append(a["ref"])

    def text(self, data: str) -> None:
        if self.cell and self.into:
            self.cell[self.into].append(data)

    def end(self, name: str) -> None:
        if name == self.into:
            self.into = ""
        elif name == "c":
            if self.cell and self.row:
                self.finish(self.cell)
            self.cell = None
        elif name == "row" and self.row:
            self.table.children.append(self.row)
            self.row = None

    def finish(self, c: dict) -> None:
        value = "".join(c["v"])
        if c["type"] == "s":
            if not value.isdigit() or int(value) >= len(self.shared):
                raise ValueError(f'cell {c["ref"]} has invalid shared string index "{value}"')
            value = self.shared[int(value)]
        elif c["type"] == "inlineStr":
            value = "".join(c["t"])
        elif c["type"] == "b":
            value = {"1": "true", "0": "false"}.get(value, value)
        formula = "".join(c["f"]).strip()
        marks = {k: v for k, v in (("formula", formula), ("type", c["type"]), ("style", c["style"])) if v}
        where = self.base | {"subpath": f"/worksheet/sheetData/row[{self.number}]/cell[{c['ref']}]", "cell": c["ref"]}
        self.row.children.append(Node("cell", c["ref"], value, locator=where, attributes=marks or None))
        self.budget.bytes(len(value.encode()))
        self.budget.node()


def _xlsx(package: Package) -> Artifact:
    links = package.links(MAIN["xl"])
    sheets: list[tuple[str, str]] = []
    system = ["1900"]

    def start(name: str, a: Attributes) -> None:
        if name == "workbookPr":
            system[0] = "1904" if a.get("date1904", "").lower() in ("1", "true") else "1900"
        elif name == "sheet" and (link := links.get(a.ref)) and not link.external and package.has(link.target):
            sheets.append((a.get("name", ""), link.target))

    events(package.zip.read(MAIN["xl"]), start)
    shared = _shared(package)
    root = document(package.source)
    for name, part in sheets:
        try:
            table = Sheet(package, name, part, shared).table
        except LimitError:
            raise
        except ValueError as e:
            raise ValueError(f'parse XLSX sheet "{name}": {e}') from None
        root.children.append(Node("sheet", name, locator={"path": part, "sheet": name}, children=[table]))
    return Artifact(package.source, "xlsx", TYPES["xlsx"], root, {"sheets": str(len(sheets)), "date_system": system[0]})


READERS = {"word": (_docx, "word/"), "ppt": (_pptx, "ppt/"), "xl": (_xlsx, "xl/")}


def main_part(data: bytes) -> str | None:
    """Which main part a ZIP's directory lists; None if none, or if it is no ZIP."""
    import io
    import zipfile

    if data[:2] != b"PK":
        return None
    try:
        names = set(zipfile.ZipFile(io.BytesIO(data)).namelist())
    except Exception:  # noqa: BLE001  a broken directory lists nothing
        return None
    return next((k for k, part in MAIN.items() if part in names), None)


def read(source: Source, limits: Limits) -> Artifact:
    try:
        package = Package(source, limits)
    except LimitError:
        raise
    except ValueError as e:
        raise ValueError(f"open OOXML package: {e}") from None
    for kind, part in MAIN.items():
        if package.has(part):
            build, folder = READERS[kind]
            out = build(package)
            out.metadata = package.core() | out.metadata
            package.resources(out, f"{folder}media/", f"{folder}embeddings/")
            return out
    raise ValueError("OOXML package has no supported main document part")

