"""Which reader parses what. Built-in probes are column expressions; own parsers bring a probe in Python."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from arbora.formats import containers, delimited, mail, markup, office, pdf, pictures, plain, structured
from arbora.formats.tree import Artifact, Source
from arbora.functions.detect import FORMATS, ORDER
from arbora.model import Limits

Reader = Callable[[Source, Limits], Artifact]
READERS: dict[str, Reader] = {
    "config": structured.read_config,
    "json": structured.read_json,
    "delimited": delimited.read,
    "html": markup.read_html,
    "xml": markup.read_xml,
    "email": mail.read,
    "image": pictures.read,
    "ooxml": office.read,
    "pdf": pdf.read,
    "archive": containers.read,
    "text": plain.read,
}


class Parser(Protocol):
    """What an own parser must offer; objects must be picklable."""

    name: str
    formats: list[tuple[str, str, list[str]]]

    def probe(self, source: Source) -> tuple[int, str]: ...

    def parse(self, source: Source, limits: Limits) -> Artifact: ...


class Registry:
    """Parsers in registration order, which decides ties; names are unique and not blank."""

    def __init__(self, builtin: bool = True) -> None:
        self.names: list[str] = list(ORDER) if builtin else []
        self.own: dict[str, Parser] = {}

    def register(self, parser: Parser) -> None:
        if not parser.name.strip():
            raise ValueError("a parser needs a name")
        if parser.name in self.names:
            raise ValueError(f'parser "{parser.name}" is already registered')
        self.names.append(parser.name)
        self.own[parser.name] = parser

    def formats(self) -> list[tuple[str, str, list[str]]]:
        """All formats by name, the first of each name."""
        out: dict[str, tuple[str, str, list[str]]] = {}
        for f in [*(FORMATS if set(self.names) & set(ORDER) else []), *(f for p in self.own.values() for f in p.formats)]:
            out.setdefault(f[0], f)
        return [out[k] for k in sorted(out)]

    def ranked(self, source: Source, native: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
        """(score, parser, reason), best first: what the expression found, the Office main part, and own probes."""
        found = {p: (s, r) for s, p, r in native if p in self.names}
        if "ooxml" in self.names and (part := office.main_part(source.data)):
            found["ooxml"] = 100, {"word": "WordprocessingML package", "ppt": "PresentationML package", "xl": "SpreadsheetML package"}[part]
        for name, parser in self.own.items():
            score, reason = parser.probe(source)
            if score > 0:
                found[name] = min(100, score), reason
        return sorted(((s, p, r) for p, (s, r) in found.items()), key=lambda x: (-x[0], self.names.index(x[1])))

    def parse(self, name: str, source: Source, limits: Limits) -> Artifact:
        return self.own[name].parse(source, limits) if name in self.own else READERS[name](source, limits)
