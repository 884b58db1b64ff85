"""Text and Markdown: paragraphs between blank lines, flat sections at ATX headings, byte ranges of both."""

from __future__ import annotations

import re

from arbora.model import Limits

from .tree import Artifact, Node, Source, decoded, document

_HEADING = re.compile(r"[ \t]*(#{1,6}) (.*)", re.S)


def lines(data: bytes) -> list[tuple[str, int, int]]:
    """Text without a trailing CR, start, and end before the line feed (but after a CR)."""
    out, at = [], 0
    for raw in data.split(b"\n"):
        end = at + len(raw)
        if at < len(data):
            out.append((decoded(raw[:-1] if raw.endswith(b"\r") else raw), at, end))
        at = end + 1
    return out


def _span(start: int, end: int) -> dict:
    return {"byte_range": {"start": start, "end": end}}


def read(source: Source, limits: Limits) -> Artifact:
    marked = source.extension in (".md", ".markdown")
    root = document(source)
    home, open_lines = root, []

    def close() -> None:
        if open_lines:
            text = "\n".join(t for t, _, _ in open_lines)
            home.children.append(Node("paragraph", text=text, locator=_span(open_lines[0][1], open_lines[-1][2])))
            open_lines.clear()

    for line in lines(source.data):
        text, start, end = line
        found = _HEADING.fullmatch(text) if marked else None
        if found:
            close()
            home = Node("section", found[2].rstrip("#").strip(), level=len(found[1]), locator=_span(start, end))
            root.children.append(home)
        elif text.strip():
            open_lines.append(line)
        else:
            close()
    close()
    metadata = {"encoding": "utf-8"}
    title = next((n.name for n in root.children if n.kind == "section" and n.name), None)
    if marked and title:
        metadata["title"] = title
    name = "markdown" if marked else "text"
    return Artifact(source, name, "text/markdown" if marked else "text/plain", root, metadata)
