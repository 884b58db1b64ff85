"""What a reader builds: nodes, resources and warnings of one artifact, under the limits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

from arbora.model import LimitError, Limits


@dataclass
class Source:
    name: str
    data: bytes
    path: str = ""
    media_type: str = ""

    @property
    def extension(self) -> str:
        """The lower-cased last ``.ext`` of the base name."""
        base = self.name.replace("\\", "/").rsplit("/", 1)[-1]
        return f".{base.rsplit('.', 1)[1].lower()}" if "." in base else ""


@dataclass
class Node:
    kind: str
    name: str = ""
    text: str = ""
    level: int = 0
    locator: dict | None = None
    attributes: dict[str, str] | None = None
    children: list[Node] = field(default_factory=list)

    def walk(self, path: tuple[int, ...] = (), parent: str | None = None) -> Iterator[tuple[tuple[int, ...], str | None, Node]]:
        """Each node with its path and its parent's kind, in document order; no recursion, so depth is no worry."""
        stack = [(path, parent, self)]
        while stack:
            at, above, node = stack.pop()
            yield at, above, node
            stack.extend((at + (i,), node.kind, c) for i, c in reversed(list(enumerate(node.children))))


@dataclass
class Artifact:
    source: Source
    format: str
    media_type: str
    root: Node
    metadata: dict[str, str] = field(default_factory=dict)
    resources: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)

    @property
    def digest(self) -> str:
        return hashlib.sha256(self.source.data).hexdigest()

    def resource(self, kind: str, path: str, name: str, media_type: str, size: int) -> None:
        uri = f"artifact://{self.digest}/{kind}/{quote(path, safe='-_.~$&+=:@')}"
        self.resources.append({"uri": uri, "name": name, "media_type": media_type, "size": size, "locator": {"path": path}})

    def warn(self, code: str, message: str, **locator) -> None:
        self.warnings.append({"code": code, "message": message, "locator": locator})


class Budget:
    """Counts nodes and text bytes while a tree grows."""

    def __init__(self, limits: Limits, nodes: int = 0) -> None:
        self.limits, self.nodes, self.text = limits, nodes, 0

    def node(self, count: int = 1, what: str = "nodes") -> None:
        self.nodes += count
        if self.nodes > self.limits.max_nodes:
            raise LimitError(what, self.nodes, self.limits.max_nodes)

    def depth(self, depth: int) -> None:
        if depth > self.limits.max_nesting_depth:
            raise LimitError("nesting depth", depth, self.limits.max_nesting_depth)

    def bytes(self, count: int) -> None:
        self.text += count
        if self.text > self.limits.max_text_bytes:
            raise LimitError("text bytes", self.text, self.limits.max_text_bytes)


def document(source: Source, *children: Node) -> Node:
    return Node("document", source.name, children=list(children))


def finalised(artifact: Artifact, limits: Limits) -> Artifact:
    """Node and text limits over the whole tree, in document order."""
    total = Budget(limits)
    for _, _, node in artifact.root.walk():
        node.kind = node.kind or "document"
        total.node()
        total.bytes(len(node.text.encode()))
    return artifact


def cell_name(column: int, row: int) -> str:
    """A1, B1, ..., Z1, AA1 of column and row, from 1."""
    letters = ""
    while column:
        column, rest = divmod(column - 1, 26)
        letters = chr(65 + rest) + letters
    return f"{letters}{row}"


def decoded(data: bytes) -> str:
    return data.decode("utf-8", "replace")
