"""Artifacts as JSON and as Markdown, one row each.

Markdown of the kinds whose text stands alone is put together in the JVM by ``markdown_lines``; a whole tree, where indents and
tables depend on what is above and below, is rendered where it is parsed, before it becomes rows.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.engine import Corpus
from arbora.formats.tree import Artifact, Node

#: Attributes that a detail shows, in this order.
DETAILS = ("media_type", "size", "width", "height", "type")
_PLACES = ("path", "subpath", "page", "slide", "sheet", "cell", "byte_range")


def _clean(value: object) -> object:
    """Without what is empty: nulls, blanks, zeros, empty containers."""
    if isinstance(value, dict):
        return {k: c for k, v in value.items() if (c := _clean(v)) not in (None, "", 0, {}, [])}
    return value


def _ordered(locator: dict | None) -> dict:
    """A locator's parts in the order of its type."""
    return {k: locator[k] for k in _PLACES if k in locator} if locator else {}


def _locator(raw: dict | None) -> dict | None:
    out = _clean({k: v for k, v in _ordered(raw).items() if k != "byte_range"})
    if span := (raw or {}).get("byte_range"):
        out["byte_range"] = {"start": span.get("start") or 0, "end": span.get("end") or 0}
    return out or None


def _tree(made: Artifact, digest: str) -> dict:
    """Nested nodes with their ids, without what is empty."""
    stack, root = [], {}
    for path, _, n in made.root.walk():
        place = "".join(("root", *(f"/{i}" for i in path)))
        key = hashlib.sha256(f"{digest}\0{n.kind}\0{place}".encode()).hexdigest()[:20]
        node = {"id": f"node_{key}", "kind": n.kind, "name": n.name, "text": n.text, "level": n.level, "locator": _locator(n.locator), "attributes": dict(sorted((n.attributes or {}).items()))}
        node = {k: v for k, v in node.items() if v not in (None, "", 0, {})}
        del stack[len(path) :]
        if stack:
            stack[-1].setdefault("children", []).append(node)
        else:
            root = node
        stack.append(node)
    return root


def _json(pretty: bool):
    def render(made: Artifact) -> str:
        digest = made.digest
        head = {"id": f"sha256:{digest}", "name": made.root.name or made.source.name, "format": made.format, "media_type": made.media_type, "size": len(made.source.data), "digest": digest, "metadata": dict(sorted((made.metadata or {}).items()))}
        document = {k: v for k, v in head.items() if v not in (None, "", {})}
        document["root"] = _tree(made, digest)
        for k, keys in (("resources", ("uri", "name", "media_type", "size")), ("warnings", ("code", "message"))):
            if rows := getattr(made, k):
                document[k] = [_clean({x: r.get(x) for x in keys} | {"locator": _ordered(r.get("locator"))}) for r in rows]
        return json.dumps(document, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":")) + "\n"

    return render


def _detail(attributes: dict[str, str]) -> str:
    shown = ", ".join(f"{k}={attributes[k]}" for k in DETAILS if attributes.get(k))
    return f" ({shown})" if shown else ""


def _grid(table: Node) -> str:
    rows = [[c.text.replace("|", "\\|").replace("\n", " ") for c in r.children] for r in table.children]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = [f"| {' | '.join(r + [''] * (width - len(r)))} |\n" for r in rows]
    return "".join([lines[0], f"| {' | '.join(['---'] * width)} |\n", *lines[1:], "\n"])


def _markdown(made: Artifact) -> str:
    out = [f"# {made.root.name or made.source.name}\n\n"]
    stack = [(c, 2, 0) for c in reversed(made.root.children)]
    while stack:
        node, level, indent = stack.pop()
        kind, title, text, marks, below = node.kind, node.name, node.text, node.attributes or {}, node.children
        lead = "  " * indent
        if kind in ("section", "slide", "sheet"):
            out.append(f"{'#' * min(6, node.level + 1 if node.level > 0 else level)} {title}\n\n")
        elif kind == "page":
            out.append(f"{'#' * min(level, 6)} {title}\n\n{text}\n\n")
        elif kind == "table":
            out.append(_grid(node))
            continue
        elif kind == "attachment":
            out.append(f"- Attachment: **{title}**{_detail(marks)}\n")
        elif kind == "entry":
            out.append(f"- `{title}`{_detail(marks)}\n")
        elif kind == "link":
            out.append(f"[{title or marks.get('href', '')}]({marks.get('href', '')})\n\n")
        elif kind == "image":
            out.append(f"![{title}]({marks['src']})\n\n" if marks.get("src") else f"- Image: **{title}**{_detail(marks)}\n")
        elif kind == "field":
            if len(below) == 1 and below[0].kind == "value":
                out.append(f"{lead}- **{title}:** {below[0].text}\n")
                continue
            out.append(f"{lead}- **{title}**\n")
            indent += 1
        elif kind == "value":
            out.append(f"{lead}- {text}\n")
        elif kind in ("object", "array"):
            if title not in ("", "root"):
                out.append(f"{lead}- **{title}**\n")
                indent += 1
        elif kind == "paragraph" or text:
            out.append(f"{text}\n\n")
        stack.extend((c, level + 1, indent) for c in reversed(below))
    return "".join(out)


def _first(rows: DataFrame) -> DataFrame:
    """Of equal bytes the first source's text."""
    return rows.groupBy("artifact_id").agg(F.min_by("rendered", "source_path").alias("rendered"))


def source_json(corpus: Corpus, pretty: bool = False) -> DataFrame:
    """``artifact_id, source_path, rendered``: each source with its nested tree; nothing is shuffled."""
    return corpus.rendered(_json(pretty))


def source_markdown(corpus: Corpus) -> DataFrame:
    return corpus.rendered(_markdown)


def to_json(corpus: Corpus, pretty: bool = False) -> DataFrame:
    """``artifact_id, rendered``: each artifact with its nested tree."""
    return _first(source_json(corpus, pretty))


def to_markdown(corpus: Corpus) -> DataFrame:
    return _first(source_markdown(corpus))


def markdown_lines(kind, name, text, level):
    """Markdown of one section or paragraph as a column."""
    marks = F.repeat(F.lit("#"), F.least(F.lit(6), F.when(level > 0, level + 1).otherwise(F.lit(2))))
    return F.when(kind == "section", F.concat(marks, F.lit(" "), name, F.lit("\n\n"))).when((kind == "paragraph") | (text != ""), F.concat(text, F.lit("\n\n"))).otherwise("")
