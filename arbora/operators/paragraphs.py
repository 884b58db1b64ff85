"""Text columns as node tables without leaving the JVM: lines with byte offsets, paragraphs, Markdown sections.

Everything about a text is worked out within its row, by functions over the array of its lines, so nothing is shuffled and rows
need no key of their own: repeated and null keys give each row its own nodes. Each step is bound by a one-row ``explode``, which the
optimizer doesn't fold into the functions that use it, where it would be worked out again for each line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions.text import SPACE, trimmed
from arbora.model import LOCATOR, identified

#: Entries that a running sum copies at a time; sums of blocks are added to those within them.
BLOCK = 256


def _bound(frame: DataFrame, **columns: Column) -> DataFrame:
    """``frame`` with columns that are worked out here, once for each row."""
    kept = [c for c in frame.columns if c not in columns]
    return frame.select(*kept, F.explode(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))).alias("_step")).select(*kept, *(F.col("_step")[name].alias(name) for name in columns))


def _running(frame: DataFrame, name: str, values: Column) -> DataFrame:
    """``frame`` with ``name``, the sums of the entries before each entry of an array."""
    step = lambda done, x: F.concat(done, F.array(F.element_at(done, -1) + x))
    zero = F.array(F.lit(0).cast("bigint"))
    frame = _bound(frame, _values=values)
    blocks = F.sequence(F.lit(0), F.floor(F.greatest(F.size("_values") - 1, F.lit(0)) / BLOCK).cast("int"))
    frame = _bound(frame, _inner=F.transform(blocks, lambda b: F.aggregate(F.slice("_values", b * BLOCK + 1, F.lit(BLOCK)), zero, step)))
    frame = _bound(frame, _outer=F.aggregate("_inner", zero, lambda done, block: step(done, F.element_at(block, -1))))
    sums = F.flatten(F.transform("_inner", lambda block, i: F.transform(F.slice(block, F.lit(1), F.size(block) - 1), lambda x: x + F.get("_outer", i))))
    return _bound(frame, **{name: sums}).drop("_values", "_inner", "_outer")


def _lines(docs: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """The kept columns, and arrays of the lines' texts, starts and ends: ``_text, _line, _start, _end``."""
    rows = _bound(docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")), _raw=F.split("_text", "\n"))
    rows = _bound(rows, _raw=F.when(F.element_at("_raw", -1) == "", F.slice("_raw", F.lit(1), F.size("_raw") - 1)).otherwise(F.col("_raw")))
    rows = _running(rows, "_start", F.transform("_raw", lambda x: F.octet_length(x).cast("bigint") + 1))
    end = F.zip_with("_start", "_raw", lambda at, x: at + F.octet_length(x))
    return _bound(rows, _end=end, _line=F.transform("_raw", lambda x: F.regexp_replace(x, "\r$", ""))).drop("_raw")


def _blank(line: Column) -> Column:
    return ~line.rlike(f"[^{SPACE[1:-1]}]")


def _runs(rows: DataFrame, cut: Column) -> DataFrame:
    """``rows`` with ``_first`` and ``_last``, the numbers of the first and last lines of the runs between cut ones (``cut``: an array of truth values)."""
    rows = _bound(rows, _cut=cut)
    there = F.when(F.size("_cut") > 0, F.sequence(F.lit(0), F.size("_cut") - 1)).otherwise(F.array().cast("array<int>"))
    edge = lambda step: F.filter(there, lambda i: ~F.get("_cut", i) & F.coalesce(F.get("_cut", i + step), F.lit(True)))
    return _bound(rows, _first=edge(-1), _last=edge(1))


def _body(first: Column, last: Column) -> Column:
    return F.array_join(F.slice("_line", first + 1, last - first + 1), "\n")


def line_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, line, text, start, end`` of each line: LF splits, a CR before it is left out of the text but not of the span, and a last empty line doesn't count."""
    spans = _lines(docs, [key], text).select(key, F.posexplode(F.arrays_zip("_line", "_start", "_end")).alias("line", "s"))
    return spans.select(key, "line", F.col("s._line").alias("text"), F.col("s._start").alias("start"), F.col("s._end").alias("end"))


def _paragraphs(docs: DataFrame, keep: Sequence[str], text: str) -> DataFrame:
    """The kept columns and an array ``_found`` of paragraphs with ``text, start, end``."""
    rows = _lines(docs, keep, text)
    rows = _runs(rows, F.transform("_line", _blank))
    found = F.zip_with("_first", "_last", lambda a, b: F.struct(_body(a, b).alias("text"), F.get("_start", a).alias("start"), F.get("_end", b).alias("end")))
    return _bound(rows, _found=found)


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, paragraph, text, start, end``: runs of lines between blank ones, joined by LF."""
    rows = _paragraphs(docs, [key], text).select(key, F.posexplode("_found").alias("paragraph", "p"))
    return rows.select(key, "paragraph", "p.text", "p.start", "p.end")


def heading_level(line: Column) -> Column:
    """1 to 6 of an ATX heading, else 0."""
    return F.char_length(F.regexp_extract(line, r"^[ \t]*(#{1,6}) ", 1))


def heading_title(line: Column) -> Column:
    return trimmed(F.regexp_replace(F.regexp_extract(line, r"(?s)^[ \t]*#{1,6} (.*)$", 1), "#+$", ""))


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, path, kind, parent_kind, name, text, level, start, end``: flat sections at the root, paragraphs in the last one before them."""
    rows = _lines(docs, [key], text)
    rows = _bound(rows, _level=F.transform("_line", heading_level))
    rows = _runs(rows, F.zip_with("_line", "_level", lambda x, level: _blank(x) | (level > 0)))
    rows = _bound(rows, _heads=F.filter(F.transform("_level", lambda level, i: F.when(level > 0, i)), lambda i: i.isNotNull()))
    # before each line: headings, and runs that began
    rows = _running(rows, "_above", F.transform("_level", lambda level: (level > 0).cast("bigint")))
    begun = F.transform("_cut", lambda cut, i: (~cut & F.coalesce(F.get("_cut", i - 1), F.lit(True))).cast("bigint"))
    rows = _running(rows, "_begun", begun)
    rows = _bound(rows, _loose=F.when(F.size("_heads") > 0, F.get("_begun", F.get("_heads", F.lit(0)))).otherwise(0))
    at = lambda *numbers: F.array(*(n.cast("int") for n in numbers))
    block = lambda path, kind, parent, name, body, level, a, b: F.struct(path.alias("path"), F.lit(kind).alias("kind"), parent.alias("parent_kind"), name.alias("name"), body.alias("text"), level.alias("level"), F.get("_start", a).alias("start"), F.get("_end", b).alias("end"))
    heads = F.transform("_heads", lambda h, s: block(at(F.col("_loose") + s), "section", F.lit("document"), heading_title(F.get("_line", h)), F.lit(""), F.get("_level", h), h, h))
    section = lambda a: F.get("_above", a)
    inside = lambda a: F.get("_begun", a) - F.get("_begun", F.get("_heads", (section(a) - 1).cast("int")))
    path = lambda a: F.when(section(a) == 0, at(F.get("_begun", a))).otherwise(at(F.col("_loose") + section(a) - 1, inside(a)))
    body = F.zip_with("_first", "_last", lambda a, b: block(path(a), "paragraph", F.when(section(a) == 0, "document").otherwise("section"), F.lit(""), _body(a, b), F.lit(0), a, b))
    return rows.select(key, F.explode(F.concat(heads, body)).alias("b")).select(key, "b.*")


def document_nodes(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Texts as node tables: a root named after the key and its paragraphs, with identities from the text's digest. ``key`` and the columns in ``keep`` stay."""
    rows = _bound(_paragraphs(docs, [key, *keep], text), digest=F.sha2("_text", 256))
    place = lambda a, b: F.struct(F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("subpath"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("slide"), F.lit(None).cast("string").alias("sheet"), F.lit(None).cast("string").alias("cell"), F.struct(a.alias("start"), b.alias("end")).alias("byte_range"))
    node = lambda path, kind, parent, name, body, locator: F.struct(path.cast("array<int>").alias("path"), F.lit(kind).alias("kind"), parent.cast("string").alias("parent_kind"), name.alias("name"), body.alias("text"), locator.cast(LOCATOR).alias("locator"))
    root = node(F.array(), "document", F.lit(None), F.concat(F.lit("doc-"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(".txt")), F.lit(""), F.lit(None))
    body = F.transform("_found", lambda p, i: node(F.array(i), "paragraph", F.lit("document"), F.lit(""), p["text"], place(p["start"], p["end"])))
    rows = rows.select(key, *keep, "digest", F.explode(F.concat(F.array(root), body)).alias("n")).select(key, *keep, "digest", "n.*")
    rows = identified(rows)
    return rows.select(key, *keep, F.concat(F.lit("sha256:"), F.col("digest")).alias("artifact_id"), "node_id", "parent_id", "path", "depth", "ordinal", "kind", "name", "text", F.lit(0).alias("level"), "locator")
