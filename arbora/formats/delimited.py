"""CSV and TSV by RFC 4180 with byte ranges: strict quotes, ragged rows, blank lines skipped."""

from __future__ import annotations

from collections.abc import Iterator

from arbora.model import Limits

from .tree import Artifact, Budget, Node, Source, cell_name, decoded, document


def _physical(data: bytes) -> Iterator[tuple[bytes, int]]:
    """Lines with CRLF as LF, and where each ends in the data; a CR at the very end is dropped."""
    at = 0
    while at < len(data):
        cut = data.find(b"\n", at)
        end = len(data) if cut < 0 else cut + 1
        line = data[at:end]
        if line.endswith(b"\r\n"):
            line = line[:-2] + b"\n"
        elif cut < 0 and line.endswith(b"\r"):
            line = line[:-1]
        yield line, end
        at = end


def records(data: bytes, comma: bytes) -> Iterator[tuple[list[str], int]]:
    """Fields of each record and the offset after it."""
    source = _physical(data)
    for line, end in source:
        if line in (b"\n", b""):
            continue
        row, at = [], 0
        while True:
            if line[at : at + 1] == b'"':
                value, at = bytearray(), at + 1
                while True:
                    quote = line.find(b'"', at)
                    if quote < 0:
                        value += line[at:]
                        line, end = next(source, (None, end))
                        if line is None:
                            raise ValueError("extraneous or missing quote in quoted field")
                        at = 0
                        continue
                    value += line[at:quote]
                    at = quote + 1
                    if line[at : at + 1] != b'"':
                        break
                    value += b'"'
                    at += 1
                more = line[at : at + 1] == comma
                if not more and line[at:] not in (b"", b"\n"):
                    raise ValueError("extraneous or missing quote in quoted field")
                at += 1
            else:
                stop = line.find(comma, at)
                more = stop >= 0
                value = line[at : stop if more else len(line)]
                value = value if more else value.removesuffix(b"\n")
                if b'"' in value:
                    raise ValueError('bare " in non-quoted field')
                at = stop + 1
            row.append(decoded(bytes(value)))
            if not more:
                break
        yield row, end


def read(source: Source, limits: Limits) -> Artifact:
    tabs = source.extension == ".tsv"
    budget = Budget(limits, 2)
    table = Node("table", source.name)
    start = 0
    try:
        for number, (values, end) in enumerate(records(source.data, b"\t" if tabs else b","), 1):
            span = {"start": start, "end": end}
            row = Node("row", str(number), locator={"byte_range": span}, attributes={"role": "header"} if number == 1 else None)
            for column, value in enumerate(values, 1):
                cell = cell_name(column, number)
                row.children.append(Node("cell", cell, value, locator={"cell": cell, "byte_range": span}))
            table.children.append(row)
            budget.node(1 + len(values))
            start = end
    except ValueError as e:
        if hasattr(e, "limit"):
            raise
        raise ValueError(f"parse {'TSV' if tabs else 'CSV'}: {e}") from None
    metadata = {"rows": str(len(table.children))}
    return Artifact(source, "tsv" if tabs else "csv", "text/tab-separated-values" if tabs else "text/csv", document(source, table), metadata)
