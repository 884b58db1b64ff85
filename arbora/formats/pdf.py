"""PDF: the text of each page from its content streams.

Objects are found by scanning for ``n g obj`` (the last of a number counts) and in object streams, so a damaged cross-reference
table does no harm. Text operators are read with a font's ToUnicode map, else as Latin text; other encodings and encrypted files
are not understood, and such a page gets a warning.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from arbora.model import LimitError, Limits

from .tree import Artifact, Budget, Node, Source, document

_OBJECT = re.compile(rb"(?<![0-9])([0-9]{1,10})\s+([0-9]{1,5})\s+obj\b")
_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(?P<num>[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+))(?![^\s()<>\[\]{}/%])|/(?P<name>[^\s()<>\[\]{}/%]*)|(?P<hex><[0-9A-Fa-f\s]*>)|(?P<open><<|\[|\()|(?P<close>>>|\])|(?P<word>[^\s()<>\[\]{}/%]+)|(?P<odd>.)", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    pass


class Ref(int):
    pass


class Word(str):
    """An operator or keyword."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string from after its bracket."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            octal = re.compile(rb"[0-7]{1,3}").match(data, at)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            c = data[at : at + 1]
            at += 2 if data[at : at + 2] == b"\r\n" else 1
            if c not in (b"\n", b"\r"):
                out += _ESCAPES.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def _name(raw: bytes) -> Name:
    return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw).decode("latin-1"))


def values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Objects and operators from some place on, each with the offset after it; containers come whole."""
    stack: list[list] = []
    while at < len(data):
        m = _TOKEN.match(data, at)
        at = m.end()
        if m["num"] is not None:
            value: object = float(m["num"]) if b"." in m["num"] else int(m["num"])
        elif m["name"] is not None:
            value = _name(m["name"])
        elif m["hex"] is not None:
            digits = re.sub(rb"[<>\s]", b"", m["hex"])
            value = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        elif m["open"] == b"(":
            value, at = _string(data, at)
        elif m["open"]:
            if len(stack) > 200:
                raise ValueError("parse PDF: nesting is too deep")
            stack.append([m["open"]])
            continue
        elif m["close"]:
            if not stack:
                continue
            kind, *items = stack.pop()
            value = items if kind == b"[" else {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, Name)}
        elif m["word"]:
            word = m["word"].decode("latin-1")
            items = stack[-1] if stack else None
            if word == "R" and items and len(items) > 2 and isinstance(items[-2], int):
                del items[-1]
                items[-1] = Ref(items[-1])
                continue
            value = {"true": True, "false": False, "null": None}.get(word, Word(word))
        else:
            continue
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


class File:
    def __init__(self, data: bytes, limits: Limits) -> None:
        if not data.startswith(b"%PDF-"):
            raise ValueError("not a PDF file: invalid header")
        self.data, self.limits, self.inflated = data, limits, 0
        self.at = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}
        self.known: dict[int, object] = {}
        self.streams: dict[int, tuple[dict, int]] = {}
        for number in list(self.at):
            value = self.get(Ref(number))
            if isinstance(value, dict) and value.get("Type") == "ObjStm" and number in self.streams:
                self._unpack(number, value)

    def get(self, value: object) -> object:
        for _ in range(50):
            if not isinstance(value, Ref):
                return value
            number = int(value)
            if number not in self.known:
                self.known[number] = self._load(number)
            value = self.known[number]
        return None

    def _load(self, number: int) -> object:
        if number not in self.at:
            return None
        head = values(self.data, self.at[number])
        first, end = next(head, (None, 0))
        if type(first) is int:  # ``n g R`` alone
            more = [v for v, _ in (next(head, (None, 0)), next(head, (None, 0)))]
            return Ref(first) if more[1] == "R" else first
        tail = re.compile(rb"\s*stream\r?\n").match(self.data, end)
        if isinstance(first, dict) and tail:
            self.streams[number] = first, tail.end()
        return first

    def stream(self, value: object) -> bytes:
        """A stream's bytes, inflated if it is deflated."""
        self.get(value)
        if not isinstance(value, Ref) or int(value) not in self.streams:
            return b""
        facts, start = self.streams[int(value)]
        size = self.get(facts.get("Length"))
        end = start + size if isinstance(size, int) else -1
        if end < start or not self.data[end : end + 12].lstrip().startswith(b"endstream"):
            end = self.data.find(b"endstream", start)
            end = len(self.data) if end < 0 else end
        raw = self.data[start:end]
        filters = self.get(facts.get("Filter")) or []
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) != "FlateDecode":
                raise ValueError(f"unsupported stream filter {self.get(f)}")
            raw = zlib.decompressobj().decompress(raw, self.limits.max_expanded_bytes - self.inflated + 1)
            self.inflated += len(raw)
            if self.inflated > self.limits.max_expanded_bytes:
                raise LimitError("expanded bytes", self.inflated, self.limits.max_expanded_bytes)
        return raw

    def _unpack(self, number: int, facts: dict) -> None:
        try:
            raw = self.stream(Ref(number))
            count, first = self.get(facts["N"]), self.get(facts["First"])
            numbers = [v for v, _ in values(raw[:first]) if type(v) is int]
            for k in range(count):
                self.known.setdefault(numbers[2 * k], next(values(raw, first + numbers[2 * k + 1]), (None, 0))[0])
        except (KeyError, IndexError, TypeError, zlib.error, ValueError) as e:
            if isinstance(e, LimitError):
                raise

    def root(self) -> dict:
        found = None
        for m in re.finditer(rb"trailer\s*<<", self.data):
            trailer = next(values(self.data, m.start() + 7), ({}, 0))[0]
            if isinstance(trailer, dict) and isinstance(self.get(trailer.get("Root")), dict):
                found = self.get(trailer["Root"])
        for value in [*self.known.values()]:
            if isinstance(value, dict) and value.get("Type") == "Catalog":
                found = value
        if found is None:
            raise ValueError("parse PDF: no document catalog")
        return found

    def pages(self) -> list[dict]:
        """Page dictionaries in order, with inherited resources."""
        out: list[dict] = []
        stack: list[tuple[object, object]] = [(self.root().get("Pages"), None)]
        seen: set[int] = set()
        while stack:
            ref, inherited = stack.pop()
            if isinstance(ref, Ref):
                if int(ref) in seen:
                    continue
                seen.add(int(ref))
            node = self.get(ref)
            if not isinstance(node, dict):
                continue
            own = node.get("Resources", inherited)
            if isinstance(kids := self.get(node.get("Kids")), list):
                stack.extend((k, own) for k in reversed(kids))
            else:
                out.append(node | {"Resources": own})
        return out

    def unicode(self, font: object) -> dict[bytes, str]:
        """A font's ToUnicode map, by code."""
        facts = self.get(font)
        out: dict[bytes, str] = {}
        if not isinstance(facts, dict) or not isinstance(facts.get("ToUnicode"), Ref):
            return out
        operands: list = []
        for value, _ in values(self.stream(facts["ToUnicode"])):
            if isinstance(value, Word):
                if value == "endbfchar":
                    out |= {a: b.decode("utf-16-be", "replace") for a, b in zip(operands[::2], operands[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)}
                elif value == "endbfrange":
                    for a, b, to in zip(operands[::3], operands[1::3], operands[2::3], strict=False):
                        low, high = int.from_bytes(a, "big"), int.from_bytes(b, "big")
                        for k in range(min(high - low + 1, 65_536)):
                            code = (low + k).to_bytes(len(a), "big")
                            if isinstance(to, list):
                                out[code] = to[k].decode("utf-16-be", "replace") if k < len(to) else ""
                            else:
                                out[code] = (int.from_bytes(to, "big") + k).to_bytes(len(to), "big").decode("utf-16-be", "replace")
                operands = []
            else:
                operands.append(value)
        return out

    def text(self, page: dict) -> str:
        fonts = self.get((self.get(page.get("Resources")) or {}).get("Font")) or {}
        maps: dict[str, dict[bytes, str]] = {}
        contents = self.get(page.get("Contents"))
        refs = contents if isinstance(contents, list) else [page.get("Contents")]
        raw = b"\n".join(self.stream(x) for x in refs)
        out: list[str] = []
        now: dict[bytes, str] = {}
        operands: list = []

        def show(piece: object) -> None:
            if not isinstance(piece, bytes):
                return
            if not now:
                out.append(piece.decode("cp1252", "replace"))
                return
            width = max(map(len, now))
            out.append("".join(now.get(piece[i : i + width], "") for i in range(0, len(piece), width)))

        for value, _ in values(raw):
            if not isinstance(value, Word):
                operands.append(value)
                continue
            if value in ("T*", "'", '"') or value == "Td" and len(operands) > 1 and operands[1] or value == "TD":
                out.append("\n")
            if value in ("Tj", "'", '"') and operands:
                show(operands[-1])
            elif value == "TJ" and operands and isinstance(operands[-1], list):
                for piece in operands[-1]:
                    show(piece)
            elif value == "Tf" and operands and isinstance(operands[0], Name):
                if operands[0] not in maps:
                    maps[operands[0]] = self.unicode(fonts.get(operands[0]))
                now = maps[operands[0]]
            elif value == "ET":
                out.append("\n")
            operands = []
        return "".join(out)


def normalised(text: str) -> str:
    """NUL dropped, CRLF as LF, lines and the whole trimmed."""
    return "\n".join(x.strip() for x in text.replace("\0", "").replace("\r\n", "\n").split("\n")).strip()


def read(source: Source, limits: Limits) -> Artifact:
    file = File(source.data, limits)
    pages = file.pages()
    if len(pages) + 1 > limits.max_nodes:
        raise LimitError("nodes", len(pages) + 1, limits.max_nodes)
    out = Artifact(source, "pdf", "application/pdf", document(source), {"pages": str(len(pages))})
    budget = Budget(limits)
    for number, page in enumerate(pages, 1):
        text = ""
        try:
            text = normalised(file.text(page))
            if not text:
                out.warn("pdf_page_has_no_text", "page may contain only images or vector content", page=number)
        except LimitError:
            raise
        except (ValueError, TypeError, AttributeError, IndexError, zlib.error) as e:
            out.warn("pdf_page_text_error", str(e), page=number)
        budget.bytes(len(text.encode()))
        out.root.children.append(Node("page", f"Page {number}", text, locator={"page": number}))
    return out
