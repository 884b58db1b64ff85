"""ZIP, TAR, TAR.GZ and GZIP inventories, and bytes of an entry on demand; nothing is unpacked to disk."""

from __future__ import annotations

import datetime
import gzip
import io
import posixpath
import stat
import struct
import tarfile
import zipfile
import zlib
from typing import IO

from arbora.functions.text import ENTRY_MEDIA
from arbora.model import LimitError, Limits

from .tree import Artifact, Budget, Node, Source, document


def clean_path(value: str) -> str:
    """A relative path that stays below its root, ``.`` and ``..`` resolved."""
    value = value.replace("\\", "/")
    if not value or "\0" in value or value.startswith("/") or value[1:2] == ":":
        raise ValueError(f'unsafe archive path "{value}"')
    out = posixpath.normpath(value)
    if out in (".", "..") or out.startswith("../"):
        raise ValueError(f'unsafe archive path "{value}"')
    return out


def check_ratio(expanded: int, compressed: int, limits: Limits) -> None:
    ratio = expanded / max(compressed, 1)
    if expanded > 0 and ratio > limits.max_compression_ratio:
        raise LimitError("compression ratio", int(ratio), int(limits.max_compression_ratio))


def media_type(name: str) -> str:
    return ENTRY_MEDIA.get(posixpath.splitext(name)[1].lower(), "")


class Zip:
    """A ZIP's directory, checked before anything is read."""

    def __init__(self, data: bytes, limits: Limits) -> None:
        try:
            self.file = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, struct.error, NotImplementedError) as e:
            raise ValueError(str(e)) from None
        entries = self.file.infolist()
        if len(entries) > limits.max_archive_entries:
            raise LimitError("archive entries", len(entries), limits.max_archive_entries)
        self.entries: dict[str, zipfile.ZipInfo] = {}
        self.expanded = 0
        for info in entries:
            name = clean_path(info.orig_filename)
            if name in self.entries:
                raise ValueError(f'duplicate archive path "{name}"')
            if self.expanded + info.file_size > limits.max_expanded_bytes:
                raise LimitError("expanded bytes", self.expanded + info.file_size, limits.max_expanded_bytes)
            check_ratio(info.file_size, info.compress_size, limits)
            self.expanded += info.file_size
            self.entries[name] = info

    def read(self, name: str, offset: int = 0, want: int | None = None) -> bytes:
        """A part, or a window of it; a whole one may not be longer than declared."""
        if name not in self.entries:
            raise KeyError(f'ZIP part "{name}" not found')
        info = self.entries[name]
        try:
            with self.file.open(info) as f:
                data = _forward(f, offset, info.file_size + 1 if want is None else want)
        except (zipfile.BadZipFile, RuntimeError, NotImplementedError, zlib.error, EOFError) as e:
            raise ValueError(f'ZIP part "{name}": {e}') from None
        if len(data) > info.file_size:
            raise ValueError(f'ZIP part "{name}" exceeded its declared size')
        return data


def is_link(info: zipfile.ZipInfo) -> bool:
    return info.create_system == 3 and stat.S_ISLNK(info.external_attr >> 16)


def _archive(source: Source, kind: str, media: str) -> tuple[Artifact, Node]:
    node = Node("archive", source.name)
    return Artifact(source, kind, media, document(source, node)), node


def _sums(node: Node, entries: int, expanded: int) -> None:
    node.attributes = {"entries": str(entries), "expanded_size": str(expanded)}


def _zip(source: Source, limits: Limits) -> Artifact:
    try:
        z = Zip(source.data, limits)
    except LimitError:
        raise
    except ValueError as e:
        raise ValueError(f"parse ZIP: {e}") from None
    out, node = _archive(source, "zip", "application/zip")
    budget = Budget(limits, 2)
    for name, info in z.entries.items():
        facts = {"size": str(info.file_size), "compressed_size": str(info.compress_size), "method": str(info.compress_type)}
        if info.orig_filename.endswith("/"):
            facts["type"] = "directory"
        elif is_link(info):
            facts["type"] = "symlink"
            out.warn("archive_symlink_skipped", "symlink entry was not exposed as a readable resource", path=name)
        elif info.flag_bits & 1:
            facts["encrypted"] = "true"
            out.warn("encrypted_entry_skipped", "encrypted ZIP entry requires credentials and was not exposed", path=name)
        else:
            out.resource("entry", name, name, media_type(name), info.file_size)
        node.children.append(Node("entry", name, locator={"path": name}, attributes=facts))
        budget.node()
    _sums(node, len(z.entries), z.expanded)
    return out


def _inflated(data: bytes, limits: Limits) -> bytes:
    """The bytes in a GZIP, no more than the limit allows."""
    most = limits.max_expanded_bytes
    try:
        with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
            out = f.read(most + 1)
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError(f"parse GZIP: {e}") from None
    if len(out) > most:
        raise LimitError("expanded bytes", len(out), most)
    check_ratio(len(out), len(data), limits)
    return out


def _tar(source: Source, data: bytes, limits: Limits, kind: str, media: str) -> Artifact:
    out, node = _archive(source, kind, media)
    budget = Budget(limits, 2)
    seen: set[str] = set()
    expanded = 0
    try:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as tar:
            for info in tar:
                if len(seen) + 1 > limits.max_archive_entries:
                    raise LimitError("archive entries", len(seen) + 1, limits.max_archive_entries)
                name = clean_path(info.name)
                if name in seen:
                    raise ValueError(f'duplicate archive path "{name}"')
                seen.add(name)
                if info.size < 0 or expanded + info.size > limits.max_expanded_bytes:
                    raise LimitError("expanded bytes", expanded + max(info.size, 0), limits.max_expanded_bytes)
                expanded += info.size
                facts = {"size": str(info.size), "mode": f"0{info.mode:o}" if info.mode else "0"}
                if info.isdir():
                    facts["type"] = "directory"
                elif info.type in (tarfile.REGTYPE, tarfile.AREGTYPE):
                    out.resource("entry", name, name, media_type(name), info.size)
                elif info.type in (tarfile.SYMTYPE, tarfile.LNKTYPE):
                    facts["type"] = "link"
                    out.warn("archive_link_skipped", "archive link was not exposed as a readable resource", path=name)
                else:
                    facts["type"] = "special"
                    out.warn("archive_special_skipped", "special archive entry was not exposed as a readable resource", path=name)
                node.children.append(Node("entry", name, locator={"path": name}, attributes=facts))
                budget.node()
    except LimitError:
        raise
    except (tarfile.TarError, ValueError) as e:
        raise ValueError(f"parse TAR: {e}") from None
    _sums(node, len(seen), expanded)
    return out


def _gzip_facts(data: bytes) -> tuple[str, int]:
    """Name and time in the header of a GZIP."""
    if len(data) < 10:
        raise ValueError("parse GZIP: header is cut")
    flags, when = data[3], struct.unpack("<I", data[4:8])[0]
    at = 10
    if flags & 4:
        at += 2 + struct.unpack("<H", data[at : at + 2])[0]
    name = b""
    if flags & 8:
        name = data[at : data.index(b"\0", at)]
    return name.decode("latin-1"), when


def _gzip(source: Source, limits: Limits) -> Artifact:
    size = len(_inflated(source.data, limits))
    name, when = _gzip_facts(source.data)
    try:
        name = clean_path(name or source.name.removesuffix(".gz"))
    except ValueError as e:
        raise ValueError(f"parse GZIP: {e}") from None
    out, node = _archive(source, "gzip", "application/gzip")
    facts = {"size": str(size)}
    if when:
        facts["modified"] = datetime.datetime.fromtimestamp(when, datetime.UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    node.children.append(Node("entry", name, locator={"path": name}, attributes=facts))
    _sums(node, 1, size)
    out.resource("entry", name, name, media_type(name), size)
    return out


def _holds_tar(source: Source) -> bool:
    if source.name.lower().endswith((".tar.gz", ".tgz")):
        return True
    try:
        return gzip.GzipFile(fileobj=io.BytesIO(source.data)).read(512)[257:262] == b"ustar"
    except (OSError, EOFError, zlib.error):
        return False


def read(source: Source, limits: Limits) -> Artifact:
    data = source.data
    if data[:4] in (b"PK\3\4", b"PK\5\6", b"PK\7\x08"):
        return _zip(source, limits)
    if data[:2] == b"\x1f\x8b":
        if _holds_tar(source):
            return _tar(source, _inflated(data, limits), limits, "tar.gz", "application/gzip")
        return _gzip(source, limits)
    if data[257:262] == b"ustar":
        return _tar(source, data, limits, "tar", "application/x-tar")
    raise ValueError("unknown archive encoding")


#: Bytes that are passed over at a time on the way to a window.
_STEP = 1 << 16


def _forward(f: IO[bytes], offset: int, want: int) -> bytes:
    """``want`` bytes from ``offset`` on, of a stream that only goes forward; what comes before is dropped piece by piece, what comes after isn't read."""
    while offset > 0:
        passed = len(f.read(min(offset, _STEP)))
        if not passed:
            return b""
        offset -= passed
    return f.read(want)


def _window(kind: str, data: bytes, path: str, offset: int, want: int, limits: Limits) -> bytes:
    if kind in ("zip", "docx", "pptx", "xlsx"):
        return Zip(data, limits).read(path, offset, want)
    if kind in ("gzip", "tar.gz"):
        if kind == "gzip" and offset + want > limits.max_expanded_bytes:
            raise LimitError("expanded bytes", offset + want, limits.max_expanded_bytes)
        try:
            with gzip.GzipFile(fileobj=io.BytesIO(data)) as f:
                return _forward(f, offset, want) if kind == "gzip" else _member(f, "r|", path, offset, want)
        except (OSError, EOFError, zlib.error) as e:
            raise ValueError(f"parse GZIP: {e}") from None
    if kind == "tar":
        return _member(io.BytesIO(data), "r:", path, offset, want)
    if kind == "eml":
        from .mail import attachment

        fields = path.split("/")
        whole = attachment(data, int(fields[1]) if len(fields) > 2 and fields[0] == "attachment" and fields[1].isdigit() else 0, limits)
        return whole[offset : offset + want]
    raise ValueError(f"format {kind} has no readable resources")


def _member(f: IO[bytes], mode: str, path: str, offset: int, want: int) -> bytes:
    with tarfile.open(fileobj=f, mode=mode) as tar:
        for info in tar:
            if clean_path(info.name) == path:
                return _forward(tar.extractfile(info), offset, want)
    raise KeyError(path)


def ranged(kind: str, data: bytes, path: str, size: int, offset: int, limit: int, limits: Limits) -> tuple[bytes, bool]:
    """A window of a resource in a container of some format, and whether it reaches the end; nothing after the window is inflated.

    An error if the content is shorter than declared or isn't there.
    """
    if offset >= size:
        return b"", True
    want = min(limit, size - offset)
    out = _window(kind, data, path, offset, want, limits)
    if want == size - offset and len(out) < want:
        raise ValueError("resource ended before its declared size")
    return out, len(out) >= size - offset


__all__ = ["Zip", "check_ratio", "clean_path", "is_link", "media_type", "ranged", "read"]
