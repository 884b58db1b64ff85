"""E-mail messages: headers, text bodies, attachments."""

from __future__ import annotations

import base64
import binascii
import quopri
import re
from collections.abc import Iterator
from email import message_from_bytes
from email.header import decode_header, make_header
from email.message import Message
from email.utils import collapse_rfc2231_value

from arbora.model import LimitError, Limits

from .markup import dom
from .tree import Artifact, Budget, Node, Source, decoded, document

_FIRST = re.compile(rb"[!-9;-~]+:")


def words(value: str) -> str:
    """RFC 2047 words decoded; anything malformed as it is."""
    try:
        return str(make_header(decode_header(value))) if "=?" in value else value
    except (LookupError, UnicodeError, ValueError, binascii.Error):
        return value


def _header(message: Message, name: str) -> str:
    value = message.get(name)
    return "" if value is None else re.sub(r"\r?\n[ \t]+", " ", str(value)).strip()


def _filename(message: Message) -> str:
    for param, header in (("filename", "content-disposition"), ("name", "content-type")):
        value = message.get_param(param, "", header=header)
        if value and (name := words(collapse_rfc2231_value(value))):
            return name
    return ""


def safe_name(value: str) -> str:
    base = value.replace("\\", "/").rstrip("/").rsplit("/", 1)[-1]
    return base.replace("\0", "") if base not in ("", ".") else "attachment"


def _content(message: Message) -> bytes:
    """The part's bytes after its transfer encoding."""
    if message.is_multipart():  # a message in a message
        return b"".join(x.as_bytes() for x in message.get_payload())
    raw = message.get_payload()
    raw = raw.encode("utf-8", "surrogateescape") if isinstance(raw, str) else raw or b""
    encoding = _header(message, "content-transfer-encoding").lower()
    if encoding == "base64":
        try:
            return base64.b64decode(re.sub(rb"[\r\n]", b"", raw), validate=True)
        except binascii.Error as e:
            raise ValueError(f"parse email body: {e}") from None
    return quopri.decodestring(raw) if encoding == "quoted-printable" else raw


def _open(data: bytes) -> Message:
    if not _FIRST.match(data):
        raise ValueError("parse email headers: malformed header")
    return message_from_bytes(data)


def parts(data: bytes, limits: Limits) -> Iterator[tuple[Message, str]]:
    """The parts that hold content, in order, with their media types."""
    stack = [(_open(data), 1)]
    while stack:
        message, depth = stack.pop()
        if depth > limits.max_nesting_depth:
            raise LimitError("nesting depth", depth, limits.max_nesting_depth)
        kind = message.get_content_type()
        if kind.startswith("multipart/"):
            if not message.get_boundary():
                raise ValueError("parse email: multipart body has no boundary")
            inner = message.get_payload()
            if isinstance(inner, list):
                stack.extend((x, depth + 1) for x in reversed(inner))
        else:
            yield message, kind


def attachments(data: bytes, limits: Limits) -> Iterator[tuple[Message, str, str]]:
    for message, kind in parts(data, limits):
        name = _filename(message)
        if name or message.get_content_disposition() == "attachment":
            yield message, kind, safe_name(name or "attachment")


def attachment(data: bytes, index: int, limits: Limits) -> bytes:
    """The bytes of an attachment, counted from 1."""
    for number, (message, _, _) in enumerate(attachments(data, limits), 1):
        if number == index:
            return _content(message)
    raise KeyError(index)


def read(source: Source, limits: Limits) -> Artifact:
    top = _open(source.data)
    metadata = {k.lower(): v for k in ("From", "To", "Cc", "Date", "Message-Id") if (v := _header(top, k))}
    if subject := words(_header(top, "Subject")):
        metadata["subject"] = subject
    out = Artifact(source, "eml", "message/rfc822", document(source), metadata)
    budget = Budget(limits)
    expanded = 0
    for message, kind in parts(source.data, limits):
        data = _content(message)
        expanded += len(data)
        if expanded > limits.max_expanded_bytes:
            raise LimitError("expanded bytes", expanded, limits.max_expanded_bytes)
        name = _filename(message)
        if name or message.get_content_disposition() == "attachment":
            name = safe_name(name or "attachment")
            path = f"attachment/{len(out.resources) + 1}/{name}"
            budget.node()
            out.root.children.append(Node("attachment", name, locator={"path": path}, attributes={"media_type": kind, "size": str(len(data))}))
            out.resource("attachment", path, name, kind, len(data))
            continue
        text = ""
        if kind == "text/plain":
            text = decoded(data).strip()
        elif kind == "text/html":
            text = dom(data).words(frozenset(("script", "style")))
        if text:
            budget.node()
            out.root.children.append(Node("paragraph", text=text, locator={"path": "body"}, attributes={"media_type": kind}))
    return out
