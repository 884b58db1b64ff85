"""PNG, JPEG and GIF: size and colour model from the header; pixels are never decoded."""

from __future__ import annotations

import struct

from arbora.model import Limits

from .tree import Artifact, Node, Source, document

_FUNCTION, _PALETTE = "*color.modelFunc", "color.Palette"


def header(data: bytes) -> tuple[str, int, int, str]:
    """Format, width, height, colour model."""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        if len(data) < 33 or data[12:16] != b"IHDR":
            raise ValueError("decode image configuration: png without IHDR")
        width, height = struct.unpack(">II", data[16:24])
        if not width or not height:
            raise ValueError("decode image configuration: png without pixels")
        return "png", width, height, _PALETTE if data[25] == 3 else _FUNCTION
    if data[:6] in (b"GIF87a", b"GIF89a"):
        if len(data) < 13:
            raise ValueError("decode image configuration: gif header is cut")
        return "gif", *struct.unpack("<HH", data[6:10]), _PALETTE
    at = 2
    while data.startswith(b"\xff\xd8") and at + 4 <= len(data):
        if data[at] != 0xFF:
            break
        marker = data[at + 1]
        if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 1 if marker == 0xFF else 2
            continue
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if marker in (0xC0, 0xC1, 0xC2) and at + 10 <= len(data):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return "jpeg", width, height, _FUNCTION
        if marker == 0xDA:
            break
        at += 2 + size
    raise ValueError("decode image configuration: no frame header")


def read(source: Source, limits: Limits) -> Artifact:
    kind, width, height, model = header(source.data)
    size = {"width": str(width), "height": str(height)}
    node = Node("image", source.name, locator={"byte_range": {"start": 0, "end": len(source.data)}}, attributes=size | {"color_model": model})
    return Artifact(source, kind, f"image/{kind}", document(source, node), size)
