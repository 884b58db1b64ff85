"""Inputs that the tests parse, made with the standard library."""

from __future__ import annotations

import gzip
import io
import struct
import tarfile
import zipfile
import zlib

MARKDOWN = b"# Water pump\n\nStopped at noon.\nBack by two.\n\n## Cause\n\nA worn seal.\n\n## Next ##\n\nOrder seals.\n"
JSON = b'{"agent": {"name": "gardener", "tools": ["rake", "hose", "spade"]}, "safe": true, "retries": 3}'
YAML = b"agent:\n  name: gardener\n  enabled: true\n  retries: 3\n  tags:\n    - soil\n    - water\nmodels:\n  primary: oak\n"
TOML = b'title = "beds"\n[agent]\nname = "gardener"\nenabled = true\nratio = 1.0\nsince = 2024-05-01T10:00:00Z\n[limits]\nwait = 1e3\n'
CSV = b"bed,depth,state\nnorth,12,ok\nsouth,7,dry\nwest,9,ok\n"
HTML = b"<!DOCTYPE html><html><head><title>Garden  notes</title></head><body><h1>Beds &amp; paths</h1><p>Dig <b>deep</b> now.<table><tr><th>Bed<th>Depth<tr><td>north<td>12</table><a href='/more'>More</a><img src='a.png' alt='A bed' width='3'><script>secret()</script><ul><li>one<li>two</ul></body></html>"
XML = b'<?xml version="1.0"?><garden xmlns:x="u" size="2"><bed id="1"><name>north</name>tall<!-- c -->grass</bed><x:bed id="2"/></garden>'
MAIL = b"From: a@example.com\nTo: b@example.com\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=\"cut\"\n\n--cut\nContent-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\nsoil=20is wet\n--cut\nContent-Type: application/json; name=\"beds.json\"\nContent-Disposition: attachment; filename=\"beds.json\"\nContent-Transfer-Encoding: base64\n\neyJhIjogMX0=\n--cut--\n"


def png(width: int = 2, height: int = 3) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\0" * (height * (1 + 4 * width)))) + chunk(b"IEND", b"")


def zipped(files: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def tarred(files: dict[str, bytes], compress: bool = False, link: str | None = None) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.USTAR_FORMAT) as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size, info.mode = len(data), 0o600
            t.addfile(info, io.BytesIO(data))
        if link:
            info = tarfile.TarInfo(link)
            info.type, info.linkname = tarfile.SYMTYPE, "elsewhere"
            t.addfile(info)
    return gzip.compress(out.getvalue(), mtime=0) if compress else out.getvalue()


def gzipped(name: str, data: bytes, when: int = 1_700_000_000) -> bytes:
    out = io.BytesIO()
    with gzip.GzipFile(name, "wb", fileobj=out, mtime=when) as f:
        f.write(data)
    return out.getvalue()


_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _rels(*items: tuple[str, str, str, bool]) -> bytes:
    rows = "".join(f'<Relationship Id="{i}" Type="{_R}/{t}" Target="{to}"{" TargetMode=" + chr(34) + "External" + chr(34) if out else ""}/>' for i, t, to, out in items)
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'.encode()


def docx() -> bytes:
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    body = f'<w:document xmlns:w="w" xmlns:r="{_R}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Beds</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>See </w:t></w:r><w:hyperlink r:id="r1"><w:r><w:t>here</w:t></w:r></w:hyperlink></w:p><w:tbl><w:tr>{cell("Bed")}{cell("Depth")}</w:tr><w:tr>{cell("north")}{cell("12")}</w:tr></w:tbl></w:body></w:document>'
    head = '<w:hdr xmlns:w="w"><w:p><w:r><w:t>Garden</w:t></w:r></w:p></w:hdr>'
    core = '<c xmlns:dc="d"><dc:title>Plan</dc:title><dc:creator>Ann</dc:creator></c>'
    return zipped({"word/document.xml": body.encode(), "word/_rels/document.xml.rels": _rels(("r1", "hyperlink", "https://example.com/x", True)), "word/header1.xml": head.encode(), "docProps/core.xml": core.encode(), "word/media/pixel.png": png()})


def pptx() -> bytes:
    para = lambda t: f"<a:p><a:r><a:t>{t}</a:t></a:r></a:p>"
    cell = lambda t: f"<a:tc><a:txBody>{para(t)}</a:txBody></a:tc>"
    slide = f'<p:sld xmlns:p="p" xmlns:a="a">{para("Spring")}{para("Dig")}<a:tbl><a:tr>{cell("Bed")}{cell("Depth")}</a:tr><a:tr>{cell("north")}{cell("12")}</a:tr></a:tbl></p:sld>'
    show = f'<p:presentation xmlns:p="p" xmlns:r="{_R}"><p:sldIdLst><p:sldId id="256" r:id="r1"/></p:sldIdLst></p:presentation>'
    return zipped({"ppt/presentation.xml": show.encode(), "ppt/_rels/presentation.xml.rels": _rels(("r1", "slide", "slides/slide1.xml", False)), "ppt/slides/slide1.xml": slide.encode(), "ppt/slides/_rels/slide1.xml.rels": _rels(("n1", "notesSlide", "../notesSlides/notesSlide1.xml", False)), "ppt/notesSlides/notesSlide1.xml": f'<p:notes xmlns:p="p" xmlns:a="a">{para("Bring gloves")}</p:notes>'.encode(), "ppt/media/pixel.png": png()})


def xlsx() -> bytes:
    sheet = f'<worksheet xmlns:r="{_R}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>open</t></is></c></row><row r="2"><c r="A2"><v>1</v></c><c r="B2" t="b"><v>1</v></c><c r="C2"><f>SUM(A2:A2)</f><v>3</v></c></row></sheetData><mergeCells><mergeCell ref="C3:D3"/></mergeCells><hyperlinks><hyperlink ref="A1" r:id="h1"/></hyperlinks></worksheet>'
    book = f'<workbook xmlns:r="{_R}"><workbookPr date1904="0"/><sheets><sheet name="Beds" sheetId="1" r:id="r1"/></sheets></workbook>'
    return zipped({"xl/workbook.xml": book.encode(), "xl/_rels/workbook.xml.rels": _rels(("r1", "worksheet", "worksheets/sheet1.xml", False)), "xl/worksheets/sheet1.xml": sheet.encode(), "xl/worksheets/_rels/sheet1.xml.rels": _rels(("h1", "hyperlink", "https://example.com/", True)), "xl/sharedStrings.xml": b"<sst><si><r><t>Be</t></r><r><t>d</t></r><rPh><t>x</t></rPh></si></sst>"})


def pdf(text: str = "Order new seals") -> bytes:
    stream = f"BT /F1 12 Tf 72 720 Td ({text}) Tj ET".encode()
    parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 5 0 R >> >> /Contents 4 0 R >>", b"<< /Length %d >>\nstream\n%s\nendstream" % (len(stream), stream), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    body = b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, p) for i, p in enumerate(parts, 1))
    return body + b"trailer << /Root 1 0 R /Size 6 >>\n%%EOF\n"


FILES = {
    "pump.md": (MARKDOWN, "markdown", "section"),
    "notes.txt": (b"one\ntwo\r\n\r\nthree", "text", "paragraph"),
    "config.json": (JSON, "json", "object"),
    "settings.yaml": (YAML, "yaml", "object"),
    "beds.toml": (TOML, "toml", "object"),
    "beds.csv": (CSV, "csv", "table"),
    "beds.tsv": (CSV.replace(b",", b"\t"), "tsv", "table"),
    "page.html": (HTML, "html", "section"),
    "garden.xml": (XML, "xml", "element"),
    "letter.eml": (MAIL, "eml", "paragraph"),
    "pixel.png": (png(), "png", "image"),
    "all.zip": (zipped({"docs/readme.txt": b"Water the northern bed daily", "data/config.json": b'{"agent": "gardener"}'}), "zip", "archive"),
    "all.tar.gz": (tarred({"metrics/status.csv": CSV}, True), "tar.gz", "archive"),
    "report.txt.gz": (gzipped("report.txt", b"seals are in the shed"), "gzip", "archive"),
    "brief.docx": (docx(), "docx", "section"),
    "deck.pptx": (pptx(), "pptx", "slide"),
    "book.xlsx": (xlsx(), "xlsx", "sheet"),
    "report.pdf": (pdf(), "pdf", "page"),
}
