"""Readers, without Spark."""

from __future__ import annotations

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import samples
from arbora.formats import containers, delimited, mail, markup, office, pdf, pictures, plain, structured
from arbora.formats.tree import Source, cell_name, finalised
from arbora.model import LimitError, Limits
from arbora.registry import READERS

L = Limits()


def nodes(artifact):
    return {"/".join(map(str, p)): n for p, _, n in artifact.root.walk()}


def test_markdown_sections_hold_their_paragraphs():
    a = plain.read(Source("pump.md", samples.MARKDOWN), L)
    assert [(n.name, n.level) for n in a.root.children] == [("Water pump", 1), ("Cause", 2), ("Next", 2)]
    para = a.root.children[0].children[0]
    assert para.text == "Stopped at noon.\nBack by two."
    span = para.locator["byte_range"]
    assert samples.MARKDOWN[span["start"] : span["end"]].decode() == para.text
    assert a.metadata == {"encoding": "utf-8", "title": "Water pump"}


def test_text_drops_carriage_returns_but_counts_them():
    a = plain.read(Source("n.txt", b"one\ntwo\r\n\r\nthree\n"), L)
    assert [(n.text, n.locator["byte_range"]) for n in a.root.children] == [("one\ntwo", {"start": 0, "end": 8}), ("three", {"start": 11, "end": 16})]


@pytest.mark.parametrize(("line", "found"), [("# a", (1, "a")), ("  ###### b ##", (6, "b")), ("#", None), ("#x", None), ("####### y", None), ("\t## c", (2, "c"))])
def test_headings(line, found):
    kids = plain.read(Source("h.md", line.encode()), L).root.children
    assert [(k.level, k.name) for k in kids if k.kind == "section"] == ([found] if found else [])


def test_json_pointers_are_escaped_and_keys_sorted():
    a = structured.read_json(Source("x.json", b'{"b": [1.0, 1e3, 12345678901234567890123456], "a/b": {"~key": [null, true]}, "b2": "s", "dup": 1, "dup": 2}'), L)
    by = {n.locator["path"]: n for n in nodes(a).values() if n.kind == "value"}
    assert by["/a~1b/~0key/1"].text == "true"
    assert [by[f"/b/{i}"].text for i in range(3)] == ["1.0", "1e3", "12345678901234567890123456"]
    assert by["/dup"].text == "2"
    assert [f.name for f in a.root.children[0].children] == ["a/b", "b", "b2", "dup"]


@pytest.mark.parametrize("bad", [b"{} {}", b"[1,]", b"{} x", b"NaN", b""])
def test_json_errors(bad):
    with pytest.raises(ValueError, match="parse JSON"):
        structured.read_json(Source("x.json", bad), L)


def test_json_depth():
    with pytest.raises(LimitError, match="nesting depth"):
        structured.read_json(Source("x.json", b"[[[1]]]"), Limits(max_nesting_depth=2))


def test_yaml_keeps_order_places_and_types():
    a = structured.read_yaml(Source("s.yaml", b"z: yes\na: [1, 0x1F, 1.5, .inf, ~, 2024-05-01]\nm: &m {k: true}\nn: *m\n"), L)
    top = a.root.children[0]
    assert [f.name for f in top.children] == ["z", "a", "m", "n"]
    assert top.children[0].children[0].attributes == {"type": "string", "line": "1", "column": "4"}
    assert [v.attributes["type"] for v in top.children[1].children[0].children] == ["number"] * 4 + ["null", "timestamp"]
    assert top.children[3].children[0].children[0].children[0].text == "true"


def test_yaml_documents_cycles_duplicates():
    assert [c.name for c in structured.read_yaml(Source("s.yaml", b"a: 1\n---\nb: 2\n"), L).root.children] == ["documents"]
    assert structured.read_yaml(Source("s.yaml", b""), L).root.children[0].text == "null"
    for bad, why in ((b"&a [*a]", "cyclic"), (b"a: 1\na: 2", "duplicate"), (b"? [x]\n: 1", "scalars")):
        with pytest.raises(ValueError, match=why):
            structured.read_yaml(Source("s.yaml", bad), L)


def test_toml_goes_through_json():
    a = structured.read_toml(Source("b.toml", samples.TOML), L)
    by = {n.locator["path"]: n.text for n in nodes(a).values() if n.kind == "value"}
    assert by == {"/title": "beds", "/agent/name": "gardener", "/agent/enabled": "true", "/agent/ratio": "1", "/agent/since": "2024-05-01T10:00:00Z", "/limits/wait": "1000"}
    assert [structured.go_float(x) for x in (1e21, 1e-7, 0.5, 123456789.0, -0.0, 1.25e-10)] == ["1e+21", "1e-7", "0.5", "123456789", "-0", "1.25e-10"]
    with pytest.raises(ValueError, match="TOML"):
        structured.read_toml(Source("b.toml", b"x = inf"), L)


def test_csv_ranges_and_names():
    data = b'a,"b,\r\nc"\r\n\r\nd,"e""f",g\r\n'
    a = delimited.read(Source("t.csv", data), L)
    rows = a.root.children[0].children
    assert [[c.text for c in r.children] for r in rows] == [["a", "b,\nc"], ["d", 'e"f', "g"]]
    assert rows[1].children[1].name == "B2"
    assert [r.locator["byte_range"] for r in rows] == [{"start": 0, "end": 11}, {"start": 11, "end": 25}]
    assert a.metadata == {"rows": "2"}
    assert cell_name(27, 3) == "AA3"


@pytest.mark.parametrize("bad", [b'a,"b', b'a,b"c\n', b'"a"b,c\n'])
def test_csv_quotes_are_strict(bad):
    with pytest.raises(ValueError, match="parse CSV"):
        delimited.read(Source("t.csv", bad), L)


def test_csv_node_limit():
    with pytest.raises(LimitError):
        delimited.read(Source("t.csv", samples.CSV), Limits(max_nodes=4))


def test_html_tree():
    a = markup.read_html(Source("p.html", samples.HTML), L)
    kinds = [(n.kind, n.name or n.text) for n in a.root.children]
    assert kinds == [("section", "Beds & paths"), ("paragraph", "Dig deep now."), ("table", ""), ("link", "More"), ("image", "A bed"), ("paragraph", "one"), ("paragraph", "two")]
    table = a.root.children[2]
    assert [[c.text for c in r.children] for r in table.children] == [["Bed", "Depth"], ["north", "12"]]
    assert table.children[1].children[0].locator == {"path": "/html[1]/body[1]/table[1]/tbody[1]/tr[2]/td[1]", "cell": "A2"}
    assert a.root.children[-1].locator["path"] == "/html[1]/body[1]/ul[1]/li[2]"
    assert a.metadata == {"title": "Garden notes"}
    assert not any("secret" in n.text for n in nodes(a).values())


def test_html_keeps_its_oddities():
    a = markup.read_html(Source("p.html", b"<div>lost<h2>T <a href=x>in</a></h2></div><p></p>"), L)
    assert [(n.kind, n.name) for n in a.root.children] == [("section", "T in"), ("link", "in")]


def test_xml_paths_and_chunks():
    a = markup.read_xml(Source("g.xml", samples.XML), L)
    top = a.root.children[0]
    assert top.attributes == {"x": "u", "size": "2"}
    assert [c.locator["path"] for c in top.children] == ["/garden[1]/bed[1]", "/garden[1]/bed[2]"]
    assert top.children[0].text == "tall grass"
    for bad in (b"<a><b></a>", b"", b"<a>", b'<?xml version="1.0" encoding="latin1"?><a/>', b'<!DOCTYPE a [<!ENTITY e "x">]><a>&e;</a>'):
        with pytest.raises(ValueError, match="parse XML"):
            markup.read_xml(Source("g.xml", bad), L)


def test_mail():
    a = mail.read(Source("l.eml", samples.MAIL), L)
    assert a.metadata["subject"] == "Grüße"
    assert [(n.kind, n.text or n.name) for n in a.root.children] == [("paragraph", "soil is wet"), ("attachment", "beds.json")]
    assert a.resources[0]["locator"] == {"path": "attachment/1/beds.json"}
    assert mail.attachment(samples.MAIL, 1, L) == b'{"a": 1}'
    with pytest.raises(ValueError, match="headers"):
        mail.read(Source("l.eml", b"no headers here"), L)


def test_pictures():
    a = pictures.read(Source("p.png", samples.png()), L)
    assert a.metadata == {"width": "2", "height": "3"}
    assert pictures.header(b"GIF89a\x05\0\x06\0\0\0\0")[:3] == ("gif", 5, 6)
    assert pictures.header(b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x0b\x08\0\x07\0\x09\3")[:3] == ("jpeg", 9, 7)


def test_archives_and_hostile_ones():
    z = containers.read(Source("a.zip", samples.FILES["all.zip"][0]), L)
    assert [r["name"] for r in z.resources] == ["docs/readme.txt", "data/config.json"]
    assert z.root.children[0].attributes == {"entries": "2", "expanded_size": "49"}
    t = containers.read(Source("a.tar", samples.tarred({"x.csv": b"a"}, link="l")), L)
    assert [n.attributes.get("type") for n in t.root.children[0].children] == [None, "link"]
    assert t.root.children[0].children[0].attributes["mode"] == "0600"
    assert [w["code"] for w in t.warnings] == ["archive_link_skipped"]
    g = containers.read(Source("r.gz", samples.FILES["report.txt.gz"][0]), L)
    assert g.root.children[0].children[0].attributes == {"size": "21", "modified": "2023-11-14T22:13:20Z"}
    big = samples.zipped({"a": b"0" * 100_000})
    for data, limits, why in ((samples.zipped({"../x": b"a"}), L, "unsafe"), (samples.zipped({"a": b"", "b": b""}), Limits(max_archive_entries=1), "entries"), (big, Limits(max_compression_ratio=5), "ratio"), (samples.zipped({"f/../s": b"", "s": b""}), L, "duplicate"), (big, Limits(max_expanded_bytes=10), "expanded")):
        with pytest.raises(ValueError, match=why):
            containers.read(Source("a.zip", data), limits)


@pytest.mark.parametrize("bad", ["", "/a", "c:/x", "..", "a/../..", "a\0b", "\\\\x"])
def test_unsafe_paths(bad):
    with pytest.raises(ValueError, match="unsafe"):
        containers.clean_path(bad)


def test_encrypted_entry_is_told():
    data = bytearray(samples.zipped({"a.txt": b"x"}))
    data[data.index(b"PK\1\2") + 8] |= 1
    a = containers.read(Source("a.zip", bytes(data)), L)
    assert [w["code"] for w in a.warnings] == ["encrypted_entry_skipped"]


def test_docx():
    a = office.read(Source("b.docx", samples.docx()), L)
    top = a.root.children
    assert [(n.kind, n.name or n.text, n.level) for n in top] == [("section", "Beds", 1), ("paragraph", "See here", 0), ("table", "Table 1", 0), ("section", "Header", 2)]
    assert top[1].locator == {"path": "word/document.xml", "subpath": "/document/paragraph[3]"}
    assert top[1].attributes == {"links": "https://example.com/x"}
    assert top[2].children[1].children[1].locator["cell"] == "B2"
    assert a.metadata == {"title": "Plan", "creator": "Ann", "parts": "2"}
    assert [r["media_type"] for r in a.resources] == ["image/png"]


def test_pptx():
    slide = office.read(Source("d.pptx", samples.pptx()), L).root.children[0]
    assert slide.name == "Spring"
    assert slide.children[-1].name == "Speaker notes"
    assert slide.children[-1].children[0].text == "Bring gloves"
    assert slide.children[2].children[1].children[1].locator == {"path": "ppt/slides/slide1.xml", "slide": 1, "subpath": "/slide/table[1]/row[2]/cell[2]", "cell": "B2"}
    assert [office.part_number(x) for x in ("ppt/slide2.xml", "slide10.xml", "slide.xml")] == [2, 10, 0]


def test_xlsx():
    a = office.read(Source("b.xlsx", samples.xlsx()), L)
    table = a.root.children[0].children[0]
    cells = {c.name: c for r in table.children for c in r.children}
    assert {k: c.text for k, c in cells.items()} == {"A1": "Bed", "B1": "open", "A2": "1", "B2": "true", "C2": "3"}
    assert cells["C2"].attributes == {"formula": "SUM(A2:A2)"}
    assert cells["A1"].attributes == {"type": "s", "hyperlink": "https://example.com/"}
    assert table.attributes == {"merged_ranges": "C3:D3"}
    assert a.metadata == {"sheets": "1", "date_system": "1900"}


@pytest.mark.parametrize(("style", "level"), [("Heading1", 1), ("heading 9", 9), ("Title", 1), ("Heading", 0), ("Heading10", 0), ("Normal", 0), ("Title2", 2)])
def test_heading_styles(style, level):
    assert office.heading_level(style) == level


def test_pdf():
    a = pdf.read(Source("r.pdf", samples.pdf()), L)
    assert a.metadata == {"pages": "1"}
    assert a.root.children[0].text == "Order new seals"
    assert [w["code"] for w in pdf.read(Source("r.pdf", samples.pdf("")), L).warnings] == ["pdf_page_has_no_text"]
    with pytest.raises(ValueError, match="PDF"):
        pdf.read(Source("r.pdf", b"%PDF-1.4"), L)


def test_text_limit():
    with pytest.raises(LimitError, match="text bytes"):
        finalised(plain.read(Source("a.txt", b"abcd"), L), Limits(max_text_bytes=3))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.sampled_from(["a.json", "a.yaml", "a.toml", "a.csv", "a.html", "a.xml", "a.eml", "a.pdf", "a.md", "a.zip"]))
def test_readers_only_raise_value_errors(data, name):
    for reader in READERS.values():
        for raw in (data, b"PK\3\4" + data, b"\x1f\x8b" + data, b"%PDF-1.4 1 0 obj" + data, b"<html>" + data):
            try:
                reader(Source(name, raw), L)
            except (ValueError, KeyError, UnicodeError, zipfile.BadZipFile, IndexError, RecursionError, OverflowError):
                pass
            except Exception as e:  # noqa: BLE001
                assert type(e).__module__ in ("struct", "yaml.reader", "binascii"), repr(e)


def test_zip_sample_is_a_zip():
    assert zipfile.is_zipfile(io.BytesIO(samples.docx()))


def test_windows_of_resources_inflate_no_further():
    from arbora.formats import containers
    from arbora.model import LimitError, Limits

    import samples

    body = bytes(i * 7 % 251 for i in range(200_000))
    held = {
        "zip": (samples.zipped({"a.bin": b"x", "b.bin": body}), "b.bin"),
        "tar": (samples.tarred({"a.bin": b"x", "b.bin": body}), "b.bin"),
        "tar.gz": (samples.tarred({"a.bin": b"x", "b.bin": body}, True), "b.bin"),
        "gzip": (samples.gzipped("b.bin", body), "b.bin"),
    }
    loose = Limits(max_compression_ratio=10_000)
    for kind, (data, path) in held.items():
        for offset, limit in ((0, 10), (70_000, 100_000), (199_990, 50), (199_999, 1), (0, 200_000)):
            found, end = containers.ranged(kind, data, path, len(body), offset, limit, loose)
            assert found == body[offset : offset + limit]
            assert end == (offset + limit >= len(body))
        assert containers.ranged(kind, data, path, len(body), 200_000, 5, loose) == (b"", True)
        with pytest.raises(ValueError, match="ended before|exceeds"):
            containers.ranged(kind, data, path, len(body) + 9, 199_990, 50, loose)
        if kind != "gzip":
            with pytest.raises(KeyError):
                containers.ranged(kind, data, "c.bin", 5, 0, 5, loose)
    data, path = held["gzip"]
    assert containers.ranged("gzip", data[:-40], path, len(body), 5, 20, loose)[0] == body[5:25]  # the cut end isn't reached
    with pytest.raises(LimitError):
        containers.ranged("gzip", data, path, len(body), 50, 100, Limits(max_expanded_bytes=100))


def test_both_yaml_loaders_find_the_same_nodes():
    import yaml

    texts = ["key: 1\nbrand: 'B#1'\nflags: [yes, ~, true]\nbase:\n  a/b: 1994-01-05\n  size: 7\n", "- a\n-\n- {b: }\n", "a:\n", "{0x1<<: }", "- # c\n  x: 1.5e3\n", "# only\n", "", "a: 'it''s'\nb: \"q\n  r\"\n", "a:\tb", "a: é\n", "--- \na\n--- \nb\n", "x: &a [1]\ny: *a\n", "a: [b\n", "a: 1\na: 2\n"]
    found = []
    for fast in (structured._Fast, None):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(structured, "_Fast", fast)
            found.append([])
            for t in texts:
                try:
                    found[-1].append(repr(structured.read_yaml(Source("a.yaml", t.encode()), L).root))
                except ValueError as e:
                    found[-1].append(str(e))
    assert found[0] == found[1]
    if structured._Fast:  # the plain case composes no Python events
        with pytest.MonkeyPatch.context() as m:
            m.setattr(yaml.SafeLoader, "__init__", None)
            assert structured.read_yaml(Source("a.yaml", texts[0].encode()), L).root.children


def test_yaml_of_very_many_levels_is_an_error():
    for text in ("[\n" * 4000 + "]\n" * 4000, "- " * 2000 + "a", "{a: \n" * 4000 + "b" + "}\n" * 4000):
        with pytest.raises((ValueError, RecursionError)):
            structured.read_yaml(Source("a.yaml", text.encode()), L)
