"""Column functions, detection, registries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import samples
from arbora.engine import Engine
from arbora.formats.tree import Artifact, Node, cell_name, document
from arbora.functions import text
from arbora.functions.detect import formats
from arbora.registry import Registry
from arbora.sources.files import from_bytes


def one(spark, column):
    return spark.range(1).select(column.alias("c")).head().c


def test_letters_agree_with_the_reader(spark):
    numbers = [1, 26, 27, 52, 702, 703, 18278, 18279, 20000]
    df = spark.createDataFrame([(n,) for n in numbers], "n int").select(text.cell_name(F.col("n"), F.lit(3)).alias("c"))
    assert [r.c for r in df.collect()] == [cell_name(n, 3) for n in numbers]


def test_letters_of_columns_beyond_four_letters(spark):
    numbers = [475_254, 475_255, 1_200_000, 12_356_630, 12_356_631, 2**31 - 1, 2**53 + 1, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in [*numbers, 0, -1, None]], "n long").select(text.column_letters(F.col("n")).alias("c"))
    assert [r.c for r in df.collect()] == [*(cell_name(n, 3)[:-1] for n in numbers), "", "", ""]


@pytest.mark.parametrize(("given", "want"), [(" \t a b　\n", "a b"), ("", ""), (" ", "")])
def test_trim_is_unicode(spark, given, want):
    assert one(spark, text.trimmed(F.lit(given))) == want


def test_small_functions(spark):
    assert one(spark, text.squeezed(F.lit(" a   b\n\nc "))) == "a b c"
    assert one(spark, text.escape_pointer(F.lit("a/~b"))) == "a~1~0b"
    assert one(spark, text.extension(F.lit("x.TAR.Gz"))) == ".gz"
    assert one(spark, text.entry_media_type(F.lit("a/b.HTML"))) == "text/html"
    assert one(spark, text.entry_media_type(F.lit("b.zip"))) == ""
    assert [one(spark, text.part_number(F.lit(x))) for x in ("ppt/slide10.xml", "slide.xml", "slide1b.xml")] == [10, 0, 0]
    assert [one(spark, text.attachment_index(F.lit(x))) for x in ("attachment/3/a", "attachment/3", "entry/3/a")] == [3, 0, 0]
    assert one(spark, text.markdown_cell(F.lit("a|b\nc"))) == "a\\|b c"
    assert one(spark, text.ratio_exceeds(F.lit(100), F.lit(0), 50)) is True


CASES = [
    ("a.yaml", b"x", "config", 100),
    ("a", b' {"x": 1}', "json", 100),
    ("a.json", b"{", "json", 70),
    ("a.csv", b"", "delimited", 90),
    ("blob", b"\0,,\n", "delimited", 35),
    ("a", b"a,b,c\nd", "text", 45),
    ("a", b"  <!DOCTYPE HTML>", "html", 100),
    ("a", b"<?xml version='1.0'?><a/>", "xml", 100),
    ("a", b"From: x\nSubject: y\n\nz", "email", 70),
    ("a", b"From: x\r\nSubject: y\r\n\r\nz", "text", 45),
    ("a", samples.png(), "image", 100),
    ("a", b"%PDF-1.4", "pdf", 100),
    ("a", samples.tarred({"x": b"y"}), "archive", 95),
    ("a.md", b"x", "text", 85),
    ("a.log", b"x", "text", 75),
    ("a.png", b"x", "text", 20),
    ("", b"", "text", 45),
]


def test_detection_scores(spark):
    sources = from_bytes(spark, [(f"{i}/{n}" if n else str(i), d) for i, (n, d, _, _) in enumerate(CASES)])
    best: dict[int, tuple[int, str]] = {}
    for r in Engine(spark).detect(sources.withColumn("name", F.regexp_replace("name", "^[0-9]+/?", "")).withColumn("source_path", F.lit(""))).collect():
        best.setdefault(r.name, (r.score, r.parser))
    ranked = Engine(spark).detect(sources).collect()
    first: dict[str, tuple[str, int]] = {}
    for r in ranked:
        first.setdefault(r.name, (r.parser, r.score))
    for i, (name, _, parser, score) in enumerate(CASES):
        assert first[f"{i}/{name}" if name else str(i)] == (parser, score), name


def test_no_match_for_binary(spark):
    assert Engine(spark).detect(from_bytes(spark, [("a.bin", bytes([0, 1, 2, 3])), ("b", b"\xff")])).isEmpty()


def test_catalog(spark):
    rows = formats(spark).collect()
    assert len(rows) == 21
    assert [r.name for r in rows] == sorted(r.name for r in rows)


class Shout:
    name = "shout"
    formats = [("shout", "text/x-shout", [".shout"])]

    def probe(self, source):
        return (500, "loud") if source.extension == ".shout" else (0, "")

    def parse(self, source, limits):
        return Artifact(source, "shout", "text/x-shout", document(source, Node("paragraph", text=source.data.decode().upper())))


def test_own_parsers(spark):
    registry = Registry()
    registry.register(Shout())
    with pytest.raises(ValueError, match="already"):
        registry.register(Shout())
    c = Engine(spark, registry=registry).inspect_bytes([("a.shout", b"hey"), ("b.txt", b"calm")])
    assert {(r.format) for r in c.artifacts.collect()} == {"shout", "text"}
    assert "HEY" in {r.text for r in c.nodes.collect()}
    assert len(registry.formats()) == 22
    assert Registry(False).formats() == []


def test_ties_go_to_the_first(spark):
    # an Office package is a ZIP too; a JSON text in a .yaml file scores 100 twice
    c = Engine(spark).inspect_bytes([("a.yaml", b'{"x": 1}'), ("noext", samples.docx())])
    assert {r.format for r in c.artifacts.collect()} == {"yaml", "docx"}
