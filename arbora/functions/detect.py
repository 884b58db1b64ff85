"""Format detection as one ranked expression.

Each probe is a column that gives a score and a reason; the best score wins, an earlier probe on a tie. There is no falling back:
if the winner can't parse, the artifact has an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import SPACE, extension

#: Name, media type and extensions of each format, by name.
FORMATS = [
    ("csv", "text/csv", [".csv"]),
    ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document", [".docx"]),
    ("eml", "message/rfc822", [".eml"]),
    ("gif", "image/gif", [".gif"]),
    ("gzip", "application/gzip", [".gz"]),
    ("html", "text/html", [".html", ".htm"]),
    ("jpeg", "image/jpeg", [".jpg", ".jpeg"]),
    ("json", "application/json", [".json"]),
    ("markdown", "text/markdown", [".md", ".markdown"]),
    ("pdf", "application/pdf", [".pdf"]),
    ("png", "image/png", [".png"]),
    ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation", [".pptx"]),
    ("tar", "application/x-tar", [".tar"]),
    ("tar.gz", "application/gzip", [".tar.gz", ".tgz"]),
    ("text", "text/plain", [".txt", ".text", ".log"]),
    ("toml", "application/toml", [".toml"]),
    ("tsv", "text/tab-separated-values", [".tsv"]),
    ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", [".xlsx"]),
    ("xml", "application/xml", [".xml"]),
    ("yaml", "application/yaml", [".yaml", ".yml"]),
    ("zip", "application/zip", [".zip"]),
]
#: The order in which parsers are asked, which decides ties.
ORDER = ["config", "json", "delimited", "html", "xml", "email", "image", "ooxml", "pdf", "archive", "text"]


def formats(spark: SparkSession) -> DataFrame:
    """The catalog of formats."""
    return spark.createDataFrame(FORMATS, "name string, media_type string, extensions array<string>").orderBy("name")


def media_type(name: Column, content: Column) -> Column:
    """By extension, else by the first bytes, without parameters."""
    table = {e: m for n, m, es in FORMATS for e in es if n != "tar.gz"} | {".tgz": "application/gzip"}
    known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[extension(name)]
    magic = F.hex(F.substring(content, 1, 8))
    html = F.lower(F.regexp_replace(F.substring(content, 1, 64).cast("string"), f"^{SPACE}+", ""))
    nul = F.instr(F.hex(F.substring(content, 1, 512)), "00") % 2 == 1
    sniffed = (
        F.when(magic.startswith("89504E470D0A1A0A"), "image/png")
        .when(magic.startswith("FFD8FF"), "image/jpeg")
        .when(magic.startswith("474946383761") | magic.startswith("474946383961"), "image/gif")
        .when(magic.startswith("255044462D"), "application/pdf")
        .when(magic.startswith("504B0304"), "application/zip")
        .when(magic.startswith("1F8B08"), "application/x-gzip")
        .when(html.startswith("<!doctype html") | html.startswith("<html"), "text/html")
        .when(html.startswith("<?xml"), "text/xml")
        .when(nul, "application/octet-stream")
        .otherwise("text/plain")
    )
    return F.coalesce(known, sniffed)


def _score(*cases: tuple[Column, int, str]) -> Column:
    out = None
    for test, score, reason in cases:
        value = F.struct(F.lit(score).alias("score"), F.lit(reason).alias("reason"))
        out = F.when(test, value) if out is None else out.when(test, value)
    return out


def probes(name: Column, content: Column, media: Column, text: Column | None = None, package: Column | None = None) -> dict[str, Column]:
    """A struct of score and reason for each parser, null where it sees nothing.

    ``text`` is the content as a string where it is known to be one (a text column); then nothing is decoded. ``package`` names the
    Office main part that a ZIP directory holds (``word``, ``ppt``, ``xl`` or null), as only a reader of the directory can tell.
    """
    ext = extension(name)
    body = F.decode(content, "ISO-8859-1") if text is None else text
    # what follows leading blanks, without a copy of the whole
    head = F.regexp_extract(body, f"(?s)^{SPACE}*+(.{{0,16}})", 1)
    start = F.lower(head)
    json = F.substring(head, 1, 1).isin("{", "[") & F.try_parse_json(F.when(F.is_valid_utf8(content), content.cast("string")) if text is None else text).isNotNull()
    first = F.substring(body, 1, 4096)
    magic = F.hex(F.substring(content, 1, 8))
    utf8 = (F.lit(True) if text is not None else F.is_valid_utf8(content)) & (F.instr(body, "\0") == 0)
    comma = F.call_function("locate", F.lit(","), body, F.call_function("locate", F.lit(","), body) + 1)
    delimited = F.contains(body, F.lit("\n")) & F.contains(body, F.lit(",")) & (comma > 0)
    office = package if package is not None else F.lit(None).cast("string")
    pk = magic.startswith("504B") & (F.octet_length(content) >= 4)
    return {
        "config": _score((ext.isin(".yaml", ".yml"), 100, "YAML extension"), (ext == ".toml", 100, "TOML extension")),
        "json": _score((json, 100, "valid JSON object or array"), (ext == ".json", 70, "JSON extension")),
        "delimited": _score((ext == ".csv", 90, "CSV extension"), (ext == ".tsv", 90, "TSV extension"), (delimited, 35, "repeated delimiters across lines")),
        "html": _score((start.startswith("<!doctype html") | start.startswith("<html"), 100, "HTML document signature"), (ext.isin(".html", ".htm"), 90, "HTML extension")),
        "xml": _score((F.substring(head, 1, 5) == "<?xml", 100, "XML declaration"), (ext == ".xml", 85, "XML extension")),
        "email": _score((ext == ".eml", 95, "EML extension"), (F.contains(F.lower(first), F.lit("from:")) & F.contains(F.lower(first), F.lit("subject:")) & F.contains(first, F.lit("\n\n")), 70, "RFC 5322 headers")),
        "image": _score((magic.startswith("89504E470D0A1A0A"), 100, "PNG signature"), (magic.startswith("FFD8FF"), 100, "JPEG signature"), (magic.startswith("474946383761") | magic.startswith("474946383961"), 100, "GIF signature")),
        "ooxml": _score((pk & (office == "word"), 100, "WordprocessingML package"), (pk & (office == "ppt"), 100, "PresentationML package"), (pk & (office == "xl"), 100, "SpreadsheetML package"), (pk & ext.isin(".docx", ".pptx", ".xlsx"), 98, "OOXML extension")),
        "pdf": _score((magic.startswith("255044462D"), 100, "PDF header"), (ext == ".pdf", 80, "PDF extension")),
        "archive": _score((magic.substr(1, 8).isin("504B0304", "504B0506", "504B0708"), 95, "ZIP signature"), (magic.startswith("1F8B"), 95, "GZIP signature"), (F.hex(F.substring(content, 258, 5)) == "7573746172", 95, "TAR ustar signature")),
        "text": F.when(
            utf8,
            _score(
                (ext.isin(".md", ".markdown"), 85, "markdown extension and valid UTF-8"),
                (ext.isin(".txt", ".text", ".log"), 75, "text extension and valid UTF-8"),
                (media.startswith("text/"), 45, "text media type"),
                (F.octet_length(content) > 0, 20, "valid UTF-8 fallback"),
                (F.lit(True), 10, "empty text input"),
            ),
        ),
    }


def detections(name: Column, content: Column, media: Column, extra: dict[str, Column] | None = None, order: list[str] | None = None, **known: Column) -> Column:
    """All probes that see something, best first: an array of structs ``score, rank, parser, reason``.

    ``extra`` adds probes by name, each a struct of score and reason; ``order`` lists all names in registration order.
    """
    found = probes(name, content, media, **known) | (extra or {})
    names = order or [*ORDER, *(extra or {})]
    if len(set(names)) != len(names) or not all(names):
        raise ValueError("parser names must be unique and not empty")
    rows = [F.when(found[p]["score"] > 0, F.struct(F.least(found[p]["score"], F.lit(100)).alias("score"), F.lit(-i).alias("rank"), F.lit(p).alias("parser"), found[p]["reason"].alias("reason"))) for i, p in enumerate(names)]
    return F.sort_array(F.array_compact(F.array(*rows)), asc=False)
