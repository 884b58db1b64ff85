"""Text columns: Unicode trimming, cell names, JSON pointers, media types, table cells of Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; ``trim`` strips only blanks.
SPACE = r"[\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def trimmed(value: Column) -> Column:
    return F.regexp_replace(value, f"^{SPACE}+|{SPACE}+$", "")


def squeezed(value: Column) -> Column:
    """Trimmed, each inner run of white space as one blank."""
    return F.regexp_replace(trimmed(value), f"{SPACE}+", " ")


def escape_pointer(value: Column) -> Column:
    """A JSON pointer segment."""
    return F.replace(F.replace(value, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def column_letters(number: Column) -> Column:
    """A, B, ..., Z, AA, ... of a column number from 1, with as many letters as it takes; nothing for other numbers."""
    n = number.cast("long")
    words = []
    for size in range(14, 0, -1):  # 14 letters hold every long
        before = sum(26**k for k in range(1, size))  # numbers with fewer letters
        words.append(F.when(n > before, F.lpad(F.conv((n - 1 - before).cast("string"), 10, 26), size, "0")))
    return F.translate(F.coalesce(*words, F.lit("")), "0123456789ABCDEFGHIJKLMNOP", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def cell_name(column: Column, row: Column) -> Column:
    return F.concat(column_letters(column), row.cast("string"))


def extension(name: Column) -> Column:
    """The lower-cased last ``.ext`` of a name, or nothing."""
    return F.lower(F.regexp_extract(name, r"(\.[^./]*)$", 1))


#: Media types of archive entries by extension.
ENTRY_MEDIA = {".csv": "text/csv", ".eml": "message/rfc822", ".gif": "image/gif", ".htm": "text/html", ".html": "text/html", ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".json": "application/json", ".md": "text/markdown", ".pdf": "application/pdf", ".png": "image/png", ".tsv": "text/tab-separated-values", ".txt": "text/plain", ".xml": "application/xml"}
#: Media types of parts of Office packages by extension.
PART_MEDIA = {".bin": "application/octet-stream", ".csv": "text/csv", ".emf": "image/emf", ".gif": "image/gif", ".jpeg": "image/jpeg", ".jpg": "image/jpeg", ".pdf": "application/pdf", ".png": "image/png", ".svg": "image/svg+xml", ".tif": "image/tiff", ".tiff": "image/tiff", ".wmf": "image/wmf", ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"}


def entry_media_type(name: Column) -> Column:
    pairs = [F.lit(x) for kv in ENTRY_MEDIA.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[extension(name)], F.lit(""))


def part_number(name: Column) -> Column:
    """The number in a part's base name, 0 if what follows its first digit isn't all digits."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.coalesce(F.regexp_extract(base, r"^[^0-9]*([0-9].*)$", 1).try_cast("int"), F.lit(0))


def attachment_index(path: Column) -> Column:
    """n of ``attachment/<n>/name``, else 0."""
    return F.coalesce(F.regexp_extract(path, r"^attachment/([+-]?[0-9]+)/", 1).try_cast("int"), F.lit(0))


def markdown_cell(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def ratio_exceeds(expanded: Column, compressed: Column, most: float) -> Column:
    return (expanded > 0) & (expanded / F.greatest(compressed, F.lit(1)) > most)
