"""The document tree as flat tables: schemas, limits, identities.

A tree is one row for each node, keyed by artifact and ``path``, the child numbers from the root. Arrays of integers sort
lexicographically with prefixes first, so ``ORDER BY path`` is document order.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The kinds a node can have.
KINDS = ("document", "section", "paragraph", "table", "row", "cell", "slide", "page", "sheet", "image", "link", "attachment", "archive", "entry", "object", "array", "field", "value", "metadata", "element")

LOCATOR = "struct<path:string,subpath:string,page:int,slide:int,sheet:string,cell:string,byte_range:struct<start:bigint,end:bigint>>"
ERROR = "struct<stage:string,message:string,limit:string,value:bigint,max:bigint>"
ARTIFACTS = f"artifact_id string, name string, source_path string, format string, media_type string, size bigint, digest string, metadata map<string,string>, error {ERROR}"
NODES = f"artifact_id string, node_id string, parent_id string, path array<int>, depth int, ordinal int, kind string, name string, text string, level int, locator {LOCATOR}, attributes map<string,string>"
RESOURCES = f"artifact_id string, uri string, name string, media_type string, size bigint, locator {LOCATOR}"
WARNINGS = f"artifact_id string, code string, message string, locator {LOCATOR}"


class LimitError(ValueError):
    """An input went over one of the limits."""

    def __init__(self, limit: str, value: int, most: int) -> None:
        super().__init__(f"{limit}: {value} exceeds {most}")
        self.limit, self.value, self.max = limit, value, most

    def __reduce__(self):
        return LimitError, (self.limit, self.value, self.max)


@dataclass(frozen=True)
class Limits:
    """Bounds on one artifact. All must be positive."""

    max_input_bytes: int = 256 << 20
    max_text_bytes: int = 32 << 20
    max_nodes: int = 100_000
    max_nesting_depth: int = 256
    max_archive_depth: int = 4
    max_archive_entries: int = 10_000
    max_expanded_bytes: int = 512 << 20
    max_compression_ratio: float = 200
    max_stored_bytes: int = 512 << 20
    max_stored_artifacts: int = 128
    max_resource_read_bytes: int = 16 << 20

    def __post_init__(self) -> None:
        for f in fields(self):
            if getattr(self, f.name) <= 0:
                raise ValueError(f"{f.name} must be positive")


def path_string(path: Column) -> Column:
    """``root``, then a slash and a child number for each level."""
    return F.concat(F.lit("root"), F.array_join(F.transform(path, lambda i: F.concat(F.lit("/"), i.cast("string"))), ""))


def node_id(digest: Column, kind: Column, path: Column) -> Column:
    """``node_`` and the first 20 hex digits of SHA-256 over digest, kind and path string, NUL between them."""
    nul = F.lit("\0")
    return F.concat(F.lit("node_"), F.substring(F.sha2(F.concat(digest, nul, kind, nul, path_string(path)), 256), 1, 20))


def identified(nodes: DataFrame) -> DataFrame:
    """Add ``node_id``, ``parent_id``, ``depth`` and ``ordinal`` to nodes that carry ``digest``, ``path``, ``kind`` and ``parent_kind``: an id depends on nothing else, so no join is needed to know the parent's."""
    parent = F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0)))
    return nodes.select(
        "*",
        node_id(F.col("digest"), F.col("kind"), F.col("path")).alias("node_id"),
        F.when(F.size("path") > 0, node_id(F.col("digest"), F.col("parent_kind"), parent)).alias("parent_id"),
        F.size("path").alias("depth"),
        F.when(F.size("path") > 0, F.element_at("path", -1)).otherwise(0).alias("ordinal"),
    )


def escaped(value: Column) -> Column:
    """A URI path segment: letters, digits and ``-_.~$&+=:@`` stay, all else is percent-encoded."""
    out = F.replace(F.replace(F.url_encode(value), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))
    for c in "~$&+=:@":
        out = F.replace(out, F.lit(f"%{ord(c):02X}"), F.lit(c))
    return out


def resource_uri(digest: Column, kind: Column, logical_path: Column) -> Column:
    """``artifact://digest/kind/path``; a blank kind is ``resource``, its slashes become hyphens."""
    trimmed = F.trim(kind)
    kind = F.when(F.coalesce(trimmed, F.lit("")) == "", "resource").otherwise(F.replace(trimmed, F.lit("/"), F.lit("-")))
    return F.concat(F.lit("artifact://"), digest, F.lit("/"), kind, F.lit("/"), escaped(logical_path))


def uri_digest(uri: Column) -> Column:
    """The digest of a resource URI, null if it isn't one."""
    found = F.regexp_extract(uri, "^artifact://([0-9a-f]{64})(?:[/?#]|$)", 1)
    return F.when(found != "", found)


def locator_string(loc: Column) -> Column:
    """The parts that a locator has, joined by ``#``."""
    blank = lambda c: F.when(c != "", c)
    span = loc["byte_range"]
    return F.concat_ws(
        "#",
        blank(loc["path"]),
        blank(loc["subpath"]),
        F.when(loc["page"] > 0, F.concat(F.lit("page:"), loc["page"].cast("string"))),
        F.when(loc["slide"] > 0, F.concat(F.lit("slide:"), loc["slide"].cast("string"))),
        F.concat(F.lit("sheet:"), blank(loc["sheet"])),
        F.concat(F.lit("cell:"), blank(loc["cell"])),
        F.when(span.isNotNull(), F.concat(F.lit("bytes:"), span["start"].cast("string"), F.lit("-"), span["end"].cast("string"))),
    )


def is_zero(loc: Column) -> Column:
    """Whether a locator points nowhere."""
    return loc.isNull() | (locator_string(loc) == "")
