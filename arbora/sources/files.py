"""Sources: files by Spark's binary reader, bytes, columns; listings and sandboxes on the driver's disk."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = "name string, source_path string, length bigint, content binary"


def binary_files(spark: SparkSession, path: str | list[str], recursive: bool = False) -> DataFrame:
    """Names, paths, lengths and bytes; a filter on ``length`` reaches the scan, and bytes that nobody selects aren't read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return df.select(F.url_decode(F.replace(F.regexp_extract("path", "([^/]*)$", 1), F.lit("+"), F.lit("%2B"))).alias("name"), F.col("path").alias("source_path"), "length", "content")


def from_bytes(spark: SparkSession, items: list[tuple[str, bytes]]) -> DataFrame:
    """Named bytes; their paths are their places in the list."""
    return spark.createDataFrame([(n, f"bytes:{i:08d}", len(d), bytearray(d)) for i, (n, d) in enumerate(items)], COLUMNS)


def from_column(df: DataFrame, content: str, name: Column | str, path: Column | None = None) -> DataFrame:
    """Each row's text or bytes as a source; null is empty. Without a path, rows are numbered."""
    body = F.coalesce(F.col(content), F.lit("")).cast("binary") if dict(df.dtypes)[content] != "binary" else F.coalesce(F.col(content), F.lit("").cast("binary"))
    name = F.col(name) if isinstance(name, str) else name
    return df.select(name.alias("name"), (F.concat(F.lit("row:"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0")) if path is None else path).alias("source_path"), F.octet_length(body).cast("bigint").alias("length"), body.alias("content"))


#: Tasks that each core gets of rows that are dealt out.
DEAL = 4


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan with fewer partitions than would keep all cores busy, dealt out evenly: a small table is one split, but a file made of each row takes long to parse."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(DEAL * cores) if df.rdd.getNumPartitions() < DEAL * cores else df


class Roots:
    """The folders that paths may lie in; links are followed before that is decided."""

    def __init__(self, roots: list[str] | None = None) -> None:
        self.roots = []
        for root in roots or [os.getcwd()]:
            real = os.path.realpath(root, strict=True)
            if not os.path.isdir(real):
                raise ValueError(f'root "{root}" is not a directory')
            self.roots.append(real)

    def secure(self, path: str) -> str:
        """The real path, if it is in a root."""
        joined = path if os.path.isabs(path) else os.path.join(self.roots[0], path)
        real = os.path.realpath(joined, strict=True)
        if not any(os.path.commonpath((real, r)) == r for r in self.roots):
            raise PermissionError(f'path "{path}" is outside the allowed roots')
        return real

    def list_files(self, directory: str, recursive: bool = False, limit: int = 0) -> dict:
        """Regular files below a folder, links never followed; cut at the limit in walking order, then sorted by relative path."""
        top = self.secure(directory)
        if not os.path.isdir(top):
            raise NotADirectoryError(f'path "{directory}" is not a directory')
        limit = limit or 200
        if not 1 <= limit <= 2000:
            raise ValueError("file list limit must be between 1 and 2000")
        found: list[dict] = []
        truncated = False
        for entry in _walk(top, recursive):
            if len(found) == limit:
                truncated = True
                break
            found.append({"path": entry.path, "relative_path": os.path.relpath(entry.path, top), "size": entry.stat(follow_symlinks=False).st_size})
        return {"directory": top, "files": sorted(found, key=lambda f: f["relative_path"]), "truncated": truncated}


def _walk(folder: str, recursive: bool) -> Iterator[os.DirEntry]:
    with os.scandir(folder) as entries:
        ordered = sorted(entries, key=lambda e: os.fsencode(e.name))
    for entry in ordered:
        if entry.is_file(follow_symlinks=False):
            yield entry
        elif recursive and entry.is_dir(follow_symlinks=False):
            yield from _walk(entry.path, True)


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Paths and lengths of a whole store, as a table; no bytes are read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return df.select("path", "length")
