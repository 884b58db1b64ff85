"""Resources: listing, ranged reads of a container's entries, recursive inspection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.engine import Corpus, Engine
from arbora.formats import containers
from arbora.model import LimitError, Limits, uri_digest


def resources(corpus: Corpus, artifact_id: str | None = None) -> DataFrame:
    found = corpus.resources
    return found if artifact_id is None else found.filter(F.col("artifact_id") == artifact_id)


def _wanted(corpus: Corpus, uris: list[str] | None) -> DataFrame:
    """Resources with the bytes of the source that holds them."""
    rows = corpus.resources if uris is None else corpus.resources.filter(F.col("uri").isin(uris))
    held = corpus.artifacts.filter("error is null").groupBy("artifact_id").agg(F.min("source_path").alias("source_path"), F.min("format").alias("format"))
    sources = corpus.sources.select(F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("artifact_id"), "content").dropDuplicates(["artifact_id"])
    return rows.join(held, "artifact_id").join(sources, "artifact_id").select("uri", "name", "media_type", "size", "format", F.col("locator.path").alias("path"), "content")


def _reader(offset: int, limit: int, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out = {"uri": row["uri"], "name": row["name"], "media_type": row["media_type"], "size": row["size"], "offset": offset, "data": None, "eof": None, "error": None}
                try:
                    out["data"], out["eof"] = containers.ranged(row["format"], row["content"], row["path"], row["size"], offset, limit or row["size"], limits)
                except Exception as e:  # noqa: BLE001  a bad entry is a row
                    out["error"] = str(e) or type(e).__name__
                yield pa.RecordBatch.from_pylist([out], _CONTENT)

    return run


_CONTENT = pa.schema([("uri", pa.string()), ("name", pa.string()), ("media_type", pa.string()), ("size", pa.int64()), ("offset", pa.int64()), ("data", pa.binary()), ("eof", pa.bool_()), ("error", pa.string())])
_SPARK = "uri string, name string, media_type string, size bigint, offset bigint, data binary, eof boolean, error string"


def read_resource(corpus: Corpus, uri: str, offset: int = 0, limit: int = 0) -> DataFrame:
    """A window of an entry's bytes; no limit means the most that may be read at once."""
    most = corpus.limits.max_resource_read_bytes
    if offset < 0:
        raise ValueError("resource offset must be non-negative")
    if not 0 <= limit <= most:
        raise ValueError(f"resource read limit must be between 1 and {most}")
    if not corpus.parsed.sparkSession.range(1).select(uri_digest(F.lit(uri)).isNotNull().alias("ok")).head().ok:
        raise ValueError(f'invalid resource URI "{uri}"')
    return _wanted(corpus, [uri]).mapInArrow(_reader(offset, limit or most, corpus.limits), _SPARK)


def read_all(corpus: Corpus, uris: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """Whole entries, as far as their declared size allows; larger ones have an error."""
    most = corpus.limits.max_input_bytes if max_bytes is None else max_bytes
    if most <= 0:
        raise ValueError("resource inspection limit must be positive")
    rows = _wanted(corpus, uris)
    large = rows.filter(F.col("size") > most).select("uri", "name", "media_type", "size", F.lit(0).cast("bigint").alias("offset"), F.concat(F.lit("input bytes: "), F.col("size").cast("string"), F.lit(f" exceeds {most}")).alias("error"))
    return rows.filter(F.col("size") <= most).mapInArrow(_reader(0, 0, corpus.limits), _SPARK).unionByName(large, allowMissingColumns=True)


def inspect_resources(engine: Engine, corpus: Corpus, uris: list[str] | None = None, depth: int = 1) -> Corpus:
    """What is inside: entries become sources named after themselves and pathed by their URI, ``depth`` levels down, no deeper than the archive limit."""
    if depth > engine.limits.max_archive_depth:
        raise LimitError("archive depth", depth, engine.limits.max_archive_depth)
    levels: list[Corpus] = []
    for level in range(depth):
        content = read_all(corpus, uris if level == 0 else None).filter("error is null")
        sources = content.select("name", F.col("uri").alias("source_path"), F.octet_length("data").cast("bigint").alias("length"), F.col("data").alias("content"))
        corpus = engine.inspect(sources)
        levels.append(corpus)
        if level + 1 < depth and corpus.resources.isEmpty():
            break
    union = lambda frames: reduce(DataFrame.unionByName, frames)
    return Corpus(union([c.parsed for c in levels]), union([c.sources for c in levels]), engine.limits, union([c.asked for c in levels]), engine.registry)


def content_view(content: DataFrame) -> DataFrame:
    """Text where the media type is textual and the bytes are UTF-8, else base64."""
    media = F.coalesce("media_type", F.lit(""))
    textual = (media.startswith("text/") | media.isin("application/json", "application/xml", "application/yaml", "application/toml", "message/rfc822")) & F.is_valid_utf8("data")
    return content.select("*", F.when(textual, F.col("data").cast("string")).alias("text"), F.when(~textual, F.base64("data")).alias("base64"))
