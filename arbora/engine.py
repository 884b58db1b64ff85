"""From sources to a corpus of four tables.

A scan of names and bytes is ranked by the detection expression, crosses into Python once to be parsed, and comes back as tagged
rows; identities, limits of the table view and everything asked of the trees are column expressions from there on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.formats.tree import Artifact, Source, finalised
from arbora.functions.detect import detections, media_type
from arbora.model import ERROR, LOCATOR, LimitError, Limits, identified
from arbora.registry import Registry
from arbora.ship import ship
from arbora.sources import files

ROW = f"tag string, artifact_id string, digest string, source_path string, name string, format string, media_type string, size bigint, metadata map<string,string>, error {ERROR}, path array<int>, kind string, parent_kind string, text string, level int, locator {LOCATOR}, attributes map<string,string>, uri string, code string, message string"
_NAMES = ["tag", "artifact_id", "digest", "source_path", "name", "format", "media_type", "size", "metadata", "error", "path", "kind", "parent_kind", "text", "level", "locator", "attributes", "uri", "code", "message"]
_STRINGS = pa.map_(pa.string(), pa.string())
_LOCATOR = pa.struct([("path", pa.string()), ("subpath", pa.string()), ("page", pa.int32()), ("slide", pa.int32()), ("sheet", pa.string()), ("cell", pa.string()), ("byte_range", pa.struct([("start", pa.int64()), ("end", pa.int64())]))])
_KINDS = {"size": pa.int64(), "metadata": _STRINGS, "error": pa.struct([("stage", pa.string()), ("message", pa.string()), ("limit", pa.string()), ("value", pa.int64()), ("max", pa.int64())]), "path": pa.list_(pa.int32()), "level": pa.int32(), "locator": _LOCATOR, "attributes": _STRINGS}
_SCHEMA = pa.schema([(n, _KINDS.get(n, pa.string())) for n in _NAMES])
#: Rows that a batch carries back at most.
BATCH = 4_000
#: Characters of rendered texts that a batch carries back at most, unless one text has more.
RENDERED = 4 << 20


def _map(value: dict[str, str] | None) -> list[tuple[str, str]]:
    return sorted((value or {}).items())


def _failure(stage: str, e: Exception) -> dict:
    limit = {"limit": e.limit, "value": e.value, "max": e.max} if isinstance(e, LimitError) else {}
    return {"stage": stage, "message": str(e) or type(e).__name__} | limit


def _rows(source: Source, native: list[tuple[int, str, str]], registry: Registry, limits: Limits) -> Iterator[dict]:
    digest = hashlib.sha256(source.data).hexdigest()
    base = {"artifact_id": f"sha256:{digest}", "digest": digest, "source_path": source.path}
    top = base | {"tag": "artifact", "name": source.name, "format": "", "media_type": source.media_type, "size": len(source.data), "metadata": []}
    ranked = registry.ranked(source, native)
    if not ranked:
        yield top | {"error": {"stage": "detect", "message": "unsupported artifact format"}}
        return
    try:
        made: Artifact = finalised(registry.parse(ranked[0][1], source, limits), limits)
    except Exception as e:  # noqa: BLE001  one bad file is a row, not the end of the job
        yield top | {"error": _failure("parse", e)}
        return
    yield top | {"name": made.root.name or source.name, "format": made.format, "media_type": made.media_type, "metadata": _map(made.metadata)}
    for path, parent, node in made.root.walk():
        yield base | {"tag": "node", "path": path, "kind": node.kind, "parent_kind": parent, "name": node.name, "text": node.text, "level": node.level, "locator": node.locator, "attributes": _map(node.attributes)}
    for r in made.resources:
        yield base | {"tag": "resource"} | r
    for w in made.warnings:
        yield base | {"tag": "warning"} | w


def _sources(batch: pa.RecordBatch) -> Iterator[tuple[Source, list[tuple[int, str, str]]]]:
    for i in range(batch.num_rows):
        name, path, media, data, found = (batch.column(c)[i].as_py() for c in range(5))
        yield Source(name, data, path, media), [(x["score"], x["parser"], x["reason"]) for x in found]


def _parse(registry: Registry, limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for batch in batches:
            for source, native in _sources(batch):
                for row in _rows(source, native, registry, limits):
                    waiting.append(row)
                    if len(waiting) >= BATCH:
                        yield pa.RecordBatch.from_pylist(waiting, _SCHEMA)
                        waiting = []
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, _SCHEMA)

    return run


def _render(registry: Registry, limits: Limits, render: Callable[[Artifact], str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: list[tuple[str, str, str]] = []
            size = 0
            for source, native in _sources(batch):
                ranked = registry.ranked(source, native)
                if not ranked:
                    continue
                try:
                    made = finalised(registry.parse(ranked[0][1], source, limits), limits)
                except Exception:  # noqa: BLE001  the artifact has the error
                    continue
                text = render(made)
                waiting.append((f"sha256:{made.digest}", source.path, text))
                size += len(text)
                if size >= RENDERED:
                    yield _texts(waiting)
                    waiting, size = [], 0
            if waiting:
                yield _texts(waiting)

    return run


def _texts(rows: list[tuple[str, str, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["artifact_id", "source_path", "rendered"])


class Corpus:
    """Artifacts, nodes, resources and warnings of some sources. Of equal bytes the tables of content show the first source's tree; ``artifacts`` shows every source."""

    def __init__(self, parsed: DataFrame, sources: DataFrame, limits: Limits, asked: DataFrame, registry: Registry) -> None:
        self.parsed, self.sources, self.limits, self.asked, self.registry = parsed, sources, limits, asked, registry

    @property
    def artifacts(self) -> DataFrame:
        return self.parsed.filter("tag = 'artifact'").select("artifact_id", "name", "source_path", "format", "media_type", "size", "digest", "metadata", "error")

    def _content(self, tag: str) -> DataFrame:
        """Rows of a tag without those of sources that repeat an earlier one's bytes; only the repeats are joined, so trees aren't shuffled while these are few."""
        sources = self.parsed.filter("tag = 'artifact' and error is null").select("artifact_id", "source_path")
        first = F.row_number().over(W.partitionBy("artifact_id").orderBy("source_path"))
        repeats = sources.withColumn("_n", first).filter("_n > 1").drop("_n")
        return self.parsed.filter(F.col("tag") == tag).join(repeats, ["artifact_id", "source_path"], "left_anti")

    @property
    def source_nodes(self) -> DataFrame:
        """Nodes of every source by its path, those of equal bytes once for each; one pass without a join, so nothing is parsed twice or shuffled."""
        return self.parsed.filter("tag = 'node'").select("artifact_id", "source_path", "path", "kind", "name", "text", "level", "locator", "attributes")

    def rendered(self, render: Callable[[Artifact], str]) -> DataFrame:
        """``artifact_id, source_path, rendered``: a text made of each source's whole tree where it is parsed, so no node leaves its
        task. Sources with an error have none. Parses again, kept rows or not."""
        return self.asked.mapInArrow(_render(self.registry, self.limits, render), "artifact_id string, source_path string, rendered string")

    @property
    def nodes(self) -> DataFrame:
        rows = identified(self._content("node"))
        return rows.select("artifact_id", "node_id", "parent_id", "path", "depth", "ordinal", "kind", "name", "text", "level", "locator", "attributes")

    @property
    def resources(self) -> DataFrame:
        return self._content("resource").select("artifact_id", "uri", "name", "media_type", "size", "locator")

    @property
    def warnings(self) -> DataFrame:
        return self._content("warning").select("artifact_id", "code", "message", "locator")

    @property
    def errors(self) -> DataFrame:
        return self.artifacts.filter("error is not null")

    def stats(self) -> DataFrame:
        """Sources kept for reading resources: their number, bytes, and the most that the limits would keep."""
        held = self.artifacts.join(self.resources.select("artifact_id").distinct(), "artifact_id", "left_semi").dropDuplicates(["artifact_id"])
        return held.agg(F.count(F.lit(1)).alias("artifacts"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).withColumn("max_bytes", F.lit(self.limits.max_stored_bytes))

    def unpersist(self) -> None:
        self.parsed.unpersist()

    def save(self, path: str) -> None:
        """Four Parquet tables, nodes clustered by artifact."""
        for name in ("artifacts", "resources", "warnings"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")
        self.nodes.repartition("artifact_id").sortWithinPartitions("artifact_id", "path").write.mode("overwrite").parquet(f"{path}/nodes")


class Engine:
    """Inspects sources. ``strict`` raises the first error of a call; otherwise errors are rows of ``artifacts``. ``persist`` keeps parsed
    rows on the executors until ``Corpus.unpersist``, for corpora of which much is asked; otherwise each question parses again what it needs."""

    def __init__(self, spark: SparkSession, limits: Limits | None = None, registry: Registry | None = None, strict: bool = False, persist: bool = False) -> None:
        self.spark, self.limits, self.registry, self.strict, self.persist = spark, limits or Limits(), registry or Registry(), strict, persist

    def formats(self) -> DataFrame:
        return self.spark.createDataFrame(self.registry.formats(), "name string, media_type string, extensions array<string>").orderBy("name")

    def inspect_path(self, path: str | list[str], recursive: bool = False) -> Corpus:
        """Files, folders or globs. Files over the limit are told by their length and never opened."""
        return self.inspect(files.binary_files(self.spark, path, recursive))

    def inspect_bytes(self, items: list[tuple[str, bytes]]) -> Corpus:
        return self.inspect(files.from_bytes(self.spark, items))

    def inspect_column(self, df: DataFrame, content: str, name, path=None) -> Corpus:
        """A column of texts or bytes as sources, named by an expression."""
        return self.inspect(files.from_column(df, content, name, path))

    def detect(self, sources: DataFrame) -> DataFrame:
        """All detections of each source by the expression, best first."""
        media = media_type(F.col("name"), F.col("content"))
        return sources.select("name", "source_path", F.explode(detections(F.col("name"), F.col("content"), media)).alias("d")).select("name", "source_path", "d.parser", "d.score", "d.reason")

    def inspect(self, sources: DataFrame) -> Corpus:
        """``sources(name, source_path, length, content)`` as a corpus."""
        ship(self.spark)
        most = self.limits.max_input_bytes
        fitting = sources.filter(F.col("length") <= most)
        media = media_type(F.col("name"), F.col("content"))
        asked = fitting.select("name", "source_path", media.alias("media"), "content").withColumn("found", detections(F.col("name"), F.col("content"), F.col("media")))
        parsed = asked.mapInArrow(_parse(self.registry, self.limits), ROW)
        error = F.struct(F.lit("read").alias("stage"), F.concat(F.lit("input bytes: "), F.col("length").cast("string"), F.lit(f" exceeds {most}")).alias("message"), F.lit("input bytes").alias("limit"), F.col("length").alias("value"), F.lit(most).cast("bigint").alias("max"))
        large = sources.filter(F.col("length") > most).select(F.lit("artifact").alias("tag"), "source_path", "name", F.col("length").alias("size"), error.alias("error"))
        all_rows = parsed.unionByName(large, allowMissingColumns=True)
        if self.persist:
            all_rows = all_rows.persist(StorageLevel.MEMORY_AND_DISK)
        out = Corpus(all_rows, sources, self.limits, asked, self.registry)
        if self.strict and (bad := out.errors.select("name", "error").head()):
            e = bad.error
            raise LimitError(e.limit, e.value, e.max) if e.limit else ValueError(f"{bad.name}: {e.message}")
        return out


def first_seen(artifacts: DataFrame, order: list[str]) -> DataFrame:
    """Of equal artifact ids the one that came first."""
    return artifacts.withColumn("_n", F.row_number().over(W.partitionBy("artifact_id").orderBy(*order))).filter("_n = 1").drop("_n")
