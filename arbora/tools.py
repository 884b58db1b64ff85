"""The nine tools of an agent as plain functions over one service; results are JSON-ready."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from arbora.engine import Corpus, Engine
from arbora.model import Limits
from arbora.operators import extract_table, find, provenance, read_node, summarize
from arbora.operators import resources as res
from arbora.registry import Registry
from arbora.sources.files import Roots


class Service:
    """Inspected documents by artifact id, the least recently used forgotten over the limits of number and of stored bytes; equal bytes stay as first seen."""

    def __init__(self, spark: SparkSession, roots: list[str] | None = None, limits: Limits | None = None, registry: Registry | None = None, most: int | None = None) -> None:
        self.engine = Engine(spark, limits, registry, strict=True, persist=True)
        self.roots = Roots(roots)
        self.most = most or self.engine.limits.max_stored_artifacts
        self.documents: OrderedDict[str, Corpus] = OrderedDict()
        #: Bytes of the documents that hold resources, which are kept to be read again.
        self.stored: dict[str, int] = {}

    def _keep(self, corpus: Corpus) -> str:
        top = corpus.artifacts.head()
        key = top.artifact_id
        if key in self.documents:
            corpus.unpersist()
        else:
            self.documents[key] = corpus
            self.stored[key] = 0 if corpus.resources.isEmpty() else top.size
            while len(self.documents) > 1 and (len(self.documents) > self.most or sum(self.stored.values()) > self.engine.limits.max_stored_bytes):
                oldest, gone = self.documents.popitem(last=False)
                del self.stored[oldest]
                gone.unpersist()
        self.documents.move_to_end(key)
        return key

    def _resolve(self, reference: str) -> tuple[str, Corpus]:
        if reference not in self.documents:
            if reference.startswith("sha256:"):
                raise KeyError(f"artifact {reference} not found")
            reference = self._keep(self.engine.inspect_path(self.roots.secure(reference)))
        self.documents.move_to_end(reference)
        return reference, self.documents[reference]

    def _summary(self, key: str) -> dict:
        c = self.documents[key]
        row = summarize(c.nodes, c.resources, c.warnings).head().asDict(True)
        return c.artifacts.head().asDict(True) | row

    def artifact_inspect(self, path: str) -> dict:
        return self._summary(self._keep(self.engine.inspect_path(self.roots.secure(path))))

    def artifact_inspect_resource(self, uri: str) -> dict:
        owner, _ = self._owner(uri)
        return self._summary(self._keep(res.inspect_resources(self.engine, self.documents[owner], [uri])))

    def _owner(self, uri: str) -> tuple[str, Corpus]:
        key = f"sha256:{uri.removeprefix('artifact://')[:64]}"
        return self._resolve(key)

    def artifact_find(self, reference: str, query: str, limit: int = 20) -> list[dict]:
        key, c = self._resolve(reference)
        return [r.asDict(True) for r in find(c.nodes, query, limit).collect()]

    def artifact_read(self, reference: str = "", node_id: str = "", resource_uri: str = "", offset: int = 0, limit: int = 0) -> dict:
        """A node's text, or a resource's bytes as text or base64; exactly one of the two ids."""
        if bool(node_id) == bool(resource_uri):
            raise ValueError("exactly one of node_id and resource_uri is required")
        if node_id:
            row = read_node(self._resolve(reference)[1].nodes, node_id, offset, limit).head()
            if row is None:
                raise KeyError(f"node {node_id} not found")
            return row.asDict(True)
        row = res.content_view(res.read_resource(self._owner(resource_uri)[1], resource_uri, offset, limit)).head()
        if row is None or row.error:
            raise KeyError(f"resource {resource_uri}: {row.error if row else 'not found'}")
        return {k: v for k, v in row.asDict(True).items() if k not in ("data", "error") and v is not None}

    def artifact_extract_table(self, reference: str, selector: str = "", offset: int = 0, limit: int = 0) -> dict:
        row = extract_table(self._resolve(reference)[1].nodes, selector, offset, limit).head()
        if row is None:
            raise KeyError(f'table "{selector}" not found')
        return row.asDict(True)

    def artifact_list_attachments(self, reference: str) -> list[dict]:
        return [r.asDict(True) for r in self._resolve(reference)[1].resources.collect()]

    def artifact_list_files(self, directory: str = ".", recursive: bool = False, limit: int = 0) -> dict:
        return self.roots.list_files(directory, recursive, limit)

    def artifact_get_provenance(self, reference: str, node_id: str) -> dict:
        key, c = self._resolve(reference)
        row = provenance(c.nodes, c.nodes.filter(F.col("node_id") == node_id)).head()
        if row is None:
            raise KeyError(f"node {node_id} not found")
        return row.asDict(True)

    def artifact_formats(self) -> list[dict]:
        return [{"name": n, "media_type": m, "extensions": e} for n, m, e in self.engine.registry.formats()]

