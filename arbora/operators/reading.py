"""Reading nodes: windows of text, children, trails from the root."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_CHARS, MOST_CHARS = 4_000, 50_000


def window(offset: int, limit: int, default: int, most: int, what: str) -> int:
    """The limit to use; negative numbers and limits over the most are errors."""
    if offset < 0 or limit < 0:
        raise ValueError(f"{what} range must be non-negative")
    if limit > most:
        raise ValueError(f"{what} limit cannot exceed {most}")
    return limit or default


def find_node(nodes: DataFrame, node_id: str, artifact_id: str | None = None) -> DataFrame:
    found = nodes.filter(F.col("node_id") == node_id)
    return found if artifact_id is None else found.filter(F.col("artifact_id") == artifact_id)


def children(nodes: DataFrame) -> DataFrame:
    """``artifact_id, node_id, children``: the ids of each parent's children in order."""
    rows = nodes.filter("parent_id is not null").groupBy("artifact_id", F.col("parent_id").alias("node_id"))
    return rows.agg(F.array_sort(F.collect_list(F.struct("ordinal", F.col("node_id").alias("id")))).alias("c")).select("artifact_id", "node_id", F.col("c.id").alias("children"))


def read_node(nodes: DataFrame, node_id: str | None = None, offset: int = 0, limit: int = 0, artifact_id: str | None = None) -> DataFrame:
    """Windows of code points of one node's text, or of every node's, with ``more`` and the children's ids."""
    limit = window(offset, limit, DEFAULT_CHARS, MOST_CHARS, "node")
    rows = nodes if node_id is None else find_node(nodes, node_id, artifact_id)
    below = children(nodes if node_id is None else nodes.filter(F.col("parent_id") == node_id))
    at = F.least(F.lit(offset), F.char_length("text"))
    view = rows.join(below, ["artifact_id", "node_id"], "left")
    return view.select(
        "artifact_id",
        "node_id",
        "kind",
        "name",
        F.substring("text", offset + 1, limit).alias("text"),
        at.alias("offset"),
        (F.char_length("text") > offset + limit).alias("more"),
        "locator",
        "attributes",
        F.coalesce("children", F.array().cast("array<string>")).alias("children"),
    )


def breadcrumbs(nodes: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``artifact_id, node_id, trail`` from the root down, of the ids in ``wanted(artifact_id, node_id)`` or of all.

    A node's ancestors are the nodes at the prefixes of its path, so this is an equality join on (artifact, path).
    """
    rows = nodes if wanted is None else nodes.join(wanted.select("artifact_id", "node_id").distinct(), ["artifact_id", "node_id"], "left_semi")
    steps = rows.select("artifact_id", "node_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n))).alias("path"))
    above = nodes.select("artifact_id", "path", F.struct(F.size("path").alias("depth"), "node_id", "kind", "name").alias("crumb"))
    trails = steps.join(above, ["artifact_id", "path"]).groupBy("artifact_id", "node_id").agg(F.array_sort(F.collect_list("crumb")).alias("c"))
    return trails.select("artifact_id", "node_id", F.transform("c", lambda x: F.struct(x["node_id"].alias("node_id"), x["kind"].alias("kind"), x["name"].alias("name"))).alias("trail"))


def provenance(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """Locator and trail of each wanted node; a node that isn't there has no row."""
    return breadcrumbs(nodes, wanted).join(nodes.select("artifact_id", "node_id", "locator"), ["artifact_id", "node_id"]).select("artifact_id", "node_id", "locator", "trail")
