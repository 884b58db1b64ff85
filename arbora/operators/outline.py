"""Summaries: counts, and the first entries of an outline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Kinds that an outline shows, and how many entries.
OUTLINE = ["section", "page", "slide", "sheet", "table", "attachment"]
MOST = 200


def outline(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """The first ``most`` outline nodes of each artifact in document order."""
    rows = nodes.filter(F.col("kind").isin(OUTLINE))
    return rows.withColumn("_n", F.row_number().over(W.partitionBy("artifact_id").orderBy("path"))).filter(F.col("_n") <= most).withColumnRenamed("_n", "position")


def summarize(nodes: DataFrame, resources: DataFrame | None = None, warnings: DataFrame | None = None) -> DataFrame:
    """``artifact_id, node_count, resource_count, warnings, outline`` of each artifact."""
    out = nodes.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("node_count"))
    entry = F.struct("position", "node_id", "kind", "name", "level", "locator")
    items = outline(nodes).groupBy("artifact_id").agg(F.array_sort(F.collect_list(entry)).alias("outline"))
    out = out.join(items, "artifact_id", "left")
    if resources is not None:
        out = out.join(resources.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("resource_count")), "artifact_id", "left").fillna(0, ["resource_count"])
    if warnings is not None:
        out = out.join(warnings.groupBy("artifact_id").agg(F.collect_list(F.struct("code", "message", "locator")).alias("warnings")), "artifact_id", "left")
    return out
