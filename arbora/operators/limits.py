"""Limits as predicates over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.model import Limits


def audit(nodes: DataFrame, limits: Limits, by: str = "artifact_id") -> DataFrame:
    """``by, nodes, text_bytes, depth`` and the first limit that each artifact goes over, if any."""
    facts = nodes.groupBy(by).agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.octet_length("text")).cast("bigint").alias("text_bytes"), F.max("depth").alias("depth"))
    over = F.when(F.col("nodes") > limits.max_nodes, "nodes").when(F.col("text_bytes") > limits.max_text_bytes, "text bytes").when(F.col("depth") > limits.max_nesting_depth, "nesting depth")
    return facts.withColumn("limit", over)
