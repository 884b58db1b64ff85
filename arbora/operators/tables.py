"""Tables in trees: choosing one, its header and windows of its rows, wide views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .reading import window

DEFAULT_ROWS, MOST_ROWS = 50, 500


def select_table(nodes: DataFrame, selector: str = "") -> DataFrame:
    """One table for each artifact: the one with that id, the first on the sheet with that id, or the first of that name in any case; without a selector the first of all."""
    tables = nodes.filter("kind = 'table'")
    if not selector:
        ranked = tables.withColumn("_rank", F.lit(2))
    else:
        sheet = nodes.filter((F.col("kind") == "sheet") & (F.col("node_id") == selector)).select("artifact_id", F.col("node_id").alias("parent_id"))
        ranked = (
            tables.filter(F.col("node_id") == selector)
            .withColumn("_rank", F.lit(0))
            .unionByName(tables.join(sheet, ["artifact_id", "parent_id"], "left_semi").withColumn("_rank", F.lit(1)))
            .unionByName(tables.filter(F.lower("name") == selector.lower()).withColumn("_rank", F.lit(2)))
        )
    best = F.row_number().over(W.partitionBy("artifact_id").orderBy("_rank", "path"))
    return ranked.withColumn("_n", best).filter("_n = 1").drop("_n", "_rank")


def table_cells(nodes: DataFrame, tables: DataFrame) -> DataFrame:
    """Cells of the given tables: ``artifact_id, table_id, row, position, node_id, cell, value, locator, attributes``; row 0 is the header."""
    rows = nodes.filter("kind = 'row'").join(tables.select("artifact_id", F.col("node_id").alias("parent_id")), ["artifact_id", "parent_id"])
    rows = rows.select("artifact_id", F.col("parent_id").alias("table_id"), F.col("node_id").alias("parent_id"), F.col("ordinal").alias("row"))
    cells = nodes.filter("kind = 'cell'")
    return cells.join(rows, ["artifact_id", "parent_id"]).select("artifact_id", "table_id", "row", F.col("ordinal").alias("position"), "node_id", F.col("name").alias("cell"), F.col("text").alias("value"), "locator", "attributes")


def extract_table(nodes: DataFrame, selector: str = "", offset: int = 0, limit: int = 0) -> DataFrame:
    """One row for each artifact's chosen table: header cells, a window of data rows, ``offset``, ``total_rows`` without the header, ``more``."""
    limit = window(offset, limit, DEFAULT_ROWS, MOST_ROWS, "table")
    tables = select_table(nodes, selector)
    body = nodes.filter("kind = 'row'").join(tables.select("artifact_id", F.col("node_id").alias("parent_id")), ["artifact_id", "parent_id"])
    totals = body.groupBy("artifact_id", F.col("parent_id").alias("table_id")).agg((F.count(F.lit(1)) - 1).cast("int").alias("total_rows"))
    cells = table_cells(nodes, tables).filter((F.col("row") == 0) | F.col("row").between(offset + 1, offset + limit))
    # maps can't be sorted, so cells are ordered by their place and looked up after
    cell = F.struct("position", "node_id", "cell", "value", "locator", F.map_entries("attributes").alias("attributes"))
    rows = cells.groupBy("artifact_id", "table_id", "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    grouped = rows.groupBy("artifact_id", "table_id").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    out = tables.select("artifact_id", F.col("node_id").alias("table_id"), "name", "locator").join(totals, ["artifact_id", "table_id"], "left").join(grouped, ["artifact_id", "table_id"], "left")
    every = F.coalesce("rows", F.array())
    total = F.greatest(F.coalesce("total_rows", F.lit(0)), F.lit(0))
    return out.select(
        "artifact_id",
        "table_id",
        "name",
        "locator",
        F.filter(every, lambda r: r["row"] == 0)[0]["cells"].alias("columns"),
        F.transform(F.filter(every, lambda r: r["row"] > 0), lambda r: r["cells"]).alias("rows"),
        F.least(F.lit(offset), total).alias("offset"),
        total.alias("total_rows"),
        (total > offset + limit).alias("more"),
    )


def wide(nodes: DataFrame, selector: str = "", columns: list[str] | None = None) -> DataFrame:
    """Data rows with a column for each header cell, keyed by the letters of the cells so that sparse rows line up; ``columns`` names the letters to keep."""
    cells = table_cells(nodes, select_table(nodes, selector)).withColumn("letters", F.regexp_extract("cell", "^([A-Z]+)", 1))
    pivot = cells.groupBy("artifact_id", "table_id", "row").pivot("letters", columns) if columns else cells.groupBy("artifact_id", "table_id", "row").pivot("letters")
    return pivot.agg(F.first("value")).filter("row > 0")
