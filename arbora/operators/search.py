"""Ranked search: all tokens must occur; repetition and a name that equals a token count more."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.functions.text import SPACE, squeezed, trimmed

DEFAULT_LIMIT = 20
SNIPPET = 220


def haystack(name: Column, text: Column, attributes: Column | None) -> Column:
    """Name, text, and keys and values in the order of the keys, lower-cased."""
    parts = [F.coalesce(name, F.lit("")), F.coalesce(text, F.lit(""))]
    if attributes is not None:
        pairs = F.transform(F.array_sort(F.map_entries(attributes)), lambda e: F.concat(F.lit(" "), e["key"], F.lit(" "), e["value"]))
        parts[1] = F.concat(parts[1], F.coalesce(F.array_join(pairs, ""), F.lit("")))
    return F.lower(trimmed(F.concat(parts[0], F.lit(" "), parts[1])))


def occurrences(hay: Column, token: str) -> Column:
    """How often a token occurs, without overlap."""
    return F.floor((F.char_length(hay) - F.char_length(F.replace(hay, F.lit(token), F.lit("")))) / F.lit(len(token))).cast("int")


def snippet(text: Column, name: Column) -> Column:
    """The text, or the name if that is blank, on one line; what is over 220 characters becomes three dots.

    No more than the first 221 visible characters are looked at, which are enough to tell.
    """
    head = lambda c: F.regexp_extract(F.coalesce(c, F.lit("")), f"^{SPACE}*+((?:{SPACE}*+[^{SPACE[1:-1]}]){{0,{SNIPPET + 1}}})", 1)
    cut = lambda v: F.when(F.char_length(v) <= SNIPPET, v).otherwise(F.concat(F.substring(v, 1, SNIPPET - 3), F.lit("...")))
    # arrays of one give a value a name, so that it is worked out once
    chosen = F.transform(F.array(head(text)), lambda t: F.when(t != "", t).otherwise(head(name)))
    return F.transform(F.transform(chosen, squeezed), cut)[0]


def may_hold(text: Column, name: Column, query: str) -> Column:
    """Whether a paragraph of a text, or a node with that name alone, can hold every token: a test to make before the text is cut up."""
    every = lambda c: reduce(lambda a, b: a & b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(t)) for t in dict.fromkeys(query.lower().split())], F.lit(True))
    return every(text) | every(name)


def matches(nodes: DataFrame, query: str) -> DataFrame:
    """The nodes that hold every token of the query, with ``score``."""
    tokens = query.lower().split()
    with_map = "attributes" in nodes.columns
    hay = haystack(F.col("name"), F.col("text"), F.col("attributes") if with_map else None)
    rows = nodes.withColumn("_hay", hay)
    # cheap tests first: they decide before anything is counted
    rows = rows.filter(reduce(lambda a, b: a & b, [F.contains(F.col("_hay"), F.lit(t)) for t in dict.fromkeys(tokens)]))
    name = F.lower(trimmed(F.coalesce(F.col("name"), F.lit(""))))
    score = reduce(lambda a, b: a + b, [F.lit(10) + occurrences(F.col("_hay"), t) + F.when(name == t, 20).otherwise(0) for t in tokens])
    return rows.withColumn("score", score.cast("int")).drop("_hay")


def find(nodes: DataFrame, query: str, limit: int = DEFAULT_LIMIT, per: str | None = None) -> DataFrame:
    """The best nodes by score and then id: ``limit`` of all, or of each ``per``. A negative limit means 20; 0 or a blank query finds nothing."""
    limit = DEFAULT_LIMIT if limit < 0 else limit
    shape = nodes.select(*nodes.columns, F.lit(0).alias("score")) if not query.split() or not limit else matches(nodes, query)
    found = shape.select(*dict.fromkeys(["artifact_id", *([per] if per else [])]), "node_id", "kind", "name", snippet(F.col("text"), F.col("name")).alias("snippet"), "score", *(["locator"] if "locator" in nodes.columns else []))
    if not query.split() or not limit:
        return found.limit(0)
    best = [F.desc("score"), F.asc("node_id")]
    if per:
        return found.withColumn("_n", F.row_number().over(W.partitionBy(per).orderBy(*best))).filter(F.col("_n") <= limit).drop("_n")
    return found.orderBy(*best).limit(limit)
