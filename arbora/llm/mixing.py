"""Mixing sources to target weights by Poisson replication.

A source with ``n`` rows and target share ``w`` gets the mean repetition rate ``total * w / n``. Each document inverts the Poisson
distribution of its source's rate at a uniform number hashed from the seed and the document, so its count of copies is a function
of the data alone; it is exploded by that count, and the copies are shuffled globally by another seeded hash.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, ship, small, unit

SEED = 977
#: Without explicit weights a source's share goes with its rows to this power: 1 keeps the mixture, 0 makes sources equal.
ALPHA = 0.5


def graded(source: Column) -> Column:
    """The target weights that the registered query and the pipeline mix to: 1, 2, 3 or 4 by the CRC of a source's name; a null one has 1."""
    return F.coalesce(F.crc32(source.cast("binary")) % 4, F.lit(0)) + 1


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= k) for k = 0, 1, ... until it is 1 in doubles; terms come from logarithms, so a large rate doesn't underflow."""
    if rate <= 0:
        return [1.0]
    most = int(rate + 12 * math.sqrt(rate) + 40)
    k = np.arange(most + 1)
    logs = k * math.log(rate) - rate - np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, most + 1)))))
    out = np.minimum(np.cumsum(np.exp(logs)), 1.0)
    out[-1] = 1.0
    return out.tolist()


def _tables(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"stratum": f["stratum"], "rate": f["rate"], "cdf": [poisson_cdf(x) for x in f["rate"]]})


def stratum(source: str):
    """A source's name, never null: null is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


Weights = dict[str | None, float] | Callable[[Column], Column] | None


def rates(docs: DataFrame, weights: Weights = None, alpha: float = ALPHA, size: float | None = None, source: str = "source") -> DataFrame:
    """``stratum, rate, cdf`` of each source. ``weights`` are given by name, or as an expression over the source; they need not add up
    to 1, and a source without one, or with none above 0, gets no copies. ``size``: rows wanted, by default as many as there are."""
    sizes = docs.groupBy(stratum(source).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col(source).cast("string")).alias("name"))
    rows = sizes.agg(F.sum("n")).first()[0] or 0
    if weights is None:
        sizes = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(alpha))))
    elif callable(weights):
        sizes = sizes.withColumn("w", F.greatest(F.coalesce(weights(F.col("name")).cast("double"), F.lit(0.0)), F.lit(0.0)))
    else:
        given = docs.sparkSession.createDataFrame([("" if k is None else f"={k}", max(float(v), 0.0)) for k, v in weights.items()], "stratum string, w double")
        sizes = sizes.join(given, "stratum")
    n, w = float(rows if size is None else size), float(sizes.agg(F.sum("w")).first()[0] or 0)
    return sizes.select("stratum", (F.lit(n) * F.col("w") / F.lit(w or 1.0) / F.col("n")).alias("rate")).mapInPandas(_tables, "stratum string, rate double, cdf array<double>")


def inverted(cdf: str, u: str) -> Column:
    """How many entries of the ascending array ``cdf``, whose last is above ``u``, are not above it: by halving."""
    middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")

    def halve(s: Column, _: Column) -> Column:
        above = F.get(F.col(cdf), middle(s)) > F.col(u)
        return F.struct(F.when(above, s["low"]).otherwise(middle(s) + 1).alias("low"), F.when(above, middle(s)).otherwise(s["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cdf) + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), (F.size(cdf) - 1).alias("high")), halve)["low"]


def mixed(docs: DataFrame, weights: Weights = None, alpha: float = ALPHA, size: float | None = None, seed: int = SEED, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of ``docs`` for each copy, then ``copy`` (from 1), ``rate`` and ``mix_key``, in the order of ``mix_key``.

    New columns get underscores where ``docs`` has their names. Rows that are alike in id and text get the same count. A null
    source is a source; an empty table stays empty. The table of rates is broadcast up to 10,000 sources; beyond that it is joined
    by shuffle, where adaptive execution splits a hot source.
    """
    ship(docs.sparkSession)
    s, u, cdf = (free(x, docs) for x in ("stratum", "_u", "_cdf"))
    copy, rate, order = (free(x, docs) for x in ("copy", "rate", "mix_key"))
    table = small(rates(docs, weights, alpha, size, source)).select(F.col("stratum").alias(s), F.col("rate").alias(rate), F.col("cdf").alias(cdf))
    what = [F.col(key), F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))]
    out = docs.withColumn(s, stratum(source)).withColumn(u, unit(F.lit(seed), *what)).join(table, s)
    out = out.withColumn(copy, inverted(cdf, u)).filter(F.col(copy) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copy))))
    out = out.withColumn(order, F.xxhash64(F.lit(seed + 1), *what, F.col(copy)))
    return out.select(*docs.columns, copy, rate, order).orderBy(order, key, copy)
