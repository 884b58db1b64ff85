"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within their source, a row's fractional rank is (rank + phase) / rows of its source with a seeded
phase for each source (else small sources of one size would stand in the same places), and the shards are equal cuts of the order by
fractional rank; so each shard holds each source in its share of the whole, give or take a row or so. The law is ``rows``: counts of shards are at most one apart. Only ids, sizes and hashes are shuffled, never texts; ranks
come from ``common.ranked``, which splits a hot source into hash ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, small, unit

SHARDS = 16
SEED = 20_240
#: Rows that one range of a rank should hold.
RANGE_ROWS = 20_000


def stratified_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text: str = "text", key: str = "doc_id", source: str = "source") -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of each row; ``slot`` counts from 0 in each shard, without gaps.

    A null source is a stratum of its own; a null text has size 1 and the CRC of no bytes. Repeated rows are ranked one after the
    other. Rows with equal text, id and source can trade places, which leaves the result as it is. Fewer rows than shards leave
    shards empty.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("")).alias("stratum"),
    ).withColumn("u", unit(F.lit(seed), "doc_id", "text_crc32", "size"))
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"))
    total = sizes.agg(F.sum("rows")).first()[0] or 0
    buckets = max(64, -(-total // RANGE_ROWS))
    tie = ["doc_id", "text_crc32", "size"]
    rows = ranked(rows, ["stratum"], "u", tie, buckets, "rank").join(small(sizes), "stratum")
    rows = rows.withColumn("at", (F.col("rank") + unit(F.lit(seed + 1), "stratum")) / F.col("rows")).withColumn("all", F.lit(0))
    rows = ranked(rows, ["all"], "at", ["u", "stratum", *tie], buckets, "place")
    # cut k begins at ceil(k * total / shards)
    shard = F.expr(f"(place * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return rows.withColumn("shard", shard.cast("int")).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "stratum", F.col("at").alias("fraction"))
