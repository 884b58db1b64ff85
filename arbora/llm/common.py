"""What several operators of this subpackage share: code shipping, staged tables, skew-safe ranking, bounded broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from arbora.ship import ship as _ship

__all__ = ["BROADCAST_ROWS", "free", "hot", "joined", "pieces", "ranked", "shared_dir", "ship", "small", "staged", "unit"]

#: Rows that a table may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 10_000
#: Bytes of an Arrow batch at most, unless a row has more; sessions that ask for less keep that.
BATCH_BYTES = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: A key with more than this part of a table's rows is hot; so there are fewer hot keys than this.
PARTS = 256
#: Rows of a hot key that a task gets at least.
DEAL = 64


def ship(spark: SparkSession) -> None:
    """Give the executors this package, and bound Arrow batches in the session: a batch is in the JVM and in Python at once, in each task."""
    _ship(spark)
    held = spark.conf.get(_BATCH_BYTES, None)
    if held is None or held.removesuffix("b").lstrip("-").isdigit() and not 0 < int(held.removesuffix("b")) <= BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one on a local master; an error on a cluster, whose machines would not share it."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not getattr(sc, "_arbora_dir", None):
        sc._arbora_dir = tempfile.mkdtemp(prefix="arbora-shared-")
        atexit.register(shutil.rmtree, sc._arbora_dir, True)
    return sc._arbora_dir


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here, and a lost executor costs nothing already written."""
    path = f"{shared_dir(df.sparkSession)}/arbora-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast if it has at most ``most`` rows, by counting no further than that; else leave the join to shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def hot(counts: DataFrame, on: list[str], n: str = "n", total: int | None = None, parts: int = PARTS) -> list[tuple]:
    """Keys of ``counts`` (a row for each, ``n`` its rows) with more than 1/``parts`` of all rows (and ``DEAL`` of them), each with the number of tasks to deal it to.

    There are fewer than ``parts`` of them and their tasks are fewer than twice ``parts``, whatever the table's size.
    """
    total = (counts.agg(F.sum(n)).first()[0] or 0) if total is None else total
    most = max(DEAL, total // parts + 1)
    return [(*r[:-1], -(-r[-1] // most)) for r in counts.filter(F.col(n) > most).select(*on, n).collect()]


def joined(left: DataFrame, right: DataFrame, on: list[str], by: str, keys: list[tuple], how: str = "inner") -> DataFrame:
    """``left`` joined with ``right``, which has a row for each key, on columns without nulls. Rows of the hot ``keys`` are dealt to several tasks by a hash of ``by``, and their rows of ``right`` copied to each."""
    if not keys:
        return left.join(right, on, how)
    salt, tasks = free("_salt", left, right), free("_tasks", left, right)
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    table = F.broadcast(left.sparkSession.createDataFrame(keys, ", ".join(f"`{c}` {kinds[c]}" for c in on) + f", {tasks} int"))
    dealt = F.when(F.col(tasks).isNotNull(), F.pmod(F.hash(F.lit(7), by), F.col(tasks))).otherwise(0)
    many = left.join(table, on, "left").withColumn(salt, dealt).drop(tasks)
    copies = right.join(table, on, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(tasks, F.lit(1)) - 1))).drop(tasks)
    return many.join(copies, [*on, salt], how).drop(salt)


def free(name: str, *frames: DataFrame) -> str:
    """A column name that no frame has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unit(*columns: Column) -> Column:
    """A uniform double in [0, 1) from a hash of the columns: the top 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") * F.lit(2.0**-53)


def ranked(df: DataFrame, group: list[str], spot: str, order: list[str], buckets: int, name: str) -> DataFrame:
    """``df`` with ``name``, the rank from 0 of each row in its group by ``spot`` (a double in [0, 1)) and then ``order``.

    A group is not sorted in one task: its rows fall into ``buckets`` ranges of ``spot``; each range is ranked by itself and
    starts at the number of rows in the ranges before it. Group columns hold no nulls. Both are functions of the data alone, so a recomputed task agrees.
    """
    b, before = "_bucket", "_before"
    df = df.withColumn(b, F.floor(F.col(spot) * buckets).cast("int"))
    counts = df.groupBy(*group, b).agg(F.count(F.lit(1)).alias("_n"))
    running = W.partitionBy(*group).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*group, b, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias(before))
    joined = df.join(counts, [*group, b])
    local = F.row_number().over(W.partitionBy(*group, b).orderBy(spot, *order)) - 1
    return joined.withColumn(name, F.col(before) + local).drop(b, before)


def pieces(batch: pa.RecordBatch, text: int, limit: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes in its text column, so that vectors over bytes stay small; a longer text comes alone."""
    column = batch.column(text)
    lengths = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
