"""Files as they arrive: a stream of sources, parsed without state, appended to a corpus of Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbora.engine import Engine

#: What Spark's binary file source gives; a stream must be told.
BINARY = "path string, modificationTime timestamp, length bigint, content binary"


def source_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """``name, source_path, length, content, arrived`` of new files below a folder."""
    df = spark.readStream.schema(BINARY).format("binaryFile").option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").load(folder)
    name = F.url_decode(F.replace(F.regexp_extract("path", "([^/]*)$", 1), F.lit("+"), F.lit("%2B")))
    return df.select(name.alias("name"), F.col("path").alias("source_path"), "length", "content", F.col("modificationTime").alias("arrived"))


def distinct_sources(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Equal bytes once within the delay; state is one digest for each source of that time."""
    keyed = stream.withColumn("artifact_id", F.concat(F.lit("sha256:"), F.sha2("content", 256)))
    return keyed.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["artifact_id"])


def ingest(engine: Engine, folder: str, target: str, checkpoint: str, once: bool = True, delay: str = "1 day") -> StreamingQuery:
    """Parse what arrives and append it to ``target``'s four tables. A batch that is run again overwrites its own folder, so nothing doubles."""

    def append(batch: DataFrame, number: int) -> None:
        corpus = engine.inspect(batch.select("name", "source_path", "length", "content"))
        for name in ("artifacts", "nodes", "resources", "warnings"):
            getattr(corpus, name).write.mode("overwrite").parquet(f"{target}/{name}/batch={number}")
        corpus.unpersist()

    stream = distinct_sources(source_stream(engine.spark, folder), delay)
    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
