"""Facts of files as they arrive: an extension beyond the operators of a repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scalars as S
from ..parsers import registry

_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, folder: str, lateness: str = "1 hour") -> DataFrame:
    """New files of a folder; a content that comes again within the lateness is dropped."""
    raw = spark.readStream.format("binaryFile").schema(_FILES).option("recursiveFileLookup", "true").load(folder)
    rows = raw.select("path", "modificationTime", S.sha256_hex(F.col("content")).alias("blob_hash"), F.col("content").cast("string").alias("text"))
    rows = rows.withColumn("file_type", S.type_at_diff(F.col("path"))).where(S.can_parse(F.col("file_type")))
    return rows.withWatermark("modificationTime", lateness).dropDuplicatesWithinWatermark(["blob_hash", "file_type"])


def facts_stream(spark: SparkSession, folder: str, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append the facts of arriving files to a Parquet folder."""

    def batch(df: DataFrame, number: int) -> None:
        registry.facts_of(df).write.mode("append").parquet(output)

    writer = arriving(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "10 minutes", lateness: str = "30 minutes") -> DataFrame:
    """Tumbling counts and sums of a stream or table of events; later rows than the lateness are left out of a stream."""
    rows = events.withWatermark(time, lateness) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", key, "n", "total")
