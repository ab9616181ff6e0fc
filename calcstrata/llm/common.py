"""What several operators share: stored tables, text rules, Arrow mapping."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tokens import forget_words

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
READER_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``; only a session without that
    setting (a local test) gets a folder of its own.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    known = getattr(spark, "_calcstrata_shared", None)
    if known is None:
        known = spark._calcstrata_shared = "file://" + tempfile.mkdtemp(prefix="calcstrata-")
    return known


def stored(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage.

    Lost executors cost at most the tasks of the stage that runs: later
    stages read replicated files.
    """
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of ``stored`` that no later plan reads."""
    for df in tables:
        at = spark._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def small(df: DataFrame, rows: int, most: int = 500_000) -> DataFrame:
    """A narrow table, broadcast if its counted rows are few; else Spark joins it by a shuffle."""
    return F.broadcast(df) if rows <= most else df


def sampled(df: DataFrame, most: int, *key: str) -> DataFrame:
    """Rows with distinct ``key``, all of them or about ``most``, taken by a 64-bit hash of the key."""
    n = df.agg(F.approx_count_distinct(F.xxhash64(*key), 0.02)).first()[0]
    if n > most:
        df = df.where(F.xxhash64(*key) < int(most / n * 2.0**64) - 2**63)
    return df.dropDuplicates(list(key))


def parts(spark: SparkSession) -> int:
    """The number of partitions for shuffles by a key."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def give_back() -> None:
    """Return freed memory to the machine; a Python worker is used again by later tasks and else keeps it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def then_give_back(run: Callable, keep_words: bool = False) -> Callable:
    """A partition function that gives memory back at its end.

    Unless it keeps them, the words that earlier tasks left in this worker go
    before it starts: a later stage does not carry the packing's vocabulary.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_words and forget_words():
            give_back()
        yield from run(batches)
        give_back()

    return wrapped


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """Apply a function to each Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(then_give_back(run), schema)


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, and hand them small batches."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment
    paths = [x for x in known.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        known["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if int(spark.conf.get(BATCH_ROWS, "10000")) > 2000:  # whole texts: smaller batches bound the memory of tasks
        spark.conf.set(BATCH_ROWS, "2000")


def small_batches(spark: SparkSession, most_bytes: int = 1 << 20, reader_rows: int = 1024) -> None:
    """Bound Arrow batches by bytes too, and rows that Parquet's reader holds: texts are long, and a batch's words take ten times its bytes in Python."""
    spark.conf.set(BATCH_BYTES, str(most_bytes))
    spark.conf.set(READER_ROWS, str(min(reader_rows, int(spark.conf.get(READER_ROWS)))))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_remainder(by: int):
    """crc32 of the id's decimal text, modulo ``by``; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % by
