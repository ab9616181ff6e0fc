"""Blobs by hash: 256 shards by the first two digits, and tiers by codec.

A write makes one folder with the shards that its blobs fall into, each sorted
by hash. Which folders and shards there are is known from the store's list, so
a look-up names the few folders that can hold its hashes, and Spark lists and
reads no others; inside them, minimum and maximum of each row group skip the
rest. The store itself is never shuffled for a look-up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .files import Files
from .manifest import Manifest

STORED = "blob_hash string, content binary, codec string, size_bytes bigint, stored_bytes bigint, tx string, shard string"
FOUND = "blob_hash string, content binary, size_bytes bigint"
#: Fixed value: blobs of this many bytes or more are stored in gzip, unless told otherwise.
COMPRESS_FROM = 200 * 1024 * 1024
#: Look-ups of at most so many hashes are pushed down to the files as values.
POINTS = 256
#: Narrow sides of at most so many rows are broadcast.
BROADCAST_ROWS = 500_000


def _each(batches: Iterator[pa.RecordBatch], convert) -> Iterator[pa.RecordBatch]:
    """One row a batch, so that a large blob is never held together with others."""
    for batch in batches:
        at = batch.schema.get_field_index("content")
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            yield row.set_column(at, "content", pa.array([convert(row.column(at)[0].as_py())], pa.binary()))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def convert(content: bytes) -> bytes:
        press = zlib.compressobj(6, zlib.DEFLATED, 31)
        return press.compress(content) + press.flush()

    return _each(batches, convert)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _each(batches, lambda content: zlib.decompress(content, 31))


class BlobStore:
    """``entries``: what the store holds, a list of {"tx": folder, "shards": [..], "packed": whether some are in gzip}; kept by the caller, in a manifest or in memory."""

    def __init__(self, spark: SparkSession, path: str, entries: list[dict] | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.entries = list(entries or [])

    def table(self, shards: list[str] | None = None) -> DataFrame:
        """The stored rows of these shards, or of all."""
        wanted = None if shards is None else set(shards)
        paths = [f"{self.path}/tx={e['tx']}/shard={s}" for e in self.entries for s in e["shards"] if wanted is None or s in wanted]
        if not paths:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).option("basePath", self.path).parquet(*paths)

    def hashes(self, shards: list[str] | None = None) -> DataFrame:
        return self.table(shards).select("blob_hash")

    @staticmethod
    def _by_shard(hashes: DataFrame) -> dict[str, int]:
        """How many of the hashes fall into each shard: at most 256 rows."""
        return {r["shard"]: r["n"] for r in hashes.groupBy(S.shard(F.col("blob_hash")).alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}

    def write(self, blobs: DataFrame, compress: bool | None = None, compress_from: int = COMPRESS_FROM) -> dict | None:
        """Store the blobs (blob_hash, content) that are not there yet; the entry that makes them visible, or None.

        Blobs of ``compress_from`` bytes or more are packed by gzip, all with
        ``compress`` True, none with False. The entry is added to ``entries``
        here and must be published by whoever keeps the list.
        """
        rows = blobs.select("blob_hash", "content")
        told = rows.groupBy(S.shard(F.col("blob_hash")).alias("shard")).agg(F.max(F.octet_length("content")).alias("most"), F.min(F.octet_length("content")).alias("least")).collect()  # at most 256 rows
        if not told:
            return None
        shards, most, least = sorted(r["shard"] for r in told), max(r["most"] for r in told), min(r["least"] for r in told)
        rows = rows.dropDuplicates(["blob_hash"]).join(self.hashes(shards), "blob_hash", "left_anti")
        rows = rows.select("blob_hash", "content", F.octet_length("content").cast("bigint").alias("size_bytes"))
        bound = compress_from if compress is None else 0 if compress else most + 1
        tiers = []  # a tier without blobs is not planned
        if least < bound:
            tiers.append(rows.where(F.col("size_bytes") < bound).withColumn("codec", F.lit("none")))
        if most >= bound:
            tiers.append(rows.where(F.col("size_bytes") >= bound).mapInArrow(packed, FOUND).withColumn("codec", F.lit("gzip")))
        both = tiers[0] if len(tiers) == 1 else tiers[0].unionByName(tiers[1])
        tx = Manifest.folder()
        out = both.select("blob_hash", "content", "codec", "size_bytes", F.octet_length("content").cast("bigint").alias("stored_bytes"), F.lit(tx).alias("tx"), S.shard(F.col("blob_hash")).alias("shard"))
        tasks = max(1, min(len(shards), int(self.spark.conf.get("spark.sql.shuffle.partitions", "200"))))
        # packed blobs gain nothing from the codec of the files
        out.repartition(tasks, "shard").sortWithinPartitions("shard", "blob_hash").write.mode("append").partitionBy("tx", "shard").parquet(self.path)
        there = Files(self.spark, f"{self.path}/tx={tx}").names()
        made = [s for s in shards if f"shard={s}" in there]
        if not made:
            return None
        entry = {"tx": tx, "shards": made, "packed": most >= bound}
        self.entries.append(entry)
        return entry

    def packed(self) -> bool:
        """Whether any blob may be stored in gzip."""
        return any(e.get("packed", True) for e in self.entries)

    def rows_of(self, hashes: DataFrame) -> DataFrame:
        """The stored rows with these hashes (blob_hash); malformed hashes are not there.

        Only folders that can hold them are read. A few hashes go into the
        scan as values; more meet it in a semi-join, by broadcast if they
        were counted to be few enough.
        """
        asked = hashes.where(S.is_hash(F.col("blob_hash"))).select(F.lower("blob_hash").alias("blob_hash")).distinct()
        by_shard = self._by_shard(asked)
        n = sum(by_shard.values())
        table = self.table(sorted(by_shard))
        if n <= POINTS:
            return table.where(F.col("blob_hash").isin(*[r["blob_hash"] for r in asked.collect()])) if n else table.limit(0)
        return table.join(F.broadcast(asked) if n <= BROADCAST_ROWS else asked, "blob_hash", "left_semi")

    def find(self, hashes: DataFrame) -> DataFrame:
        """(blob_hash, content, size_bytes) of the hashes that are there, unpacked."""
        return contents(self.rows_of(hashes), self.packed())

    def sizes(self, hashes: DataFrame | None = None) -> DataFrame:
        """(blob_hash, size_bytes, stored_bytes, codec) of all blobs or of these; contents are not read."""
        rows = self.table() if hashes is None else self.rows_of(hashes)
        return rows.select("blob_hash", "size_bytes", "stored_bytes", "codec")

    def compacted(self, least: int = 16) -> list[dict] | None:
        """The entries with all folders merged into one, once there are ``least``; the caller publishes them. None if there is nothing to do."""
        if len(self.entries) < least:
            return None
        tx = Manifest.folder()
        shards = sorted({s for e in self.entries for s in e["shards"]})
        rows = self.table().withColumn("tx", F.lit(tx))
        rows.repartition(len(shards), "shard").sortWithinPartitions("shard", "blob_hash").write.mode("append").partitionBy("tx", "shard").parquet(self.path)
        return [{"tx": tx, "shards": shards, "packed": self.packed()}]


def contents(rows: DataFrame, packed: bool = True) -> DataFrame:
    """(blob_hash, content, size_bytes) of stored rows, whatever their codec; only packed ones pass through Python, and only where there may be some."""
    if not packed:
        return rows.select("blob_hash", "content", "size_bytes")
    plain = rows.where("codec = 'none'").select("blob_hash", "content", "size_bytes")
    gzip = rows.where("codec = 'gzip'").select("blob_hash", "content", "size_bytes")
    return plain.unionByName(gzip.mapInArrow(unpacked, FOUND))

