"""Directly addressable codes: token files with random access to any id.

An id is split into chunks of eight bits, the lowest first. Level 0 holds the
first chunk of every id, level k the k-th chunk of those that have one; a
bitmap beside each level says which of its entries go on. A rank directory
(ones before every 512th bit) turns a position in one level into the position
in the next, so a token or a range is read without decoding what lies before.

A file holds whole documents in ascending doc_id order: a header, the doc ids,
a bitmap of those that are absent and their end offsets, then the levels. Files are kept as binary values of a
Parquet table in the shared folder, which any store that Spark reads can hold.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parts, small, stored, then_give_back
from .tokens import word_cache

MAGIC = b"DACT0002"
RANK_STEP = 512


def encode_ids(ids: np.ndarray) -> bytes:
    """The levels of a sequence of unsigned ids."""
    rest = np.asarray(ids, dtype=np.uint32)
    levels = []
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        steps = -(-len(more) // RANK_STEP)
        ones = np.add.reduceat(more, np.arange(steps) * RANK_STEP, dtype=np.int64) if steps else np.zeros(0, np.int64)
        rank = np.concatenate(([0], np.cumsum(ones))).astype("<u4")
        levels.append(((rest & 0xFF).astype(np.uint8).tobytes(), bits.tobytes(), rank.tobytes()))
        if not more.any():
            break
        rest = rest[more] >> np.uint32(8)
    out = [struct.pack("<I", len(levels))]
    for level in levels:
        for part in level:
            out += [struct.pack("<Q", len(part)), part]
    return b"".join(out)


def encode_file(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    ends = np.cumsum(np.asarray(lengths, dtype=np.uint64), dtype=np.uint64)
    absent = np.packbits(np.array([x is None for x in doc_ids], dtype=bool), bitorder="little")
    known = np.array([0 if x is None else x for x in doc_ids], dtype="<i8")
    return b"".join((MAGIC, struct.pack("<Q", len(doc_ids)), known.tobytes(), absent.tobytes(), ends.astype("<u8").tobytes(), encode_ids(ids)))


class DacFile:
    """Reads a file's bytes; nothing is decoded before it is asked for."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (n,) = struct.unpack_from("<Q", data, 8)
        self.doc_ids = np.frombuffer(data, "<i8", n, 16)
        flags = -(-n // 8)
        self.absent = np.unpackbits(np.frombuffer(data, np.uint8, flags, 16 + 8 * n), bitorder="little", count=n).astype(bool)
        self.ends = np.frombuffer(data, "<u8", n, 16 + 8 * n + flags).astype(np.int64)
        at = 16 + 16 * n + flags
        (count,) = struct.unpack_from("<I", data, at)
        at += 4
        self.levels = []
        for _ in range(count):
            level = []
            for kind in (np.uint8, np.uint8, "<u4"):
                (size,) = struct.unpack_from("<Q", data, at)
                level.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at + 8))
                at += 8 + size
            self.levels.append(level)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Entries before i that go on to the next level."""
        _, bits, rank = self.levels[level]
        step = i // RANK_STEP
        lo = step * RANK_STEP // 8
        block = np.unpackbits(bits[lo : lo + RANK_STEP // 8], bitorder="little")
        return int(rank[step]) + int(block[: i - step * RANK_STEP].sum())

    def token(self, i: int) -> int:
        """The id at position i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        value = 0
        for k, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * k)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(k, i)
        return value

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """The ids of a range, as unsigned 32-bit numbers."""
        where = np.arange(stop - start)
        out = np.zeros(stop - start, dtype="<u4")
        for k, (chunks, bits, _) in enumerate(self.levels):
            if stop <= start:
                break
            out[where] |= chunks[start:stop].astype(np.uint32) << np.uint32(8 * k)
            first = start >> 3
            on = np.unpackbits(bits[first : -(-stop // 8)], bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            where = where[on]
            start = self._rank(k, start) if len(where) else 0
            stop = start + len(where)
        return out


def write_tokens(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, file_tokens: int = 4_000_000, cache_words: int = 600_000) -> DataFrame:
    """Files (shard, part, n_tokens, n_docs, file) of all documents, in ascending doc_id order over shard and part.

    A document's ids are followed by ``end_id``. Null texts count as empty,
    repeated rows are kept and lie side by side, rows without doc_id come
    first and are marked absent in the file; other columns are ignored; an
    empty table gives no file. ``cache_words`` bounds the words that a worker
    remembers, at about 250 bytes each, and changes no result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(parts(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, part = TaskContext.get().partitionId(), 0
        cache = word_cache(tokenizer, cache_words)
        end = np.array([end_id], dtype=cache.dtype).tobytes()
        size = cache.dtype.itemsize
        doc_ids, lengths, held, total = [], [], [], 0

        def file():
            ids = np.frombuffer(b"".join(held), dtype=cache.dtype)
            data = encode_file(doc_ids, lengths, ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([part], pa.int32()), pa.array([total], pa.int64()), pa.array([len(doc_ids)], pa.int64()), pa.array([data], pa.binary())],
                ["shard", "part", "n_tokens", "n_docs", "file"],
            )

        for batch in batches:
            got = cache.ids(batch.column("text").to_pylist())
            for doc, ids in zip(batch.column("doc_id").to_pylist(), got, strict=True):
                n = len(ids) // size + 1
                if total and total + n > file_tokens:
                    yield file()
                    part += 1
                    doc_ids, lengths, held, total = [], [], [], 0
                doc_ids.append(doc)
                lengths.append(n)
                held.append(ids + end)
                total += n
        if doc_ids:
            yield file()

    return stored(spark, rows.mapInArrow(then_give_back(write, keep_words=True), "shard int, part int, n_tokens long, n_docs long, file binary"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files; doc_id is null where it is absent.

    The start of a file is the sum of the tokens of those before it: one
    narrow row a file, and a file has millions of tokens, so the files' bytes
    stay where they are read. No files give no rows.
    """
    sizes = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition of the writer
    shards = sizes.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shard_start"))
    inside = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "part", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("part_start"))
    starts = starts.join(shards, "shard").select("shard", "part", (F.col("shard_start") + F.col("part_start")).alias("base"))
    starts = small(starts, files.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, base in zip(batch.column("file"), batch.column("base").to_pylist(), strict=True):
                file = DacFile(data.as_py())
                firsts = np.concatenate(([0], file.ends[:-1]))
                crc = [zlib.crc32(file.tokens(int(a), int(b)).tobytes()) for a, b in zip(firsts, file.ends, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(file.doc_ids, mask=file.absent), pa.array(firsts + base), pa.array(file.ends - firsts), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return files.join(starts, ["shard", "part"]).select("file", "base").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
