"""Packing of documents into sequences by minimum bin slack.

A document longer than a sequence is cut at multiples of the capacity; full
pieces are sequences of their own, and the remainders are packed. Their
lengths form a multiset of at most ``capacity`` distinct values, which is all
that the driver sees. Each window takes the longest length left and then, by
a subset-sum programme over bitsets, the multiset of other lengths that comes
closest to filling it; counts are tracked back through the bitsets. A fill
found is used as often as the counts allow, so the plan stays small however
many documents there are. Pieces then look up their place from their rank
among the pieces of their length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, then_give_back
from .tokens import word_cache


def closest_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """Counts of lengths whose sum is the largest that does not exceed ``room``."""
    if room <= 0:
        return {}
    within = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & within
            left -= take
            take *= 2
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            total -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan_fills(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fills and how often each is used; all pieces are placed."""
    left = {x: n for x, n in counts.items() if n}
    fills = []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        fill = closest_fill(rest, capacity - longest)
        fill[longest] = fill.get(longest, 0) + 1
        times = min(left[x] // k for x, k in fill.items())
        fills.append((fill, times))
        for x, k in fill.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
    return fills


class Placement:
    """Where the piece of a given length and rank goes."""

    def __init__(self, fills: list[tuple[dict[int, int], int]], capacity: int):
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for fill, times in fills:
            offset = 0
            for length in sorted(fill, reverse=True):
                k = fill[length]
                rows.setdefault(length, []).append((used.get(length, 0), sequence, k, offset))
                used[length] = used.get(length, 0) + k * times
                offset += k * length
            sequence += times
        self.capacity, self.sequences = capacity, sequence
        self.rows = {x: np.array(r, dtype=np.int64) for x, r in rows.items()}

    def __call__(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = self.sequences + rank, np.zeros(len(rank), dtype=np.int64)
        for x in np.unique(length):
            if x != self.capacity:
                at = np.flatnonzero(length == x)
                table = self.rows[int(x)]
                first, base, k, off = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1].T
                nth = rank[at] - first
                sequence[at] = base + nth // k
                offset[at] = off + nth % k * x
        return sequence, offset


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, keep_ids: bool = False, cache_words: int = 300_000) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, block, nth[, ids]); nth counts a length inside a block."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId()
        cache = word_cache(tokenizer, cache_words)
        end = np.array([end_id], dtype="<u4").tobytes()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            doc, start, length, crc, total, nth, ids = [], [], [], [], [], [], []
            for d, got in zip(batch.column("doc_id").to_pylist(), cache.ids(batch.column("text").to_pylist()), strict=True):
                data = np.frombuffer(got, cache.dtype).astype("<u4").tobytes() + end
                n = len(data) // 4
                for a in range(0, n, capacity):
                    piece = data[4 * a : 4 * (a + capacity)]
                    k = len(piece) // 4
                    doc.append(d)
                    start.append(a)
                    length.append(k)
                    crc.append(zlib.crc32(piece))
                    total.append(n)
                    nth.append(int(seen[k]))
                    seen[k] += 1
                    if keep_ids:
                        ids.append(piece)
            columns = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total, [block] * len(doc), nth)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "block", "nth"]
            if keep_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, block long, nth long"
    return rows.mapInArrow(then_give_back(cut, keep_words=True), schema + (", ids binary" if keep_ids else ""))


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, keep_ids: bool = False, cache_words: int = 300_000) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    Null and empty texts are documents of the end id alone; repeated rows are
    packed once each; a null doc_id is kept as it is; other columns are
    ignored; an empty table gives an empty result. Pieces of one sequence are
    gapless from offset 0. ``keep_ids`` adds the ids as little-endian unsigned
    32-bit numbers. ``cache_words`` bounds the words a worker remembers, at
    some 250 bytes each, and changes no result.
    """
    pieces = stored(spark, cut_documents(docs, tokenizer, end_id, capacity, keep_ids, cache_words), "pieces")
    blocks = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    blocks = stored(spark, blocks, "piece-counts")
    counts = {r["length"]: r["n"] for r in blocks.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    counts.pop(capacity, None)
    placement = Placement(plan_fills(counts, capacity), capacity)
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    firsts = blocks.select("length", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = pieces.join(firsts, ["length", "block"]).withColumn("rank", F.col("first") + F.col("nth")).drop("first", "nth", "block")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names = batch.schema.names
                sequence, offset = placement(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
                kept = [x for x in names if x != "rank"]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in kept), pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(then_give_back(place), ", ".join([*fields, "sequence_id long", "offset long"]))
