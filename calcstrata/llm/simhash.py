"""SimHash near-duplicates found with tables of pivot distances.

Every distinct fingerprint gets its Hamming distances to many reference
fingerprints (pivots), kept per block of bits. Two uses are made of them:

* candidates: a pair within the radius agrees on at least some of the blocks,
  so all its distances to the pivots inside those blocks are equal. The
  tuple of these distances is the bucket key. With ``blocks`` blocks and
  radius r, taking every set of ``blocks - r`` blocks loses no pair.
* discarding: by the triangle inequality the distances of a pair to any pivot
  differ by at most the radius. The largest difference over all pivots
  discards most candidates, and the survivors are compared bit by bit.

Equal fingerprints are one node from the start, so a group of copies costs
one row, and buckets give a spanning forest of their links instead of all
their pairs. A bucket of more than ``bucket_rows`` fingerprints is cut into
chunks, and each pair of chunks is its own task, which is exact for any size.

Where a similarity of shingle sets is asked for, classes are documents with
equal sets, and buckets are bands of min-hashes of the sets: unrelated texts
share no shingle, so the number of tables is fixed, where bits of fingerprints
would need ever more of them (n ** 0.24). Pivot distances and fingerprints
discard pairs in the buckets, with a radius several standard deviations wide;
a crowded bucket (a common line) is dealt out again by pivot distance tuples
over sampled bits, and what stays crowded is one proposed group. Links are
pairs of a proposed group whose shingle sets really are that similar.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_batches, parts, small, stored, then_give_back
from .components import connected_components

_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, words: int) -> list[int]:
    """XXH64 (seed 42) of each shingle of the lower-cased text; [] without a word."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return []
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return [digest(b" ".join(tokens), 42)]
    flat = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate(([0], ends[:-1]))[: len(tokens) - words + 1].tolist()
    return [digest(flat[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def _mixed(h: np.ndarray, salt: int) -> np.ndarray:
    """A further 64-bit hash of each hash; salt 0 is the hash itself."""
    if not salt:
        return h
    x = h + np.uint64((0x9E3779B97F4A7C15 * salt) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def majority_bits(hashes: list[list[int]], width: int) -> np.ndarray:
    """Fingerprints of ``width`` 64-bit words: a bit is 1 if over half the hashes have it.

    Bits are counted eight at a time in the bytes of a word, over runs of at
    most 255 hashes, and the runs are summed.
    """
    sizes = np.array([len(x) for x in hashes], dtype=np.int64)
    out = np.zeros((len(hashes), width), dtype=np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.fromiter((v for x in hashes for v in x), dtype=np.uint64, count=int(sizes.sum()))
    n = sizes[full]
    runs = -(-n // 255)
    first_run = np.concatenate(([0], np.cumsum(runs)[:-1]))
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    at = np.repeat(first, runs) + 255 * (np.arange(runs.sum()) - np.repeat(first_run, runs))
    for w in range(width):
        h = _mixed(flat, w)
        word = np.zeros(len(full), dtype=np.uint64)
        for k in range(8):
            lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, at).view(np.uint8).reshape(-1, 8)
            counts = np.add.reduceat(lanes.astype(np.int64), first_run, axis=0)
            for j in range(8):
                word |= (counts[:, j] * 2 > n).astype(np.uint64) << np.uint64(8 * j + k)
        out[full, w] = word
    return out


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    return [np.unique(np.array(shingle_hashes(t, words), dtype=np.uint64)) for t in texts]


def _same(shingles: np.ndarray) -> int:
    """A signed 64-bit hash of a sorted shingle set."""
    return int(np.uint64(xxhash.xxh64_intdigest(shingles.tobytes(), 42)).view(np.int64))


def band_count(similarity: float, rows: int = 3, recall: float = 0.999) -> int:
    """Bands of ``rows`` min-hashes, one of which a pair of this Jaccard similarity shares with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def min_hash_bands(sets: list[np.ndarray], bands: int, rows: int = 3, seed: int = 17) -> np.ndarray:
    """(sets x bands): one hash of the least ``rows`` permuted hashes of each set; zeros for an empty set."""
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    full = np.flatnonzero(sizes)
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    if not len(full):
        return out
    flat = np.concatenate([sets[i] for i in full])
    first = np.cumsum(sizes[full]) - sizes[full]
    odd = np.random.default_rng(seed).integers(0, 2**64, (bands, rows), dtype=np.uint64) | np.uint64(1)
    for b in range(bands):
        key = np.full(len(full), b + 1, dtype=np.uint64)
        for r in range(rows):
            key = _mixed(key ^ np.minimum.reduceat(flat * odd[b, r], first), 1)
        out[full, b] = key
    return out


def set_fingerprints(docs: DataFrame, words: int, width: int, bands: int) -> DataFrame:
    """(doc_id, text_hash, f0.., same, b0..): of the distinct shingles of each whole text, fingerprints, a hash of the set and min-hash bands."""
    names = [f"f{i}" for i in range(width)]
    keys = [f"b{i}" for i in range(bands)]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, some, told, same = batch.column("text"), [], [], []
        for i in range(0, len(texts), 256):
            sets = shingle_sets(texts.slice(i, 256).to_pylist(), words)
            some.append(majority_bits([x.tolist() for x in sets], width))
            told.append(min_hash_bands(sets, bands))
            same += map(_same, sets)
        bits, shared = np.concatenate(some).view(np.int64), np.concatenate(told).view(np.int64)
        columns = [pa.array(np.ascontiguousarray(x[:, i])) for x in (bits, shared) for i in range(x.shape[1])]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns[:width], pa.array(same, pa.int64()), *columns[width:]], ["doc_id", "text_hash", *names, "same", *keys])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), text.alias("text"))
    return map_batches(rows, one, "doc_id long, text_hash long, " + ", ".join(f"{x} long" for x in [*names, "same", *keys]))


def text_hash():
    """A hash of the whole text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def fingerprints(docs: DataFrame, words: int = 3, width: int = 1) -> DataFrame:
    """(doc_id, f0..): the fingerprint of each whole text as longs (the bits of unsigned words)."""
    names = [f"f{i}" for i in range(width)]

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text")
        some = [majority_bits([shingle_hashes(t, words) for t in texts.slice(i, 256).to_pylist()], width) for i in range(0, len(texts), 256)]
        bits = np.concatenate(some).view(np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(width))], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, one, "doc_id long, " + ", ".join(f"{x} long" for x in names))


def block_masks(width: int, blocks: int, radius: int) -> np.ndarray:
    """Every set of ``blocks - radius`` blocks, as masks: one of them covers equal bits of any linked pair."""
    if blocks <= radius:
        raise ValueError("more blocks than the radius are needed")
    bits = 64 * width
    of = np.arange(bits) * blocks // bits
    return _packed(np.array([np.isin(of, c) for c in combinations(range(blocks), blocks - radius)]))


def similar_bits(similarity: float) -> float:
    """Share of equal bits expected of two shingle sets with this Jaccard similarity."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def similarity_radius(similarity: float, width: int, deviations: float = 5) -> int:
    """Differing bits to allow: the expected number and several standard deviations."""
    bits, p = 64 * width, similar_bits(similarity)
    return round(bits * (1 - p) + deviations * math.sqrt(bits * p * (1 - p)))


def similarity_masks(bits: int, similarity: float, width: int, recall: float = 0.999) -> np.ndarray:
    """Enough samples of ``bits`` bits that a pair at the similarity agrees on one of them with probability ``recall``."""
    tables = math.ceil(math.log(1 - recall) / math.log(1 - similar_bits(similarity) ** bits))
    return sampled_masks(width, tables, bits)


def exact_blocks(classes: int, width: int, radius: int) -> int:
    """The least number of blocks whose bucket keys have two bits more than it takes to number the classes; any number is exact."""
    blocks = radius + 2
    while blocks < 3 * radius and 64 * width * (blocks - radius) / blocks < math.log2(max(2, classes)) + 2:
        blocks += 1
    return blocks


def sampled_masks(width: int, tables: int, bits: int, seed: int = 7) -> np.ndarray:
    """Random sets of bits, for radii too large for the exact scheme."""
    rng = np.random.default_rng(seed)
    on = np.zeros((tables, 64 * width), dtype=bool)
    for row in on:
        row[rng.choice(64 * width, bits, replace=False)] = True
    return _packed(on)


def _packed(on: np.ndarray) -> np.ndarray:
    return np.packbits(on, axis=1, bitorder="little").view(np.uint64)


def reference_points(width: int, count: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, (count, width), dtype=np.uint64)


def pivot_distances(points: np.ndarray, references: np.ndarray, mask: np.ndarray | None = None) -> np.ndarray:
    """Hamming distances (points x references), inside the mask if there is one."""
    out = np.empty((len(points), len(references)), dtype=np.int16)
    for i, p in enumerate(references):
        x = points ^ p
        out[:, i] = np.bitwise_count(x if mask is None else x & mask).sum(axis=1)
    return out


def _keys(distances: np.ndarray, table: int) -> np.ndarray:
    """One 64-bit number for a tuple of distances in a table; equal tuples, equal numbers."""
    key = np.full(len(distances), (table + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    for column in distances.T:
        key = _mixed(key ^ column.astype(np.uint64), 1)
    return key.view(np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) that connect what the links a-b connect."""
    nodes, flat = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        while not np.array_equal(new, deeper := new[new]):
            new = deeper
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def linked_in_cells(cell: np.ndarray, points: np.ndarray, references: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) of pairs within the radius in the same cell; rows of a cell are neighbours.

    Of more than a million pairs, a forest that connects the same is kept.
    """
    table = pivot_distances(points, references)
    left, right, offset, held = [], [], 1, 0
    at = np.arange(len(cell))
    while True:
        at = at[at + offset < len(cell)]
        at = at[cell[at] == cell[at + offset]]
        if not len(at):
            break
        near = at
        for i in range(len(references)):
            near = near[np.abs(table[near, i] - table[near + offset, i]) <= radius]
        near = near[np.bitwise_count(points[near] ^ points[near + offset]).sum(axis=1) <= radius]
        left.append(near)
        right.append(near + offset)
        offset += 1
        held += len(near)
        if held > 1_000_000:
            a, b = forest(np.concatenate(left), np.concatenate(right))
            left, right, held = [a], [b], 0
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def whole_cells(found):
    """A partition function that gives ``found`` whole cells at a time: a batch's last cell waits for the next batch."""

    def compare(batches):
        waiting = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if waiting is None else pa.concat_tables([waiting, pa.Table.from_batches([batch])])
            cell = table.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1], side="left"))
            waiting = table.slice(cut)
            if cut:
                yield from found(table.slice(0, cut))
        if waiting is not None:
            yield from found(waiting)

    return then_give_back(compare)


def _in_cells(cells: DataFrame, width: int, radius: int, pivots: int) -> DataFrame:
    """(u, v): a spanning forest of the links inside each cell of (cell, rep, f0..)."""
    names = [f"f{i}" for i in range(width)]
    references = reference_points(width, pivots)

    def found(table: pa.Table):
        cell = table.column("cell").to_numpy()
        rep = table.column("rep").to_numpy()
        points = np.stack([table.column(x).to_numpy().view(np.uint64) for x in names], axis=1)
        i, j = linked_in_cells(cell, points, references, radius)
        if len(i):
            u, v = forest(rep[i], rep[j])
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    rows = cells.select("cell", "rep", *names).repartition(parts(cells.sparkSession), "cell").sortWithinPartitions("cell")
    return rows.mapInArrow(whole_cells(found), "u long, v long")


def _split_crowded(spark: SparkSession, placed: DataFrame, bucket_rows: int) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """Rows (key, ..) of ordinary buckets, rows of crowded ones with their sizes ``n`` (None if there are none), and stored tables.

    Only the few keys of crowded buckets are joined: at most one for each
    ``bucket_rows`` rows.
    """
    crowded = stored(spark, placed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows), "crowded")
    several = crowded.count()
    if not several:
        return placed, None, [crowded]
    return placed.join(small(crowded.select("key"), several), "key", "left_anti"), placed.join(small(crowded, several), "key"), [crowded]


def links(spark: SparkSession, classes: DataFrame, width: int, radius: int, masks: np.ndarray, pivots: int = 24, key_pivots: int = 12, bucket_rows: int = 4096) -> DataFrame:
    """(u, v): a spanning forest of the links between classes (rep, f0..) of equal fingerprints; stored.

    Exact if the masks are: a bucket of more than ``bucket_rows`` rows is cut
    into chunks, and each pair of chunks is a cell.
    """
    names = [f"f{i}" for i in range(width)]
    references = reference_points(width, key_pivots)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        points = np.stack([batch.column(x).to_numpy(zero_copy_only=False).view(np.uint64) for x in names], axis=1)
        key = np.concatenate([_keys(pivot_distances(points, references, m), t) for t, m in enumerate(masks)])
        rows = np.tile(np.arange(len(points)), len(masks))
        taken = batch.take(pa.array(rows))
        return pa.RecordBatch.from_arrays([pa.array(key), *taken.columns], ["key", *batch.schema.names])

    schema = "key long, rep long, " + ", ".join(f"{x} long" for x in names)
    placed = stored(spark, map_batches(classes.select("rep", *names), place, schema), "pivot-rows")
    cells, hot, used = _split_crowded(spark, placed, bucket_rows)
    cells = cells.withColumn("cell", F.col("key"))
    if hot is not None:
        hot = hot.withColumn("chunks", F.ceil(F.col("n") / bucket_rows).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
        hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        hot = hot.withColumn("cell", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        cells = cells.select("cell", "rep", *names).unionByName(hot.select("cell", "rep", *names))
    out = stored(spark, _in_cells(cells, width, radius, pivots), "links")
    discard(spark, placed, *used)
    return out


def proposed_links(spark: SparkSession, classes: DataFrame, width: int, radius: int, bands: int, similarity: float, pivots: int = 24, key_pivots: int = 12, bucket_rows: int = 4096) -> DataFrame:
    """(u, v): links within the radius between classes (rep, f0.., b0..) that share a band; stored.

    A bucket of more than ``bucket_rows`` rows is dealt out again: its rows
    go to cells of equal pivot distances over samples of bits, more and longer
    ones the larger the bucket. A cell that is crowded again holds texts that
    all look alike, and is linked as a whole; the sets are compared later.
    """
    names = [f"f{i}" for i in range(width)]
    references = reference_points(width, key_pivots)
    each = F.explode(F.array(*(f"b{i}" for i in range(bands)))).alias("key")
    placed = classes.select(each, "rep", *names)
    cells, hot, used = _split_crowded(spark, placed, bucket_rows)
    cells = cells.select(F.col("key").alias("cell"), "rep", *names)
    edges = None
    if hot is not None:

        def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
            points = np.stack([batch.column(x).to_numpy(zero_copy_only=False).view(np.uint64) for x in names], axis=1)
            bits = np.ceil(np.log2(batch.column("n").to_numpy() / bucket_rows)).astype(np.int64) + 2
            bucket, cell, row = batch.column("key").to_numpy().view(np.uint64), [], []
            for b in np.unique(bits).tolist():
                at = np.flatnonzero(bits == b)
                for t, m in enumerate(similarity_masks(b, similarity, width)):
                    cell.append(_mixed(_keys(pivot_distances(points[at], references, m), t).view(np.uint64) ^ _mixed(bucket[at], 2), 1))
                    row.append(at)
            taken = batch.select(["rep", *names]).take(pa.array(np.concatenate(row)))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell).view(np.int64)), *taken.columns], ["cell", "rep", *names])

        dealt = stored(spark, map_batches(hot.select("key", "rep", "n", *names), deal, "cell long, rep long, " + ", ".join(f"{x} long" for x in names)), "dealt")
        dense = stored(spark, dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("v")).where(F.col("n") > bucket_rows), "dense")
        several = dense.count()
        cells = cells.unionByName(dealt.join(small(dense, several), "cell", "left_anti").select("cell", "rep", *names))
        edges = dealt.join(small(dense, several), "cell").select(F.col("rep").alias("u"), "v").where("u <> v")
        used += [dealt, dense]
    found = _in_cells(cells, width, radius, pivots)
    out = stored(spark, found if edges is None else found.unionByName(edges), "links")
    discard(spark, *used)
    return out


def similar_in_cell(label: np.ndarray, open_: np.ndarray, points: np.ndarray, sets: list[np.ndarray], radius: int, similarity: float) -> list[tuple[int, int]]:
    """Positions (i, j) of pairs with this Jaccard similarity, enough to connect all such pairs.

    Rows of one label are connected from the start; only pairs with an open
    row are compared, the nearest fingerprints first.
    """
    label, size, out = label.copy(), np.array([len(x) for x in sets]), []
    for i in range(1, len(sets)):
        far = np.bitwise_count(points[:i] ^ points[i]).sum(axis=1)
        near = (label[:i] != label[i]) & (far <= radius) & (open_[:i] | open_[i])
        near &= np.minimum(size[:i], size[i]) >= similarity * np.maximum(size[:i], size[i]) - 1e-6
        at = np.flatnonzero(near)
        for j in at[np.argsort(far[at], kind="stable")].tolist():
            if label[i] == label[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both and both / (size[i] + size[j] - both) >= similarity:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def similar_links(spark: SparkSession, docs: DataFrame, groups: DataFrame, words: int, width: int, radius: int, similarity: float, group_rows: int = 512) -> DataFrame:
    """(u, v): pairs in ``groups`` (group, rep, f0.., same) with this Jaccard similarity, enough to connect all such pairs in a group; stored.

    Groups of more than ``group_rows`` are cut into chunks with the group's
    least document in each. What a chunk leaves apart from the largest part of
    its group is then compared with the whole group, chunk by chunk.
    """
    names = [f"f{i}" for i in range(width)]
    n = parts(spark)

    def take(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column("text").to_pylist(), words)
        return pa.RecordBatch.from_arrays([batch.column("rep"), pa.array(map(_same, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], ["rep", "same", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    texts = texts.join(small(groups.select("rep").distinct(), groups.count()), "rep", "left_semi")
    sets = map_batches(texts, take, "rep long, same long, shingles binary").dropDuplicates(["rep", "same"])
    members = stored(spark, groups.join(sets, ["rep", "same"]).select("group", "rep", *names, "shingles"), "members")

    def found(table: pa.Table):
        cell = table.column("cell").to_numpy()
        rep, label, open_ = (table.column(x).to_numpy() for x in ("rep", "label", "open"))
        points = np.stack([table.column(x).to_numpy().view(np.uint64) for x in names], axis=1)
        shingles = table.column("shingles")
        edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
        u, v = [], []
        for a, b in zip(edges, edges[1:], strict=False):
            own = [np.frombuffer(x, np.uint64) for x in shingles.slice(a, b - a).to_pylist()]
            for i, j in similar_in_cell(label[a:b], open_[a:b], points[a:b], own, radius, similarity):
                u.append(rep[a + i])
                v.append(rep[a + j])
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    def compared(cells: DataFrame) -> DataFrame:
        rows = cells.select("cell", "rep", "label", "open", *names, "shingles").repartition(n, "cell").sortWithinPartitions("cell")
        return stored(spark, rows.mapInArrow(whole_cells(found), "u long, v long"), "similar")

    crowded = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader")).where(F.col("n") > group_rows)
    crowded = stored(spark, crowded.withColumn("chunks", F.ceil(F.col("n") / group_rows).cast("int")), "crowded")
    own = lambda chunks: F.pmod(F.xxhash64("rep"), chunks).cast("int")
    several = crowded.count()
    placed = members.join(small(crowded, several), "group", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunk = F.explode(F.when(F.col("rep") == F.col("leader"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(own(F.col("chunks")))))
    once = compared(placed.withColumn("chunk", chunk).select(F.xxhash64("group", "chunk").alias("cell"), "rep", F.col("rep").alias("label"), F.lit(True).alias("open"), *names, "shingles"))
    if not several:
        discard(spark, members, crowded)
        return once
    reached = connected_components(spark, once).withColumnRenamed("node", "rep")
    labels = members.select("group", "rep").join(small(crowded.select("group", "chunks"), several), "group").join(reached, "rep", "left")
    labels = stored(spark, labels.select("group", "rep", "chunks", F.coalesce("component", "rep").alias("label")).distinct(), "labels")
    counts = labels.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    split = counts.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), (F.sum("n") - F.max("n")).alias("apart")).where("apart > 0")
    split = split.withColumn("open_chunks", F.ceil(F.col("apart") / group_rows).cast("int"))
    rows = members.join(labels.join(split, "group"), ["group", "rep"]).withColumn("open", F.col("label") != F.col("main"))
    keep = ["group", "rep", "label", "open", *names, "shingles"]
    every = rows.select(*keep, own(F.col("chunks")).alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("open_chunks") - 1)).alias("open_chunk"))
    apart = rows.where("open").select(*keep, F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), own(F.col("open_chunks")).alias("open_chunk"))
    again = compared(every.unionByName(apart).withColumn("cell", F.xxhash64("group", "chunk", "open_chunk")))
    discard(spark, members, crowded, labels)
    return once.unionByName(again)


def _own_keys(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): one id for each text that an id stands for, in the order of ids.

    Ids that stand for one text stay as they are. If some stand for several
    (which one sum by id tells), every pair of id and text gets a new id from
    its place in a range-partitioned order, so the least id still comes first.
    """
    own = F.struct(*(F.col(f"`{x}`") for x in docs.columns))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash().alias("text_hash"), F.col("text").cast("string").alias("text"), own.alias("row"))
    shared = rows.where("doc_id is not null").groupBy("doc_id").agg((F.min("text_hash") != F.max("text_hash")).alias("several")).where("several")
    if shared.isEmpty():
        return rows.drop("text_hash")
    pairs = rows.where("doc_id is not null").select("doc_id", "text_hash").distinct()
    pairs = pairs.repartitionByRange(parts(spark), "doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash")
    keys = stored(spark, pairs.withColumn("key", F.monotonically_increasing_id()), "text-keys")
    return rows.join(keys, ["doc_id", "text_hash"], "left").select(F.col("key").alias("doc_id"), "text", "row")


def keep_one(spark: SparkSession, docs: DataFrame, words: int = 5, similarity: float = 0.8, width: int = 4) -> DataFrame:
    """One row of each near-duplicate group of ``docs``, that of the least doc_id; all columns stay.

    What is grouped are texts: an id that stands for several texts counts
    once for each, so no text goes unless a near copy of it stays. Equal rows
    of one id and text are one. Rows without doc_id all stay. Null texts count
    as empty, which are all alike; an empty table gives an empty one.
    """
    keyed = _own_keys(spark, docs)
    found = near_duplicates(spark, keyed.select("doc_id", "text"), words=words, width=width, similarity=similarity)
    found = stored(spark, found.select("doc_id", "component_id"), "groups")
    gone = found.where("component_id <> doc_id").select("doc_id").distinct()
    kept = keyed.select("doc_id", "row").join(small(gone, gone.count()), "doc_id", "left_anti")
    again = stored(spark, found.where("component_id = doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "again")
    several = again.count()
    if not several:
        return kept.select("row.*")
    once = kept.join(small(again, several), "doc_id", "left_semi").groupBy("doc_id").agg(F.first("row").alias("row"))
    return kept.join(small(again, several), "doc_id", "left_anti").select("row.*").unionByName(once.select("row.*"))


def near_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    words: int = 3,
    radius: int = 3,
    width: int = 1,
    blocks: int | None = None,
    similarity: float | None = None,
) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_class): near-duplicate groups of whole texts.

    fingerprint: hex digits of the unsigned words, the highest first.
    component_id: the least doc_id that links reach. n_class: rows with this
    fingerprint. Null, empty and blank texts have fingerprint zero and are
    linked like any other; repeated rows come out once each; a null doc_id
    keeps its row, has component_id null and links nothing; other columns of
    ``docs`` are ignored; an empty table gives an empty one. Linking is exact
    for ``radius`` and any number of ``blocks`` (by default as many as the
    classes ask for) unless a ``similarity`` of shingle sets is given: then
    links are pairs whose sets have that Jaccard similarity, n_class counts
    the rows with this set, a column text_hash is added, and a pair at the
    similarity is met in a band of min-hashes with probability 0.999, whatever
    the size of the corpus.
    """
    names = [f"f{i}" for i in range(width)]
    exact = similarity is None
    own = names if exact else [*names, "same"]
    bands = 0 if exact else band_count(similarity)
    prints = fingerprints(docs, words, width) if exact else set_fingerprints(docs, words, width, bands)
    prints = stored(spark, prints, "fingerprints")
    shared = [F.min(f"b{i}").alias(f"b{i}") for i in range(bands)]  # equal sets have equal bands
    classes = prints.groupBy(*own).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_class"), *shared)
    classes = stored(spark, classes, "classes")
    named = classes.where("rep is not null")
    if exact:
        blocks = blocks or exact_blocks(classes.count(), width, radius)
        edges = links(spark, named, width, radius, block_masks(width, blocks, radius))
    else:
        radius = similarity_radius(similarity, width)
        edges = proposed_links(spark, named, width, radius, bands, similarity)
    reached = connected_components(spark, edges)
    if not exact:
        groups = classes.join(reached.select(F.col("node").alias("rep"), F.col("component").alias("group")), "rep")
        groups = stored(spark, groups.select("group", "rep", *own), "candidates")
        edges = similar_links(spark, docs, groups, words, width, radius, similarity)
        reached = connected_components(spark, edges)
        discard(spark, groups)
    named = classes.join(reached.withColumnRenamed("node", "rep"), "rep", "left").select(*own, "n_class", F.coalesce("component", "rep").alias("component"))
    digits = F.concat(*(F.lower(F.lpad(F.hex(F.col(x)), 16, "0")) for x in reversed(names)))
    more = [] if exact else ["text_hash"]
    return prints.join(named, own, "left").select("doc_id", *more, digits.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component")).alias("component_id"), "n_class")
