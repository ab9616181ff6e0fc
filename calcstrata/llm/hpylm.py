"""A hierarchical Pitman-Yor language model, sampled and applied where the words are.

Context restaurants are those of the word before, hashed into ``CONTEXTS``
classes; all share one parent, the root restaurant, whose base is uniform over
the learned words and one unknown word. A customer's dish is a word, and each
table of a context sends one customer to the root.

Tokens are exchanged once, to cells by their word, so all that a word needs
lies in its cell: its counts in every context, its tables, and the tokens to
be scored. Only totals of restaurants cross cells, vectors of ``CONTEXTS``
numbers whatever the corpus. A Gibbs sweep resamples the tables of each word
in each restaurant given all others: up to ``EXACT`` customers from the exact
conditional (generalised Stirling numbers); of a larger group, ``EXACT``
customers are seated by that conditional and the rest after them, a few at a
time. Totals are those of the sweep before. Every draw is a hash of its word,
context and sweep, so scores do not depend on how the rows are partitioned.
Predictive probabilities are averaged over the sweeps after the first.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, parts, stored
from .suffixes import _M, _expand, _mix, _squeeze

CONTEXTS = 1 << 16
EXACT = 64
STRENGTH = 1.0
_END_WORD, _START = b"\n", 0


def tokens_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words and one end, which no word can equal."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(_END_WORD)
    return words


def _read(batches: Iterator[pa.RecordBatch], cells: int, block_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Blocks of documents: a row for each cell with its tokens (kind 0), and the table of documents (kind 1)."""
    from pyspark import TaskContext

    task, number = TaskContext.get().partitionId(), 0
    index: dict[bytes, int] = {}
    flat: list[int] = []
    ids, held, lengths, size = [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        words = list(index)
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(w, 0) for w in words), np.uint64, len(words))
        word = np.array(flat, np.int64)
        doc = np.repeat(np.arange(len(ids)), lengths)
        classes = ((hashes >> np.uint64(40)) % np.uint64(CONTEXTS)).astype(np.uint16)
        context = np.concatenate(([_START], classes[word[:-1]])).astype(np.uint16)
        first = np.cumsum(lengths) - lengths
        context[first] = _START
        block = task << 24 | number
        cell_of = (hashes % np.uint64(cells)).astype(np.int64)
        order = np.argsort(cell_of[word], kind="stable")
        edges = np.searchsorted(cell_of[word][order], np.arange(cells + 1))
        local = np.empty(len(words), np.int64)
        for cell in range(cells):
            at = order[edges[cell] : edges[cell + 1]]
            if len(at):
                used = np.unique(word[at])
                local[used] = np.arange(len(used))
                d = doc[at]
                data = _squeeze(hashes[used], local[word[at]].astype(np.uint32), context[at], np.diff(d, prepend=0).astype(np.uint32), np.array(held, np.uint8))
                yield row(cell, block, 0, data)
        yield row(block % cells, block, 1, _squeeze(np.array([0 if x is None else x for x in ids], np.int64), np.array([x is None for x in ids], np.uint8), np.array(held, np.uint8), np.array(lengths, np.int64)))

    def row(cell: int, block: int, kind: int, data: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([block], pa.int64()), pa.array([kind], pa.int8()), pa.array([data], pa.binary())], ["cell", "block", "kind", "data"])

    for batch in batches:
        for doc, is_held, text in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "held_out", "text")), strict=True):
            words = tokens_of(text)
            flat += [index.setdefault(w, len(index)) for w in words]
            ids.append(doc)
            held.append(is_held)
            lengths.append(len(words))
            size += len(text)
            if size >= block_bytes:
                yield from flush()
                index.clear()
                flat, ids, held, lengths, size = [], [], [], [], 0
                number += 1
    if ids:
        yield from flush()


_CELL_NAMES = ["kind", "block", "data", "counts"]
_CELL_SCHEMA = "kind byte, block long, data binary, counts binary"


def _cell_row(kind: int, block: int, data: bytes, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int8()), pa.array([block], pa.int64()), pa.array([data], pa.binary()), pa.array([counts], pa.binary())], _CELL_NAMES)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for the cells of a partition: word-context pairs with their counts, and the tokens of each block."""
    hashes, word, context, doc, train, blocks, base = [], [], [], [], [], [], 0
    for batch in batches:
        for block, kind, data in zip(*(batch.column(x).to_pylist() for x in ("block", "kind", "data")), strict=True):
            if kind:
                yield _cell_row(1, block, data, b"")
                continue
            h, w, c, d, held = _expand(data)
            d = np.cumsum(d, dtype=np.int64)
            hashes.append(h)
            word.append(w.astype(np.int64) + base)
            context.append(c)
            doc.append(d)
            train.append(held[d] == 0)
            blocks.append((block, len(w)))
            base += len(h)
    if not blocks:
        return
    names, same = np.unique(np.concatenate(hashes), return_inverse=True)
    key = same[np.concatenate(word)] << 16 | np.concatenate(context)
    pairs, of = np.unique(key, return_inverse=True)
    counts = np.bincount(of[np.concatenate(train)], minlength=len(pairs)).astype(np.uint32)
    del key
    out = [struct.pack("<q", len(blocks))]
    at = 0
    for (block, n), d in zip(blocks, doc, strict=True):
        data = _squeeze(np.diff(d, prepend=0).astype(np.uint32), of[at : at + n].astype(np.uint32))
        out += [struct.pack("<qq", block, len(data)), data]
        at += n
    yield _cell_row(0, -1, b"".join(out), _squeeze((pairs >> 16).astype(np.uint32), (pairs & 0xFFFF).astype(np.uint16), counts, names))


def stirling(discount: float, most: int) -> np.ndarray:
    """Logs of generalised Stirling numbers [customers, tables]; minus infinity where there is no seating."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - discount * t)
        out[c + 1, 2 : c + 2] = np.logaddexp(out[c + 1, 2 : c + 2], out[c, 1 : c + 1])
    return out


class Draws:
    """Random numbers that belong to keys (word and context), whatever else is drawn."""

    def __init__(self, keys: np.ndarray, sweep: int):
        self.keys = _mix(keys + np.uint64((sweep + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))

    def uniform(self, at: np.ndarray, nth: int = 0) -> np.ndarray:
        x = _mix(self.keys[at] ^ _mix(np.array([nth + 1], np.uint64) * _M))
        return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

    def normal(self, at: np.ndarray, nth: int) -> np.ndarray:
        return np.sqrt(-2 * np.log(self.uniform(at, 2 * nth))) * np.cos(2 * np.pi * self.uniform(at, 2 * nth + 1))


def resample(customers: np.ndarray, others: np.ndarray, parent: np.ndarray, discount: float, table: np.ndarray, draws: Draws) -> np.ndarray:
    """Tables of one dish in each restaurant, given the tables of other dishes there and the parent's probability."""
    tables = np.minimum(customers, 1)
    own = np.minimum(customers, EXACT)
    for c in np.unique(own[own > 1]).tolist():
        every = np.flatnonzero(own == c)
        some = max(1, 400_000 // c)  # bounds the memory of a step
        for at in (every[i : i + some] for i in range(0, len(every), some)):
            t = np.arange(1, c + 1)
            weight = STRENGTH + discount * (others[at][:, None] + np.arange(c))
            logs = table[c, 1 : c + 1] + t * np.log(parent[at])[:, None] + np.cumsum(np.log(weight), axis=1)
            p = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
            tables[at] = 1 + (p < (draws.uniform(at) * p[:, -1])[:, None]).sum(axis=1)
    at = np.flatnonzero(customers > EXACT)
    t, n, nth = tables[at].astype(np.float64), EXACT, 1
    while len(live := np.flatnonzero(customers[at] > n)):
        who = at[live]
        some = np.minimum(max(1, n // 32), customers[who] - n)
        new = (STRENGTH + discount * (others[who] + t[live])) * parent[who]
        chance = np.clip(new / (new + n - discount * t[live]), 0, 1)
        drawn = np.rint(some * chance + draws.normal(who, nth) * np.sqrt(some * chance * (1 - chance)))
        t[live] += np.clip(drawn, 0, some)
        n, nth = n + max(1, n // 32), nth + 1
    tables[at] = t
    return tables


class Totals:
    """What a sweep needs of the others: tables and customers by context, and the root's."""

    def __init__(self, tables: np.ndarray, customers: np.ndarray, root_tables: float, words: float, discounts: tuple[float, float]):
        self.tables, self.customers = tables, customers
        self.root_customers, self.root_tables, self.words = float(tables.sum()), root_tables, words
        self.discount, self.root_discount = discounts

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """Probabilities of words in the root restaurant."""
        new = (STRENGTH + self.root_discount * self.root_tables) / (self.words + 1)
        return (customers - self.root_discount * tables + new) / (STRENGTH + self.root_customers)

    def predict(self, context: np.ndarray, customers: np.ndarray, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        up = STRENGTH + self.discount * self.tables[context]
        return (customers - self.discount * tables + up * root) / (STRENGTH + self.customers[context])


class Cell:
    """The pairs of one cell and their seating."""

    def __init__(self, counts: bytes):
        self.word, self.context, c, names = _expand(counts)
        self.customers = c.astype(np.int64)
        self.word = self.word.astype(np.int64)
        self.words = int(self.word.max()) + 1 if len(self.word) else 0
        self.names = names
        self.keys = _mix(names[self.word] + (self.context.astype(np.uint64) + np.uint64(1)) * _M)
        self.tables = np.minimum(self.customers, 1)
        self.up = np.bincount(self.word, self.tables, self.words)
        self.root_tables = np.minimum(self.up, 1).astype(np.int64)

    def sweep(self, totals: Totals, nth: int) -> None:
        root = totals.root(self.up, self.root_tables)
        on = self.customers > 0
        others = np.maximum(0, totals.tables[self.context] - self.tables)
        self.tables[on] = resample(self.customers[on], others[on], root[self.word[on]], totals.discount, stirling(totals.discount, EXACT), Draws(self.keys[on], nth))
        self.up = np.bincount(self.word, self.tables, self.words)
        base = np.full(self.words, 1 / (totals.words + 1))
        others = np.maximum(0, totals.root_tables - self.root_tables)
        self.root_tables = resample(self.up.astype(np.int64), others, base, totals.root_discount, stirling(totals.root_discount, EXACT), Draws(self.names[: self.words], nth))


def _summary(cells: DataFrame, history: list[Totals]) -> list:
    """Totals after the sweeps of ``history``: small vectors, added on the executors."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, customers, rest = np.zeros(CONTEXTS), np.zeros(CONTEXTS), np.zeros(8)
        for batch in batches:
            for counts in batch.column("counts").to_pylist():
                cell = Cell(counts)
                for k, totals in enumerate(history):
                    cell.sweep(totals, k)
                tables += np.bincount(cell.context, cell.tables, CONTEXTS)
                customers += np.bincount(cell.context, cell.customers, CONTEXTS)
                known = np.bincount(cell.word, cell.customers, cell.words) > 0
                rest += [cell.customers.sum(), known.sum(), cell.root_tables.sum(), (cell.customers == 1).sum(), (cell.customers == 2).sum(), (cell.up == 1).sum(), (cell.up == 2).sum(), 0]
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((tables, customers, rest)).tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * CONTEXTS + 8)
        for batch in batches:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    got = cells.where("kind = 0").select("counts").mapInArrow(one, "sums binary").repartition(4).mapInArrow(add, "sums binary").collect()
    total = np.zeros(2 * CONTEXTS + 8)
    for r in got:
        total += np.frombuffer(r["sums"])
    return total[:CONTEXTS], total[CONTEXTS : 2 * CONTEXTS], total[2 * CONTEXTS :]


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / (ones + 2 * twos), 0.05, 0.95)) if ones + twos else 0.5


def score_documents(spark: SparkSession, docs: DataFrame, sweeps: int = 4, burn_in: int = 1) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Learned from documents whose id's crc32 modulo 7 is not 2. Null texts
    count as empty and have the end alone; repeated rows are learned from and
    scored once each; null ids count as empty text in the remainder; other
    columns are ignored; an empty table gives an empty one. Logs are decimal,
    and perplexity is 10 ** (-score / n_tokens).
    """
    n = parts(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (id_remainder(7) == 2).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = rows.mapInArrow(lambda b: _read(b, n), "cell int, block long, kind byte, data binary")
    cells = stored(spark, blocks.repartition(n, "cell").mapInArrow(_gather, _CELL_SCHEMA), "cells")
    history: list[Totals] = []
    discounts = rest = None
    for _ in range(sweeps + 1):
        tables, customers, rest = _summary(cells, history)
        discounts = discounts or (_discount(rest[3], rest[4]), _discount(rest[5], rest[6]))
        history.append(Totals(tables, customers, float(rest[2]), float(rest[1]), discounts))
    train_tokens, words = int(rest[0]), int(rest[1])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of each document's tokens in a cell, by block."""
        for batch in batches:
            for kind, block, data, counts in zip(*(batch.column(x).to_pylist() for x in _CELL_NAMES), strict=True):
                if kind:
                    yield _cell_row(1, block, data, b"")
                    continue
                cell = Cell(counts)
                p = np.zeros(len(cell.word))
                for k, totals in enumerate(history[:-1]):
                    cell.sweep(totals, k)
                    if k >= burn_in:
                        now = history[k + 1]
                        p += now.predict(cell.context, cell.customers, cell.tables, now.root(cell.up, cell.root_tables)[cell.word])
                logs = np.log10(p / (sweeps - burn_in))
                own = np.bincount(cell.word, cell.customers, cell.words)[cell.word]
                plain, known = np.log10(own + 1), (own > 0).astype(np.float64)
                (several,) = struct.unpack_from("<q", data)
                at = 8
                for _ in range(several):
                    name, size = struct.unpack_from("<qq", data, at)
                    d, pair = _expand(data[at + 16 : at + 16 + size])
                    at += 16 + size
                    d = np.cumsum(d, dtype=np.int64)
                    first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                    sums = [np.add.reduceat(x[pair], first) for x in (logs, plain, known)]
                    yield _cell_row(0, name, _squeeze(d[first].astype(np.uint32), sums[0], sums[1], sums[2].astype(np.uint32)), b"")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        told: dict[int, list] = {}
        for batch in batches:
            for kind, block, data in zip(*(batch.column(x).to_pylist() for x in ("kind", "block", "data")), strict=True):
                if kind:
                    told[block] = _expand(data)
                else:
                    sums.setdefault(block, []).append(data)
        for block, (ids, absent, held, lengths) in told.items():
            score, plain, known = (np.zeros(len(ids)) for _ in range(3))
            for data in sums.pop(block, []):
                d, a, b, c = _expand(data)
                score[d] += a
                plain[d] += b
                known[d] += c
            base = plain - lengths * np.log10(train_tokens + words + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=absent.astype(bool)), pa.array(held.astype(bool)), pa.array(lengths), pa.array(known.astype(np.int64)), pa.array(np.full(len(ids), train_tokens)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return cells.mapInArrow(apply, _CELL_SCHEMA).select("kind", "block", "data").repartition(n, "block").mapInArrow(add_up, schema)
