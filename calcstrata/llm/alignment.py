"""Cross-tokenizer alignment: which ids of two vocabularies cover the same bytes, and how often in the corpus.

Every text is cut by both tokenizers; token occurrences whose byte ranges
overlap are linked. The links of a block of documents become postings: for
each A id the B ids it meets, in which documents and how many times. Postings
are shuffled by A id and arrive as streams that Spark sorts, so that all of an
A id's pairs are counted where they meet and its highest count is known there.
What each posting adds to its document is summed in the task, goes back by
block, and is summed once more.

An A id with a large share of all postings is dealt out over several tasks;
its pairs are then counted ahead by a sum that combines on the map side, and
each of these tasks reads the counts before the postings.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts, stored, then_give_back
from .tokens import WordCache, _byte_letters

_CUT = re.compile(r"(?<=\S)(?=[ \n])")
_UNCLEAR = re.compile(r"\s[ \n]")
_SPACE = "▁"
_MARKS = ".,!?;:|"
#: Texts whose links are worked out at once, and texts whose postings are put together.
PART_BYTES, BLOCK_BYTES = 1 << 20, 8 << 20
POSTINGS_A_ROW = 2048
SUMS_AT_ONCE = 1 << 20
#: A pair of ids and the place of a document in its block share 56 bits.
ID_BITS = 20

ALIGNED = "block bigint, a int, n int, b binary, docs binary, mult binary, at int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"


class Aligner:
    """Ids of texts in two vocabularies, remembered by unit of text, and the links between them.

    Neither vocabulary has a token over the border between a character that
    is no white space and a following blank or line feed, so the ids of a
    text are those of the units between such borders.
    """

    def __init__(self, path_a: str, path_b: str, most_units: int = 250_000):
        import sentencepiece

        self.words = WordCache(path_a)  # it keeps the library to one thread: waiting threads of every worker took a quarter of the time
        self.words.code = "i"
        self.a = self.words.tokenizer
        letters = {c: b for b, c in _byte_letters().items()}
        self.bytes_a = [bytes(letters[c] for c in t) if t is not None and all(c in letters for c in t) else (t or "").encode() for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        piece = self.b.id_to_piece
        self.bytes_b = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace(_SPACE, " ").encode() for i in range(self.b.get_piece_size())]
        if max(len(self.bytes_a), len(self.bytes_b)) > 1 << ID_BITS:
            raise ValueError(f"vocabularies of more than {1 << ID_BITS} ids")
        self.sizes = [np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b)]
        #: How an id is written: an A id before another or before its group's B ids, a B id before another or at its group's end.
        self.written = np.array([f"{i}{mark}" for own, marks in ((self.bytes_a, ",|"), (self.bytes_b, ",;")) for mark in marks for i in range(len(own))], object)
        self.firsts = [np.cumsum(x) - x for x in self.sizes]
        self.spellings = [np.frombuffer(b"".join(own), np.uint8) for own in (self.bytes_a, self.bytes_b)]
        self.space_b, self.line_b = self.b.piece_to_id(_SPACE), self.b.encode("\n")
        inner = {y for i in range(self.b.get_piece_size()) if not self.b.is_byte(i) for x, y in pairwise(piece(i)) if x.isalpha()}
        self.marks = "".join(c for c in _MARKS if c not in inner)
        self.most = most_units
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _ids_b(self, units: list[str]) -> list[list[int]]:
        """B puts a blank before what it is given: that is a unit's own blank, or it is taken away again with a line feed, which joins no token."""
        out = self.b.encode([u[1:] if u[0] == " " else "\n" + u for u in units], num_threads=1)
        for i, u in enumerate(units):
            if u == " ":
                out[i] = [self.space_b]
            elif u[0] != " ":
                out[i] = out[i][len(self.line_b) :]
        return out

    def _ids_a(self, units: list[str]) -> list[bytes]:
        """A word of letters, which a byte-level vocabulary does not cut, goes to the model alone; the rest through the whole of A."""
        out = [self.words._word(u) for u in units] if self.words.kind == "spaced" else [None] * len(units)
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.a.encode_batch_fast([units[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("i", e.ids).tobytes()
        return out

    def _encode(self, units: list[str]) -> list[tuple[bytes, bytes]]:
        """Both sides' ids of each unit as 32-bit integers."""
        out = []
        for i in range(0, len(units), 5000):
            own = units[i : i + 5000]
            out += zip(self._ids_a(own), (array("i", b).tobytes() for b in self._ids_b(own)), strict=True)
        return out

    def _learn(self, units: set[str]) -> None:
        """A closing mark after a letter starts a token on both sides, so a word and its marks are learned once each."""
        known, split, need = self.known, [], set()
        for u in units.difference(known):
            core = u.rstrip(self.marks)
            if core != u and core and core[-1].isalpha():
                tail = u[len(core) :]
                split.append((u, core, tail))
                need.update(x for x in (core, tail) if x not in known)
            else:
                need.add(u)
        need = list(need)
        known.update(zip(need, self._encode(need), strict=True))
        for u, core, tail in split:
            a, b = known[core], known[tail]
            known[u] = a[0] + b[0], a[1] + b[1]

    def ids(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """Both sides' ids of each text as 32-bit integers; None without text."""
        if len(self.known) > self.most:
            self.known.clear()
        cut = []
        for t in texts:
            if not t:
                cut.append(None)
            elif _UNCLEAR.search(" " + t) or "\0" in t:
                cut.append(_CUT.split(" " + t))
            else:  # the same cuts, found faster
                units = []
                for x in t.split("\n"):
                    words = x.replace(" ", "\0 ").split("\0")
                    words[0] = ("\n" if units else " ") + words[0]
                    units += words
                cut.append(units)
        self._learn(set().union(*(u for u in cut if u)))
        find = self.known.__getitem__
        return [tuple(map(b"".join, zip(*map(find, units), strict=True))) if units else None for units in cut]

    def _spells(self, text: str, found: tuple[bytes, bytes]) -> bool:
        return all(b"".join(map(own.__getitem__, np.frombuffer(ids, np.int32).tolist())) == text.encode() for own, ids in zip((self.bytes_a, self.bytes_b), found, strict=True))

    def spelt(self, texts: list[str | None]) -> list[tuple[bytes, bytes] | None]:
        """``ids``, but None for texts that one side's tokens do not spell.

        All texts are compared at once; one that differs is encoded whole and
        looked at by itself.
        """
        found = self.ids(texts)
        want = [(" " + t).encode() if t else b"" for t in texts]
        bad = np.zeros(len(texts), bool)
        size = np.array([len(w) for w in want])
        for side, (sizes, table, first) in enumerate(zip(self.sizes, self.spellings, self.firsts, strict=True)):
            ids = np.frombuffer(b"".join(x[side] for x in found if x), np.int32)
            n = np.array([len(x[side]) // 4 if x else 0 for x in found])
            own = sizes[ids]
            held = np.diff(np.r_[0, np.cumsum(own)][np.r_[0, np.cumsum(n)]])
            bad |= held != size
            start = np.cumsum(own) - own
            got = table[np.repeat(first[ids] - start, own) + np.arange(own.sum())]
            same = (held == size).tolist()
            stop = np.cumsum(held).tolist()
            for i, (w, ok, j) in enumerate(zip(want, same, stop, strict=True)):
                if ok and w and got[j - len(w) : j].tobytes() != w:
                    bad[i] = True
        for i in np.flatnonzero(bad).tolist():
            whole = " " + texts[i]
            one = self._encode([whole])[0]
            found[i] = one if self._spells(whole, one) else None
        return found

    def links(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(n_a, n_b, n_groups, n_links of each text in rows), digests of groups, and links as sorted distinct keys with counts.

        A key holds A id, B id and the text's place. All texts are laid end to
        end: between two neighbouring token ends, of either side, lies one
        pair of overlapping tokens, and a group ends where both sides end.
        """
        found = self.spelt(texts)
        a, b = (np.frombuffer(b"".join(x[side] for x in found if x), np.int32).astype(np.int64) for side in (0, 1))
        n_a, n_b = (np.array([len(x[side]) // 4 if x else 0 for x in found], np.int64) for side in (0, 1))
        end_a, end_b = (np.cumsum(sizes[ids]) for sizes, ids in zip(self.sizes, (a, b), strict=True))
        ends = np.sort(np.concatenate([end_a, end_b]), kind="stable")
        ends = ends[np.r_[True, ends[1:] != ends[:-1]]] if len(ends) else ends
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        shared = (end_a[at_a] == ends) & (end_b[at_b] == ends)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[at_a[shared]] = last_b[at_b[shared]] = True
        over_a = np.r_[0, np.cumsum(n_a)]
        stops = np.r_[0, end_a][over_a]  # where each text ends, in bytes
        over = np.searchsorted(ends, stops, "right")
        over_groups = np.r_[0, np.cumsum(shared)][over]
        place = np.repeat(np.arange(len(found)), np.diff(over))
        keys, counts = np.unique(a[at_a] << ID_BITS + 16 | b[at_b] << 16 | place, return_counts=True)
        group_a, group_b = (np.cumsum(last) - last for last in (last_a, last_b))
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        size_a, size_b = map(len, self.sizes)
        written = self.written[np.concatenate([a + size_a * last_a, 2 * size_a + b + size_b * last_b])[order]].tolist()
        over_written = np.r_[0, np.cumsum(n_a + n_b)].tolist()
        digests = [hashlib.sha256("".join(written[i:j])[:-1].encode()).hexdigest() if j > i else "" for i, j in zip(over_written, over_written[1:], strict=False)]
        return np.stack([n_a, n_b, np.diff(over_groups), np.diff(over)]), digests, keys, counts


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _blocks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of bytes, or one row, and at most 65,536 rows."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(sizes):
        last = max(first + 1, min(first + (1 << 16), int(np.searchsorted(sizes, (sizes[first - 1] if first else 0) + most, "right"))))
        yield batch.slice(first, last - first)
        first = last


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The array cut at ``bounds`` into binary values."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _postings(block: int, keys: np.ndarray, mult: np.ndarray) -> list[pa.Array]:
    """block, a, n, b, docs, mult of a block's links (as ``Aligner.links`` counts them), in rows of one A id and a bounded number of postings."""
    order = np.argsort(keys, kind="stable")
    keys, mult = keys[order], mult[order].astype(np.uint32)
    a, b, docs = (keys >> ID_BITS + 16).astype(np.int32), (keys >> 16 & (1 << ID_BITS) - 1).astype(np.int32), (keys & 0xFFFF).astype(np.uint16)
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    size = np.diff(np.r_[starts, len(a)])
    rows = -(-size // POSTINGS_A_ROW)
    inner = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
    bounds = np.r_[np.repeat(starts, rows) + POSTINGS_A_ROW * inner, len(a)]
    return [pa.array(np.full(len(bounds) - 1, block)), pa.array(a[bounds[:-1]]), pa.array(np.diff(bounds).astype(np.int32)), _binary(b, bounds), _binary(docs, bounds), _binary(mult, bounds)]


def _aligned(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, most_units: int) -> DataFrame:
    """Rows of documents (a is null) and rows of postings, stored."""
    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 5, pa.string()]
    names = [c.split()[0] for c in ALIGNED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path_a, path_b) not in _ALIGNERS:
            _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
        aligner = _ALIGNERS[path_a, path_b]
        aligner.most = most_units
        block = TaskContext.get().partitionId() << 24
        for batch in batches:
            for whole in _blocks(batch, BLOCK_BYTES):
                at, keys, mult, block = 0, [], [], block + 1
                for part in _blocks(whole, PART_BYTES):
                    numbers, digests, own, n = aligner.links(part.column(1).to_pylist())
                    keys.append(own + at)
                    mult.append(n)
                    n = len(digests)
                    row = [pa.array(np.full(n, block)), *(pa.nulls(n, t) for t in types[1:6]), pa.array(np.arange(at, at + n, dtype=np.int32)), part.column(0), *map(pa.array, numbers), pa.array(digests)]
                    yield pa.RecordBatch.from_arrays(row, names)
                    at += n
                keys, mult = np.concatenate(keys), np.concatenate(mult)
                if len(keys):
                    arrays = _postings(block, keys, mult)
                    yield pa.RecordBatch.from_arrays([*arrays, *(pa.nulls(len(arrays[0]), t) for t in types[6:])], names)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(spark, rows.mapInArrow(then_give_back(run), ALIGNED), "aligned")


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, n): in how many of a row's documents each pair is; a pair has one posting a document."""
    for batch in batches:
        out = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids, n = np.unique(np.frombuffer(b, np.int32), return_counts=True)
            out.append((np.full(len(ids), a, np.int32), ids, n))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["a", "b", "n"])


def _sums(keys: list[np.ndarray], best: list[np.ndarray], total: list[np.ndarray]) -> pa.RecordBatch:
    """block, docs, best, total: what the postings add to each document, in one row a block."""
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    out = [np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)]
    for to, x in zip(out, (best, total), strict=True):
        np.add.at(to, inverse, np.concatenate(x))
    block = k >> 16
    bounds = np.r_[np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(k)].astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(block[bounds[:-1]]), _binary((k & 0xFFFF).astype(np.uint16), bounds), *(_binary(x, bounds) for x in out)], ["block", "docs", "best", "total"])


def _contributions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted postings, and counts before those of ids dealt out; sums by block and document, in bounded numbers."""
    held, counts, key, size = [], None, None, 0
    out: tuple[list, list, list] = ([], [], [])

    def add(b: np.ndarray, where: np.ndarray, mult: np.ndarray, seen: np.ndarray, most: int) -> None:
        nonlocal size
        out[0].append(where)
        out[1].append(np.where(seen == most, mult, 0))
        out[2].append(mult * seen)
        size += len(b)

    def close() -> None:
        if held:
            b, where, mult = (np.concatenate(x) for x in zip(*held, strict=True))
            _, inverse, n = np.unique(b, return_inverse=True, return_counts=True)
            add(b, where, mult, n[inverse], n.max())
            held.clear()

    for batch in batches:
        names = ("a", "salt", "block", "b", "docs", "mult", "ids", "counts")
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]
        for a, salt, block, b, docs, mult, ids, n in zip(*columns, strict=True):
            if key != (a, salt):
                close()
                key, counts = (a, salt), None
            if ids is not None:
                counts = np.array(ids), np.array(n, np.int64)
                continue
            b = np.frombuffer(b, np.int32)
            where = np.frombuffer(docs, np.uint16).astype(np.int64) | block << 16
            mult = np.frombuffer(mult, np.uint32).astype(np.int64)
            if counts is None:
                held.append((b, where, mult))
            else:
                add(b, where, mult, counts[1][np.searchsorted(counts[0], b)], counts[1].max())
            if size >= SUMS_AT_ONCE:
                yield _sums(*out)
                out, size = ([], [], []), 0
    close()
    if size:
        yield _sums(*out)


def _by_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sums sorted by block to one row for each document of it."""
    names, at, sums = ["block", "at", "n_best", "count_sum"], None, None

    def done() -> pa.RecordBatch:
        here = np.flatnonzero(sums[1])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(here), at)), pa.array(here.astype(np.int32)), pa.array(sums[0][here]), pa.array(sums[1][here])], names)

    for batch in batches:
        for block, docs, best, total in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if block != at:
                if at is not None:
                    yield done()
                at, sums = block, np.zeros((2, 1 << 16), np.int64)
            docs = np.frombuffer(docs, np.uint16)
            sums[0][docs] += np.frombuffer(best, np.int64)
            sums[1][docs] += np.frombuffer(total, np.int64)
    if at is not None:
        yield done()


def align(spark: SparkSession, docs: DataFrame, path_a: str, path_b: str, shares: int = 4, most_units: int = 250_000) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of ``docs``.

    A: a byte-level vocabulary for the tokenizers library, given a blank and
    the text; B: a sentencepiece model, which adds the blank itself. A and B
    tokens whose byte ranges overlap are linked. The count of a pair of ids is
    the number of rows of ``docs`` that hold it linked. n_best: links whose
    count is the highest of their A id, ties included; count_sum: the counts
    of all links.

    Texts that are null or empty, or whose tokens do not spell them, have
    zeros and an empty digest; repeated rows count as documents of their own;
    a null doc_id stays null; an empty table gives no rows; other columns are
    ignored. An A id with over 1 / (``shares`` x partitions) of all postings
    is dealt out, so at most so many ids are; ``most_units`` bounds what a
    worker remembers and changes no result.
    """
    aligned = _aligned(spark, docs, path_a, path_b, most_units)
    posts = aligned.where("a is not null").select("a", "block", "n", "b", "docs", "mult")
    n = parts(spark)
    per_id = posts.groupBy("a").agg(F.sum("n").alias("n_posts"))  # at most one row for each id of the vocabulary
    total = per_id.agg(F.sum("n_posts")).first()[0] or 0
    most = max(1, total // (shares * n))
    hot = stored(spark, per_id.where(F.col("n_posts") > most).select("a", F.ceil(F.col("n_posts") / most).cast("int").alias("salts")), "hot-ids")
    hot_side = F.broadcast(hot)  # at most shares * n rows
    counted = posts.join(hot_side, "a", "left_semi").select("a", "b").mapInArrow(_pair_counts, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
    # lists of at most as many B ids as the vocabulary has
    counted = counted.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("bs")).join(hot_side, "a")
    counted = counted.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("bs.b").alias("ids"), F.col("bs.n").alias("counts"))
    salt = F.coalesce(F.pmod(F.xxhash64("block"), F.col("salts")), F.lit(0)).cast("int")
    streams = posts.join(hot_side, "a", "left").select("a", salt.alias("salt"), "block", "b", "docs", "mult").unionByName(counted, allowMissingColumns=True)
    streams = streams.repartition(n, "a", "salt").sortWithinPartitions("a", "salt", F.col("ids").isNull())
    sums = streams.mapInArrow(then_give_back(_contributions), "block bigint, docs binary, best binary, total binary")
    sums = sums.repartition(n, "block").sortWithinPartitions("block").mapInArrow(then_give_back(_by_document), "block bigint, at int, n_best bigint, count_sum bigint")
    own = aligned.where("a is null").select("block", "at", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = own.join(sums, ["block", "at"], "left")
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")), "groups_sha256")
