"""Repeated passages across documents, by a distributed merge sort of suffixes.

A byte is removed if a string of ``length`` bytes over it also starts in a
document with a smaller id. Four steps, one Spark query:

1. Anchors. In every window of ``length`` bytes the least hashed gram is its
   anchor, so equal windows have the same anchor at the same place. Sorted
   hashes are exchanged, and a document learns which of its anchors occur in
   another document. All later work is on these.
2. Runs. Each group of documents sorts the suffixes that start at its
   anchors, keeps one of several with the same surroundings, and sends front-
   coded runs: the common prefix with the suffix before, then the rest.
3. Merge. A loser tree combines the runs. Each loser keeps its common prefix
   with the winner that beat it, so characters known to be equal are never
   compared again, and the merged order comes with its prefix lengths. They
   cut the order into equal right parts; with the bytes on the left they tell
   for each window that the anchor stands for whether a smaller id has it.
4. Removal, where the documents of step 2 are (the same exchange is reused).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, parts, then_give_back

GRAM = 20
_M = np.uint64(0x9E3779B97F4A7C15)
_M2 = np.uint64(int(_M) ** 2 & 0xFFFFFFFFFFFFFFFF)
_BYTES = np.random.default_rng(3).integers(0, 2**64, 256, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slide(x: np.ndarray, size: int, pick) -> np.ndarray:
    """The least or greatest of each ``size`` neighbours."""
    reach = 1
    while reach * 2 <= size:
        x = pick(x[:-reach], x[reach:])
        reach *= 2
    rest = size - reach
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes (48 bits) of the anchors of all windows; every tie is an anchor."""
    span = length - GRAM + 1
    if len(data) < length:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h1 = _BYTES[np.frombuffer(data, np.uint8)]
    h2 = h1[:-1] * _M + h1[1:]
    h4 = h2[:-2] * _M2 + h2[2:]
    h8 = _mix(h4)[:-4] * _M + h4[4:]
    h16 = _mix(h8)[:-8] * _M + h8[8:]
    h = _mix(h16[:-4] * _M + h4[16:]) >> np.uint64(16)
    least = _slide(h, span, np.minimum)
    padded = np.concatenate((np.zeros(span - 1, np.uint64), least, np.zeros(span - 1, np.uint64)))
    at = np.flatnonzero(h == _slide(padded, span, np.maximum))
    return at, h[at]


def _squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: the bytes of each place in the numbers together, compressed."""
    out = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        planes = raw.view(np.uint8).reshape(len(raw), -1).T.tobytes() if len(raw) else b""
        out.append(struct.pack("<4sQ", raw.dtype.str.encode().ljust(4), len(raw)) + planes)
    return zstandard.compress(b"".join(struct.pack("<Q", len(x)) + x for x in out), 1)


def _expand(data: bytes) -> list[np.ndarray]:
    raw, at, out = zstandard.decompress(data), 0, []
    while at < len(raw):
        (size,) = struct.unpack_from("<Q", raw, at)
        kind, n = struct.unpack_from("<4sQ", raw, at + 8)
        dtype = np.dtype(kind.decode().strip())
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at + 20).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += 8 + size
    return out


def _deltas(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def _batch(keys: list[int], blobs: list[bytes], name: str, kinds: list[int] | None = None) -> pa.RecordBatch:
    columns, names = [pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], [name, "data"]
    if kinds is not None:
        columns.append(pa.array(kinds, pa.int8()))
        names.append("kind")
    return pa.RecordBatch.from_arrays(columns, names)


def _grouped(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(key, places) for each key."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for places in np.split(order, cuts) if len(order) else []:
        yield int(key[places[0]]), places


def _replies(docs: np.ndarray, hashes: np.ndarray, homes: int) -> Iterator[tuple[int, bytes]]:
    """(home, packed (document key, hash) pairs), each pair once."""
    order = np.lexsort((hashes, docs))
    docs, hashes = docs[order], hashes[order]
    new = np.ones(len(docs), dtype=bool)
    new[1:] = (docs[1:] != docs[:-1]) | (hashes[1:] != hashes[:-1])
    docs, hashes = docs[new], hashes[new]
    for home, at in _grouped(np.mod(docs, homes)):
        yield home, _squeeze(_deltas(docs[at]), hashes[at])


def _ask(batches: Iterator[pa.RecordBatch], length: int, cells: int, homes: int, block: int = 12_000_000) -> Iterator[pa.RecordBatch]:
    """Step 1, where documents are read: what to ask (kind 0), and what is known at once (kind 1)."""
    keys, ids, hashes, owner, size = [], [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not hashes:
            return
        doc_key, doc_id = np.array(keys, np.int64), np.array(ids, np.int64)
        h, o = np.concatenate(hashes), np.repeat(np.arange(len(keys), dtype=np.uint32), owner)
        order = np.lexsort((doc_id[o], h))
        h, o = h[order], o[order]
        start = np.ones(len(h), dtype=bool)
        start[1:] = h[1:] != h[:-1]
        group = np.cumsum(start) - 1
        first = doc_id[o[start]]
        several = np.zeros(int(start.sum()), dtype=bool)
        np.logical_or.at(several, group, doc_id[o] != first[group])
        known = several[group]
        names, blobs, kinds = [], [], []
        for home, data in _replies(doc_key[o[known]], h[known], homes) if known.any() else []:
            names.append(home % cells)
            blobs.append(struct.pack("<i", home) + data)
            kinds.append(1)
        # one document stands for those of this block that share the hash; with one document, only its first place
        sent = start
        h, o = h[sent], o[sent]
        for cell, at in _grouped((h % np.uint64(cells)).astype(np.int64)):
            used, index = np.unique(o[at], return_inverse=True)
            names.append(cell)
            blobs.append(_squeeze(_deltas(h[at]), index.astype(np.uint16 if len(used) < 65536 else np.uint32), doc_key[used], doc_id[used]))
            kinds.append(0)
        for i in range(0, len(names), 64):
            yield _batch(names[i : i + 64], blobs[i : i + 64], "cell", kinds[i : i + 64])

    for batch in batches:
        for key, doc, text in zip(*(batch.column(x).to_pylist() for x in ("key", "doc_id", "text")), strict=True):
            data = text.encode("utf-8", "surrogatepass")
            _, h = anchors(data, length)
            if len(h):
                h = np.unique(h)
                keys.append(key)
                ids.append(doc)
                hashes.append(h)
                owner.append(len(h))
                size += len(data)
                if size > block:
                    yield from flush()
                    keys, ids, hashes, owner, size = [], [], [], [], 0
    yield from flush()


def _answer(batches: Iterator[pa.RecordBatch], homes: int) -> Iterator[pa.RecordBatch]:
    """Step 1, where hashes meet: each document's hashes that another document has."""
    h, key, doc = [], [], []
    for batch in batches:
        names, blobs = [], []
        for data, kind in zip(batch.column("data").to_pylist(), batch.column("kind").to_pylist(), strict=True):
            if kind:
                names.append(struct.unpack_from("<i", data)[0])
                blobs.append(data[4:])
            else:
                delta, index, keys, ids = _expand(data)
                h.append(np.cumsum(delta, dtype=np.uint64))
                key.append(keys[index])
                doc.append(ids[index])
        if names:
            yield _batch(names, blobs, "home")
    if not h:
        return
    h, key, doc = np.concatenate(h), np.concatenate(key), np.concatenate(doc)
    order = np.argsort(h, kind="stable")
    h, key, doc = h[order], key[order], doc[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    several = np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start)
    known = np.repeat(several, np.diff(np.append(start, len(h))))
    names, blobs = [], []
    for home, data in _replies(key[known], h[known], homes) if known.any() else []:
        names.append(home)
        blobs.append(data)
        if len(names) == 64:
            yield _batch(names, blobs, "home")
            names, blobs = [], []
    if names:
        yield _batch(names, blobs, "home")


def _common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix, of which ``known`` bytes are not looked at."""
    most = min(len(a), len(b))
    if a[known:most] == b[known:most]:
        return most
    while a[known : known + 8] == b[known : known + 8]:
        known += 8
    while known < most and a[known] == b[known]:
        known += 1
    return known


class Run:
    """A front-coded sorted run: common prefix with the suffix before, and the rest."""

    def __init__(self, prefix: np.ndarray, rest_length: np.ndarray, rest: bytes):
        self.prefix, self.size = prefix.tolist(), len(prefix)
        ends = np.cumsum(rest_length.astype(np.int64))
        self.rest = [rest[a:b] for a, b in zip((ends - rest_length).tolist(), ends.tolist(), strict=True)]
        self.at, self.now = -1, b""

    def step(self) -> int:
        """The next suffix becomes ``now``; its common prefix with the one before, or -1 at the end."""
        self.at += 1
        if self.at >= self.size:
            return -1
        p = self.prefix[self.at]
        self.now = self.now[:p] + self.rest[self.at]
        return p


def front_code(suffixes: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(prefix lengths, rest lengths, rests) of sorted suffixes."""
    prefix, rest, before = [], [], b""
    for s in suffixes:
        p = _common(before, s, 0)
        prefix.append(p)
        rest.append(s[p:])
        before = s
    return np.array(prefix, np.uint8), np.array([len(r) for r in rest], np.uint8), b"".join(rest)


def merge_runs(runs: list[Run]) -> tuple[list[int], list[int]]:
    """(run of each suffix, common prefix with the suffix before) in merged order.

    A loser's prefix length is that with the winner that beat it, which is the
    suffix last put out when the loser is next met. Of two with different
    lengths the longer one is smaller; equal lengths are compared from there.
    """
    k = 1
    while k < len(runs):
        k *= 2
    prefix = [run.step() for run in runs] + [-1] * (k - len(runs))
    loser = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)."""
        pa_, pb = prefix[a], prefix[b]
        if pa_ != pb:
            return (a, b) if pa_ > pb else (b, a)
        if pa_ < 0:
            return a, b
        x, y = runs[a].now, runs[b].now
        n = _common(x, y, pa_)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            prefix[b] = n
            return a, b
        prefix[a] = n
        return b, a

    seat = list(range(k))
    winners = [0] * k + seat
    for node in range(k - 1, 0, -1):
        winners[node], loser[node] = play(winners[2 * node], winners[2 * node + 1])
    top = winners[1] if k > 1 else 0
    out, lengths = [], []
    while prefix[top] >= 0:
        out.append(top)
        lengths.append(prefix[top])
        prefix[top] = runs[top].step()
        node = (top + k) >> 1
        while node:
            other = loser[node]
            a, b = prefix[top], prefix[other]
            if a < b:
                loser[node], top = top, other
            elif a == b and a >= 0:
                top, loser[node] = play(top, other)
            node >>= 1
    return out, lengths


def _rows(docs: pa.Table, names: tuple[str, ...], step: int = 256) -> Iterator[tuple]:
    """Rows of a table, a few at a time as Python values."""
    for i in range(0, docs.num_rows, step):
        part = docs.slice(i, step)
        yield from zip(*(part.column(x).to_pylist() for x in names), strict=True)


def _sort_runs(docs: pa.Table, replies: pa.Table, length: int, cells: int, run_rows: int = 100_000) -> pa.Table:
    """Step 2 for one home: sorted runs for each cell (kind 0), and windows known to repeat (kind 1)."""
    span = length - GRAM + 1
    flagged: dict[int, list[np.ndarray]] = {}
    for data in replies.column("data").to_pylist():
        delta, hashes = _expand(data)
        keys = np.cumsum(delta, dtype=np.int64)
        cuts = np.flatnonzero(np.diff(keys)) + 1
        for k, hs in zip(keys[np.concatenate(([0], cuts))].tolist(), np.split(hashes, cuts), strict=True):
            flagged.setdefault(k, []).append(hs)
    home = int(docs.column("home")[0].as_py()) if docs.num_rows else 0
    found: list[tuple] = []
    done = set()
    names, blobs, kinds = [], [], []

    def flush() -> None:
        """Sort and send what is gathered; one document stands for equal surroundings, the others are known to repeat."""
        least: dict[tuple[bytes, bytes], int] = {}
        for right, left, _, _, doc, _ in found:
            if doc < least.setdefault((right, left), doc):
                least[right, left] = doc
        sent: dict[int, list] = {}
        known = []
        for r in found:
            if r[4] == least[r[0], r[1]]:
                sent.setdefault(r[2], []).append(r)
            else:
                known.append((r[3], r[5], _valid_offsets(len(r[0]), len(r[1]), length)))
        for cell, rows in sent.items():
            rows.sort()
            names.append(cell)
            kinds.append(0)
            blobs.append(_packed_run(rows))
        if known:
            names.append(home % cells)
            kinds.append(1)
            blobs.append(struct.pack("<i", home) + _squeeze(np.array([k[0] for k in known], np.int64), np.array([k[1] for k in known], np.uint32), np.array([k[2] for k in known], np.uint64)))
        found.clear()

    for key, doc, text in _rows(docs, ("key", "doc_id", "text")):
        if doc is None or key not in flagged or key in done:
            continue
        done.add(key)  # a repeated row has the same key
        data = text.encode("utf-8", "surrogatepass")
        at, h = anchors(data, length)
        on = np.isin(h, np.concatenate(flagged[key]))
        for a, hash_ in zip(at[on].tolist(), h[on].tolist(), strict=True):
            right, left = data[a : a + length], data[max(0, a - span + 1) : a]
            if len(left) + len(right) >= length:
                found.append((right, left, hash_ % cells, key, doc, a))
        if len(found) >= run_rows:
            flush()
    flush()
    flagged.clear()
    give_back()
    return pa.Table.from_batches([_batch(names, blobs, "cell", kinds)])


def _packed_run(rows: list[tuple]) -> bytes:
    prefix, rest_length, rest = front_code([r[0] for r in rows])
    keys, index = np.unique(np.array([r[3] for r in rows], np.int64), return_inverse=True)
    ids = np.empty(len(keys), np.int64)
    ids[index] = [r[4] for r in rows]
    left = b"".join(r[1] for r in rows)
    return _squeeze(
        prefix, rest_length, np.frombuffer(rest, np.uint8), np.array([len(r[1]) for r in rows], np.uint8), np.frombuffer(left, np.uint8),
        index.astype(np.uint32), keys, ids, np.array([r[5] for r in rows], np.uint32),
    )


def _valid_offsets(right: int, left: int, length: int) -> int:
    """Bits o for which the window that starts o bytes before the anchor lies in the document."""
    low, high = max(0, length - right), min(left, length - GRAM)
    return ((1 << (high + 1)) - (1 << low)) if high >= low else 0


def _merge(batches: Iterator[pa.RecordBatch], length: int, homes: int) -> Iterator[pa.RecordBatch]:
    """Step 3: merge the runs of a partition and find the windows that a smaller id has."""
    runs, parts_ = [], []
    for batch in batches:
        names, blobs = [], []
        for data, kind in zip(batch.column("data").to_pylist(), batch.column("kind").to_pylist(), strict=True):
            if kind:
                names.append(struct.unpack_from("<i", data)[0])
                blobs.append(data[4:])
            else:
                prefix, rest_length, rest, left_length, left, index, keys, ids, at = _expand(data)
                runs.append(Run(prefix, rest_length, rest.tobytes()))
                parts_.append((prefix.astype(np.int64) + rest_length, left_length.astype(np.int64), left, keys[index], ids[index], at))
        if names:
            yield _batch(names, blobs, "home")
    if not runs:
        return
    order, lengths = merge_runs(runs)
    run = np.array(order)
    base = np.cumsum([0] + [r.size for r in runs])
    nth = np.empty(len(run), np.int64)
    for _, places in _grouped(run):
        nth[places] = np.arange(len(places))
    take = base[run] + nth
    right_length, left_length, key, doc, at = (np.concatenate([p[i] for p in parts_])[take] for i in (0, 1, 3, 4, 5))
    left_all = np.concatenate([p[2] for p in parts_])
    left_end = np.cumsum(np.concatenate([p[1] for p in parts_]))[take]
    prefix = np.array(lengths, np.int64)
    mask = np.zeros(len(take), np.uint64)
    left_hash = np.zeros(len(take), np.uint64)
    for o in range(length - GRAM + 1):
        if o:
            has = left_length >= o
            byte = np.zeros(len(take), np.uint8)
            byte[has] = left_all[left_end[has] - o]
            left_hash = _mix(left_hash * _M + byte + np.uint64(1))
        need = length - o
        block = np.cumsum(prefix < need).astype(np.uint64)
        ok = np.flatnonzero((right_length >= need) & (left_length >= o))
        if len(ok) < 2:
            continue
        both = _mix(block[ok] * _M + left_hash[ok])
        by = np.argsort(both, kind="stable")
        start = np.flatnonzero(np.concatenate(([True], both[by][1:] != both[by][:-1])))
        low = np.repeat(np.minimum.reduceat(doc[ok][by], start), np.diff(np.append(start, len(by))))
        hit = ok[by][doc[ok][by] > low]
        mask[hit] |= np.uint64(1 << o)
    hit = np.flatnonzero(mask)
    names, blobs = [], []
    for home, places in _grouped(np.mod(key[hit], homes)):
        own = hit[places]
        names.append(home)
        blobs.append(_squeeze(key[own], at[own].astype(np.uint32), mask[own]))
    for i in range(0, len(names), 64):
        yield _batch(names[i : i + 64], blobs[i : i + 64], "home")


def _remove(docs: pa.Table, flags: pa.Table, length: int, as_text: bool) -> pa.Table:
    """Step 4 for one home: what is left of each document."""
    got = [_expand(x) for x in flags.column("data").to_pylist()]
    starts: dict[int, np.ndarray] = {}
    if got:
        key, at, mask = (np.concatenate([g[i] for g in got]) for i in range(3))
        for k, places in _grouped(key):
            a, m = at[places].astype(np.int64), mask[places]
            starts[k] = np.unique(np.concatenate([a[(m >> np.uint64(o)) & np.uint64(1) > 0] - o for o in range(length - GRAM + 1)]))
    more = [x for x in docs.column_names if x not in ("home", "key", "doc_id", "text")]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", *more]
    out = []
    for i in range(0, docs.num_rows, 256):
        part = docs.slice(i, 256)
        sizes, removed, spans, kept = [], [], [], []
        for k, doc, text in _rows(part, ("key", "doc_id", "text")):
            data = text.encode("utf-8", "surrogatepass")
            sizes.append(len(data))
            s = starts.get(k) if doc is not None else None
            if s is None:
                removed.append(0)
                spans.append(0)
                kept.append(data)
                continue
            depth = np.zeros(len(data) + 1, np.int32)
            depth[s] += 1
            depth[s + length] -= 1
            gone = np.cumsum(depth)[:-1] > 0
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[0]))
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        left = pa.array((x.decode("utf-8", "ignore") for x in kept), pa.string()) if as_text else pa.array(kept, pa.binary())
        out.append(pa.table([part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), left, *(part.column(x) for x in more)], names=names))
    del starts, got
    give_back()
    return pa.concat_tables(out)


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 50, carry: dict[str, str] | None = None, as_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): each text without the passages that a smaller doc_id has.

    ``carry`` names columns of ``docs`` to take along, and what to call them.
    kept is bytes, or with ``as_text`` a string without the characters that
    were cut in two.

    Texts are UTF-8 bytes; null texts count as empty; matches never cross
    documents; texts shorter than ``length`` are left whole. Repeated rows
    and rows of one doc_id never remove each other's bytes and come out once
    each. Rows with a null doc_id come out whole and remove nothing. Other
    columns are ignored; an empty table gives an empty one.
    """
    if length - GRAM + 1 > 63 or length > 255 or length < GRAM + 1:
        raise ValueError("length must be from 21 to 82")
    cells = parts(spark)
    homes = cells  # with more, messages between cells and homes would grow faster than the data
    taken = [F.col(x).alias(y) for x, y in (carry or {}).items()]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *taken).withColumn("key", F.xxhash64("doc_id", "text"))
    rows = rows.withColumn("home", F.pmod("key", F.lit(homes)).cast("int"))
    asked = rows.where("doc_id is not null").select("key", "doc_id", "text").mapInArrow(then_give_back(lambda b: _ask(b, length, cells, homes)), "cell int, data binary, kind byte")
    answers = asked.repartition(cells, "cell").mapInArrow(then_give_back(lambda b: _answer(b, homes)), "home int, data binary")
    by_home = rows.groupBy("home")
    runs = by_home.cogroup(answers.groupBy("home")).applyInArrow(lambda d, r: _sort_runs(d, r, length, cells), "cell int, data binary, kind byte")
    flags = runs.repartition(cells, "cell").mapInArrow(then_give_back(lambda b: _merge(b, length, homes)), "home int, data binary")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept " + ("string" if as_text else "binary")
    schema = ", ".join([schema, *(f"`{y}` {docs.schema[x].dataType.simpleString()}" for x, y in (carry or {}).items())])
    return by_home.cogroup(flags.groupBy("home")).applyInArrow(lambda d, f: _remove(d, f, length, as_text), schema)


def without_repeats(spark: SparkSession, docs: DataFrame, length: int = 50, counted: str = "n_chars") -> DataFrame:
    """``docs`` with the repeated passages taken out of text; documents of which nothing is left go.

    Documents that were empty, blank or null already stay, with empty text for
    null; rows without doc_id stay whole; repeated rows stay; an empty table
    gives an empty one. A character that is cut in two goes whole. The column ``counted``, if
    there is one, is set to the new number of characters.
    """
    others = {x: f"c{i}" for i, x in enumerate(docs.columns) if x not in ("doc_id", "text")}
    texts = remove_repeats(spark, docs, length, others, as_text=True).where((F.length(F.trim("kept")) > 0) | (F.col("n_removed") == 0))
    names = {y: x for x, y in others.items()} | {"kept": "text", "doc_id": "doc_id"}
    back = texts.select(*(F.col(y).alias(x) for y, x in names.items()))
    if counted in others:
        back = back.withColumn(counted, F.length("text").cast(docs.schema[counted].dataType))
    return back.select(*docs.columns)
