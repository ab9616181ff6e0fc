"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased and read as letters with one blank for each other
character. N-grams are hashed into a fixed number of bins, so the model is one
row of log-probabilities for each language, whose size does not depend on the
corpus; it is broadcast. A batch is scored as one long array of
bins: gather a language's weights, then sum by document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, map_batches, sampled

ORDERS = (1, 2, 3)
_CHUNK = 1_000_000
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def pieces_of(texts: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of (document number, text) of about a million characters; long texts are cut with an overlap."""
    owners, held, size, overlap = [], [], 0, max(ORDERS) - 1
    for i, text in enumerate(texts):
        for a in range(0, max(1, len(text)), _CHUNK):
            piece = text[max(0, a - overlap) : a + _CHUNK]
            owners.append(i if a == 0 else -i - 1)
            held.append(piece)
            size += len(piece)
            if size >= _CHUNK:
                yield owners, held
                owners, held, size = [], [], 0
    if owners:
        yield owners, held


def bins_of(held: list[str], owners: list[int], bins: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (bin number ``bins`` for none), the first place of each piece, and whether each piece has a letter."""
    lowered = [t.lower() for t in held]
    sizes = np.array([len(t) + max(ORDERS) for t in lowered])
    flat = np.frombuffer(("".join(t + "\0" * max(ORDERS) for t in lowered)).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    first = np.cumsum(sizes) - sizes
    is_letter = letters()[flat]
    c = np.where(is_letter, flat, np.where(flat == 0, 0, 32)).astype(np.uint32)
    has = np.add.reduceat(is_letter, first) > 0
    out = np.empty((len(ORDERS), len(c)), dtype=np.int32)
    gone = c == 0
    h = c * np.uint32(2654435761) + np.uint32(1)
    for k, _ in enumerate(ORDERS):
        if k:
            shifted = np.concatenate((c[k:], np.zeros(k, np.uint32)))
            gone = gone | (shifted == 0)
            h = (h ^ (h >> np.uint32(15))) * np.uint32(2246822519) + shifted * np.uint32(3266489917)
        out[k] = np.where(gone, bins, ((h ^ (h >> np.uint32(13))) % np.uint32(bins)).astype(np.int32))
    for i, owner in enumerate(owners):
        if owner < 0:  # a later piece of a text: n-grams inside the overlap were counted already
            for k in range(len(ORDERS)):
                out[k, first[i] : first[i] + max(ORDERS) - 1 - k] = bins
    return out, first, has


class Model:
    def __init__(self, counts: dict[str, np.ndarray], docs: dict[str, int], bins: int):
        self.langs = sorted(counts)
        self.bins = bins
        total = sum(docs.values())
        self.prior = np.array([np.log(docs[x] / total) for x in self.langs])
        self.weights = np.zeros((len(self.langs), bins + 1), dtype=np.float32)
        for i, x in enumerate(self.langs):
            c = counts[x] + 0.5
            self.weights[i, :bins] = np.log(c / c.sum())

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and posterior probabilities; ``und`` and 0 without a letter or a learned language."""
        logs = np.zeros((len(texts), len(self.langs)))
        lettered = np.zeros(len(texts), dtype=bool)
        for owners, held in pieces_of([t or "" for t in texts]):
            cells, first, has = bins_of(held, owners, self.bins)
            who = np.array([o if o >= 0 else -o - 1 for o in owners])
            np.logical_or.at(lettered, who, has)
            for j in range(len(self.langs)):
                w = self.weights[j]
                sums = np.add.reduceat(w[cells].sum(axis=0, dtype=np.float64), first)
                np.add.at(logs[:, j], who, sums)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        logs += self.prior
        best = logs.argmax(axis=1)
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        score = np.where(lettered, 1.0 / p.sum(axis=1), 0.0)
        return [self.langs[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], score


def fit(labelled: DataFrame, bins: int = 1 << 16, most_rows: int = 20_000, most_cells: int = 1 << 25) -> Model:
    """Learn from (text, lang, key) rows.

    ``most_rows`` bounds the distinct rows learned from: of more, about that
    many are taken by a 64-bit hash of key and text, at every size of the
    corpus. Counts come to the driver as one vector for each language, summed
    on the executors. Every language of the sample is learned: the matrix has
    at most ``most_cells`` cells (128 MB), so over 512 languages share fewer
    bins than ``bins``, a power of two each.
    """
    rows = sampled(labelled.where("text is not null and lang is not null"), most_rows, "key", "text", "lang")
    langs = rows.select("lang").distinct().count()
    bins = min(bins, 1 << max(4, (most_cells // max(1, langs)).bit_length() - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for x in set(langs):
                own = [t for t, y in zip(texts, langs, strict=True) if y == x]
                docs[x] = docs.get(x, 0) + len(own)
                total = sums.setdefault(x, np.zeros(bins + 1, dtype=np.int64))
                for owners, held in pieces_of(own):
                    total += np.bincount(bins_of(held, owners, bins)[0].ravel(), minlength=bins + 1)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([docs[x] for x in sums], pa.int64()), pa.array([zlib.compress(v[:bins].tobytes(), 1) for v in sums.values()], pa.binary())],
                ["lang", "docs", "counts"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for x, d, c in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                own = sums.setdefault(x, [0, np.zeros(bins, dtype=np.int64)])
                own[0] += d
                own[1] += np.frombuffer(zlib.decompress(c), np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([zlib.compress(v[1].tobytes(), 1) for v in sums.values()], pa.binary())],
                ["lang", "docs", "counts"],
            )

    schema = "lang string, docs long, counts binary"
    partial = rows.select("lang", "text").mapInArrow(count, schema)
    got = partial.repartition(8).mapInArrow(add, schema).collect()
    counts: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for r in got:
        counts[r["lang"]] = counts.get(r["lang"], 0) + np.frombuffer(zlib.decompress(r["counts"]), np.int64)
        docs[r["lang"]] = docs.get(r["lang"], 0) + r["docs"]
    return Model(counts, docs, bins)


def identify(spark: SparkSession, docs: DataFrame, most_rows: int = 20_000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row.

    Learned from rows whose id's crc32 modulo 3 is not 1. Null texts and
    texts without a letter are ``und`` with score 0; ties go to the first
    language in order; repeated rows come out once each; null ids count as
    empty text in the remainder; other columns are never used.
    """
    held = id_remainder(3) == 1
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out"))
    model = fit(rows.where(~F.col("held_out")).withColumnRenamed("doc_id", "key"), most_rows=most_rows)

    shared = spark.sparkContext.broadcast(model)  # the weights: at most most_cells

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        langs, score = shared.value.predict(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows.select("doc_id", "text", "held_out"), one, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
