"""Quality scores: ridge regression on random Fourier features, calibrated by isotonic regression.

Statistics of a whole text are standardised and mapped to ``size`` cosines of
random directions, whose inner products approximate a Gaussian kernel. Each
partition sums its normal equations, the sums are added in two steps, and the
driver solves one system of ``size`` unknowns. Raw scores become probabilities
by isotonic regression over a fixed grid of score bins, on labelled rows that
the equations did not see.

Labels are learned from a sample of documented size, so only the sample's
texts are read twice; every text is scored where it is read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_remainder, map_batches, sampled, stored

STATISTICS = ("log_words", "word_length", "capitals", "digits", "marks", "symbols", "bars", "distinct", "repeated_lines", "top_word", "caps_words", "lone_marks", "repeated_pairs", "sentence")
_MARKS = str.maketrans("", "", "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()))
_SYMBOLS = re.compile(r"[#$%&*@^~_=+<>{}\[\]\\]")
_STOPS = re.compile(r"[.!?]")


def statistics(text: str) -> tuple[float, ...]:
    """Shape of a text; every number is finite, also for an empty one."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    bare = text.translate(_MARKS)
    lines = [x for x in text.split("\n") if x.strip()]
    ascii_upper = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    digits = sum(map(text.count, "0123456789"))
    counts = Counter(words)
    pairs = set(zip(words, words[1:], strict=False))
    lone = sum(v for w, v in counts.items() if not any(c.isalnum() for c in w))
    upper = sum(v for w, v in counts.items() if len(w) > 1 and w.isupper())
    return (
        np.log1p(len(words)),
        min(40.0, chars / n),
        ascii_upper / chars,
        digits / chars,
        (len(text) - len(bare)) / chars,
        len(_SYMBOLS.findall(text)) / n,
        text.count("|") / n,
        len(counts) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        max(counts.values(), default=0) / n,
        upper / n,
        lone / n,
        1 - len(pairs) / max(1, len(words) - 1),
        np.log1p(n / (1 + len(_STOPS.findall(text)))),
    )


def labelled_statistics(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """(stats, y, held) of about ``most_rows`` labelled documents with crc32 modulo 5 not 0; held: kept for calibration.

    Repeated labels of a document count by their mean, rows that share a
    doc_id as one document, that with the least text.
    """
    wanted = labels.where("doc_id is not null and quality is not null").where(id_remainder(5) != 0)
    wanted = wanted.groupBy("doc_id").agg(F.avg(F.col("quality").cast("double")).alias("y"))
    wanted = stored(spark, sampled(wanted, most_rows, "doc_id"), "labels")
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(wanted), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # about most_rows labels

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        flat = np.array([statistics(t.as_py()) for t in batch.column("text")], dtype=np.float64)
        values = pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), pa.array(flat.ravel()))
        return pa.RecordBatch.from_arrays([values, batch.column("y"), batch.column("held")], ["stats", "y", "held"])

    held = F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(4)) == 0
    return stored(spark, map_batches(rows.select("text", "y", held.alias("held")), one, "stats array<double>, y double, held boolean"), "statistics")


class Model:
    """Standardisation, Fourier features, ridge weights and the calibration curve."""

    def __init__(self, size: int, width: float, seed: int = 5):
        rng = np.random.default_rng(seed)
        k = len(STATISTICS)
        self.directions = rng.normal(0, 1 / width, (k, size))
        self.phases = rng.uniform(0, 2 * np.pi, size)
        self.mean, self.scale = np.zeros(k), np.ones(k)
        self.weights = np.zeros(size + 1)
        self.edges, self.levels = np.array([0.0]), np.array([0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        z = np.sqrt(2 / len(self.phases)) * np.cos(x @ self.directions + self.phases)
        return np.concatenate((z, np.ones((len(z), 1))), axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.levels), 0.0, 1.0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, len(STATISTICS))


def isotonic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: a rising curve through (x, y) of weight n, x ascending."""
    blocks: list[list[float]] = []
    for a, b, w in zip(x.tolist(), y.tolist(), n.tolist(), strict=True):
        blocks.append([a * w, b * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def fit(rows: DataFrame, size: int = 192, width: float = 3.0, ridge: float = 1.0, grid: int = 2000) -> Model:
    """Learn from labelled statistics (stats, y, held): the equations from rows that are not held, the curve from those that are.

    If either part is empty, both use all rows; without rows every score is
    0.5. What reaches the driver has the size of the model or the grid.
    """
    model = Model(size, width)
    k = len(STATISTICS)
    several = rows.agg(F.count_if("held"), F.count_if(~F.col("held"))).first()
    if not sum(several):
        return model
    curved, rows = (rows.where("held"), rows.where("not held")) if min(several) else (rows, rows)
    got = rows.agg(F.count(F.lit(1)), *(f(F.col("stats")[i]) for i in range(k) for f in (F.avg, F.stddev_pop))).first()
    model.mean = np.array(got[1::2], dtype=float)
    model.scale = np.maximum(np.array(got[2::2], dtype=float), 1e-6)
    d = size + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for batch in batches:
            if batch.num_rows:
                z = model.features(_matrix(batch.column("stats")))
                total[:, :d] += z.T @ z
                total[:, d] += z.T @ batch.column("y").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d * (d + 1))
        for batch in batches:
            for x in batch.column("sums"):
                total += np.frombuffer(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    added = rows.select("stats", "y").mapInArrow(sums, "sums binary").repartition(4).mapInArrow(add, "sums binary").collect()
    total = sum(np.frombuffer(r["sums"]) for r in added).reshape(d, d + 1)
    penalty = ridge * np.eye(d)
    penalty[-1, -1] = 1e-9
    model.weights = np.linalg.solve(total[:, :d] + penalty, total[:, d])

    def cells(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = np.clip(model.raw(_matrix(batch.column("stats"))), -1, 2)
        cell = np.minimum((raw + 1) / 3 * grid, grid - 1).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(cell), batch.column("y")], ["cell", "y"])

    curve = map_batches(curved.select("stats", "y"), cells, "cell int, y double").groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("y")).orderBy("cell").collect()
    at = np.array([(r["cell"] + 0.5) * 3 / grid - 1 for r in curve])
    model.edges, model.levels = isotonic(at, np.array([r["y"] for r in curve]), np.array([float(r["n"]) for r in curve]))
    return model


MOST_ROWS = 50_000


def rate(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    Learned from about ``most_rows`` labels of documents whose id's crc32
    modulo 5 is not 0, taken by a hash of the id. Null texts count as empty
    and are scored like any text; repeated rows come out once each; null ids
    are scored but never learned from; without labels every score is 0.5; an
    empty table gives an empty one. Other columns are never used.
    """
    model = fit(labelled_statistics(spark, docs, labels, most_rows))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = model.score(np.array([statistics(t.as_py()) for t in batch.column("text")], dtype=np.float64))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (id_remainder(5) == 0).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return map_batches(rows, one, f"doc_id {kind}, held_out boolean, score double, predicted int")


def keep_good(spark: SparkSession, docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most_rows: int = MOST_ROWS) -> DataFrame:
    """The rows of ``docs`` that score at least the threshold; all columns stay.

    The model is learned as in ``rate``; rows are judged where they are read,
    without a join, whatever their ids. Null and empty texts are scored like
    any text, without labels all rows stay, and an empty table gives an empty
    one.
    """
    model = fit(labelled_statistics(spark, docs, labels, most_rows))

    def good(batch: pa.RecordBatch) -> pa.RecordBatch:
        text = batch.column(batch.schema.names.index("text"))
        flat = np.array([statistics(t.as_py() or "") for t in text], dtype=np.float64)
        return batch.filter(pa.array(model.score(flat) >= threshold))

    return map_batches(docs, good, docs.schema)
