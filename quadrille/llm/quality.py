"""Quality classifier: random Fourier features, ridge by partition-summed normal equations, isotonic calibration.

Statistics of the whole text are standardised with sums over all documents, mapped to ``FEATURES`` random
cosines that approximate a Gaussian kernel (Rahimi and Recht 2007), and fitted to the labels by ridge
regression, whose normal equations are sums over partitions.  Scores of a held-out fifth of the labelled
documents, binned on a fixed grid, give the isotonic calibration (pool adjacent violators) to a probability.

All labelled documents are used: what the driver holds is a matrix of FEATURES + 1 squared, whatever the input.

Cases.  A null or empty text has the statistics of an empty text and is scored like any other.  Null ids are
scored and not used for training.  Rows that repeat an id are each scored; in training each repeated pair of
a text row and a label counts.  Null labels are left out.  Without labels, or when the labels are all the
same, nothing can be told apart and every document is kept with the labels' mean, or 1.0 without any.
Only the id and text columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import Scratch, broadcast_if_small

FEATURES, WIDTH, RIDGE, SEED = 256, 3.0, 1e-3, 7
#: Every HOLD_OUT-th labelled document by a hash of its id calibrates and isn't fitted; BINS score bins.
HOLD_OUT, BINS, KEEP_AT = 5, 512, 0.5

STATISTICS = (
    "log_bytes log_words mean_word sd_word word_share letter_share upper_share digit_share space_share line_share "
    "punct_share symbol_share mark_per_word distinct_words repeated_next top_line_gap stop_share other_share"
).split()
_CLASS = np.full(256, 7, np.uint8)
for _codes, _class in ((range(97, 123), 0), (range(65, 91), 1), (range(48, 58), 2), ((32, 9, 11, 12, 13), 3), ((10,), 4), (map(ord, ".,;:'\"-()"), 5), (range(128, 256), 6)):
    for _code in _codes:
        _CLASS[_code] = _class


def statistics(column: pa.Array) -> np.ndarray:
    """(texts x statistics) float64; every value is a function of the whole text alone."""
    out = [np.zeros((0, len(STATISTICS)))]
    for _, data, offs in tk.blocks(column):
        n, size = len(offs) - 1, np.diff(offs).astype(float)
        kinds = _CLASS[data]
        text = np.repeat(np.arange(n), np.diff(offs))
        counts = np.bincount(text * 8 + kinds, minlength=8 * n).reshape(n, 8).astype(float)
        lower = np.where((data >= 65) & (data <= 90), data + 32, data)
        starts, ends, h, first = tk.words(lower, offs)
        length = (ends - starts).astype(float)
        words = np.diff(first).astype(float)
        safe, filled = np.maximum(words, 1), np.maximum(size, 1)
        owner = np.repeat(np.arange(n), np.diff(first))
        mean = tk.per_text(length, first) / safe
        sd = np.sqrt(np.maximum(tk.per_text(length * length, first) / safe - mean * mean, 0))
        order = np.lexsort((h, owner))
        hs, os = h[order], owner[order]
        new = np.concatenate([[True], (hs[1:] != hs[:-1]) | (os[1:] != os[:-1])]) if len(hs) else np.zeros(0, bool)
        distinct = np.bincount(os[new], minlength=n)
        again = np.concatenate([[False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])]) if len(h) else np.zeros(0, bool)
        repeated = np.bincount(owner[again], minlength=n)
        ws, we = tk.white_runs(data, offs)
        gaps = np.diff(np.searchsorted(ws, offs)).astype(float)
        marked = np.bincount(text[we - 1], kinds[we - 1] == 7, minlength=n) if len(we) else np.zeros(n)
        short = np.bincount(owner[length <= 3], minlength=n)
        shouted = counts[:, 1] / np.maximum(counts[:, 0] + counts[:, 1], 1)
        columns = (
            np.log1p(size), np.log1p(words), mean, sd, words / filled, (counts[:, 0] + counts[:, 1] + counts[:, 6]) / filled, shouted, counts[:, 2] / filled, counts[:, 3] / filled,
            counts[:, 4] / filled, counts[:, 5] / filled, counts[:, 7] / filled, marked / np.maximum(gaps, 1), distinct / safe, repeated / safe, (gaps - words) / np.maximum(gaps, 1), short / safe, counts[:, 6] / filled,
        )
        out.append(np.column_stack(columns))
    return np.concatenate(out)


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return random_features(stats, self.mean, self.scale) @ self.weights

    def probability(self, raw: np.ndarray) -> np.ndarray:
        return self.levels[np.clip(np.searchsorted(self.edges, raw, "right"), 0, len(self.levels) - 1)]


def random_features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    r = np.random.Generator(np.random.PCG64(SEED))
    w = r.normal(size=(len(mean), FEATURES)) / WIDTH
    b = r.uniform(0, 2 * np.pi, FEATURES)
    z = np.clip((stats - mean) / scale, -6, 6)
    return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones(len(z))])


def isotonic(positive: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing fit to positive / weight over bins; empty bins take the bin before."""
    level: list[list[float]] = []
    for p, w in zip(positive, weight):
        if w > 0:
            level.append([p, w, 1])
        elif level:
            level[-1][2] += 1
        else:
            level.append([0.0, 0.0, 1])
        while len(level) > 1 and level[-2][0] * level[-1][1] >= level[-1][0] * level[-2][1]:
            p1, w1, n1 = level.pop()
            level[-1] = [level[-1][0] + p1, level[-1][1] + w1, level[-1][2] + n1]
    return np.concatenate([np.full(n, p / w if w else 0.0) for p, w, n in level])


def _array(df: DataFrame, job, size: int) -> np.ndarray:
    """The sum over partitions of the arrays of ``size`` that job makes of its batches; summed in Spark by place."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += job(batch)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "v"])

    out = np.zeros(size)
    for at, v in df.mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[at] = v
    return out


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("stats")
    return np.asarray(column.flatten()).reshape(len(column), len(STATISTICS))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, stats): the statistics of every document; no shuffle."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = statistics(batch.column(1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * len(STATISTICS)), pa.array(s.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "stats"])

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(measure, schema)


def fit(stats: DataFrame, labels: DataFrame, scratch: Scratch, label_id: str = "doc_id", label: str = "quality") -> Model:
    """stats: (id, stats) as a written table; labels: one row for each labelled document."""
    d = len(STATISTICS)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        s = _stats_of(batch)
        return np.concatenate([[len(s)], s.sum(0), (s * s).sum(0)])

    total = _array(stats, moments, 2 * d + 1)
    mean = total[1 : d + 1] / max(total[0], 1)
    scale = np.sqrt(np.maximum(total[d + 1 :] / max(total[0], 1) - mean * mean, 0))
    scale[scale < 1e-9] = 1
    known = labels.select(F.col(label_id).alias("id"), F.col(label).cast("double").alias("y")).where("id is not null and y is not null")
    known = scratch.table(stats.join(broadcast_if_small(known), "id").withColumn("held", F.pmod(F.xxhash64("id"), F.lit(HOLD_OUT)) == 0))

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        fitted = ~batch.column("held").to_numpy(zero_copy_only=False)
        z, y = random_features(_stats_of(batch)[fitted], mean, scale), batch.column("y").to_numpy()[fitted]
        return np.concatenate([(z.T @ z).ravel(), z.T @ y, [y.sum(), len(y)]])

    m = FEATURES + 1
    total = _array(known, equations, m * m + m + 2)
    gram, moment, (positive, n) = total[: m * m].reshape(m, m), total[m * m : -2], total[-2:]
    if not 0 < positive < n:
        scratch.drop(known)
        return Model(mean, scale, np.zeros(m), np.zeros(0), np.array([positive / n if n else 1.0]))
    weights = np.linalg.solve(gram + RIDGE * n * np.diag([1.0] * FEATURES + [0.0]) / FEATURES, moment)
    edges = np.linspace(-0.5, 1.5, BINS - 1)

    def tally(batch: pa.RecordBatch) -> np.ndarray:
        held = batch.column("held").to_numpy(zero_copy_only=False)
        raw, y = random_features(_stats_of(batch)[held], mean, scale) @ weights, batch.column("y").to_numpy()[held]
        at = np.searchsorted(edges, raw, "right")
        return np.concatenate([np.bincount(at, y, BINS), np.bincount(at, minlength=BINS)])

    counted = _array(known, tally, 2 * BINS)
    scratch.drop(known)
    positive, weight = counted[:BINS], counted[BINS:]
    levels = isotonic(positive, weight) if weight.any() else (np.concatenate([[-1], edges]) >= positive.sum() / n).astype(float)
    return Model(mean, scale, weights, edges, levels)


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, score, probability, keep) of every document."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    stats = scratch.table(measured(docs, id_col, text_col))
    model = spark.sparkContext.broadcast(fit(stats, labels, scratch))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.value.raw(_stats_of(batch))
            p = model.value.probability(raw)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw), pa.array(p), pa.array(p >= keep_at)], ["doc_id", "score", "probability", "keep"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("probability", T.DoubleType()), T.StructField("keep", T.BooleanType())])
    return stats.mapInArrow(score, schema)


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = KEEP_AT, scratch: Scratch | None = None) -> DataFrame:
    """The rows of docs with a probability of at least ``keep_at``, with their columns; the texts aren't shuffled."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    stats = scratch.table(measured(docs, id_col, text_col))
    model = spark.sparkContext.broadcast(fit(stats, labels, scratch))
    scratch.drop(stats)

    @F.arrow_udf("boolean")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(model.value.probability(model.value.raw(statistics(texts))) >= keep_at)

    return docs.where(good(F.col(text_col).cast("string")))
