"""Toxicity by class-conditional Kneser-Ney models with shared backoff.

A word is a sequence of bytes between a start and an end mark; the models give each byte's probability after
the four before it.  Each class has its own discounted counts at the highest order, gathered from all labelled
documents of the class; below it both share one Kneser-Ney model whose continuation counts are gathered from
the whole corpus, labelled or not.  So an expression that is rare or new to both classes gets the same backoff
probability from both, and cancels.  A document's score is its toxic minus its ordinary log-likelihood,
divided by its number of predicted bytes and ``PRIOR`` more, which speak for neither class: they keep the chance
in a text of a few words from deciding.

A fifth of the labelled documents, by a hash of the id, isn't counted in the classes; the threshold with the
best F1 on these decides.  Every labelled n-gram is kept: executors write the class models to sorted files in the
shared folder, of about ``MAX_GRAMS`` n-grams each, which the workers map into memory; the driver holds a line for
each file.

Cases.  Null and empty texts, and texts without a word, score 0 and aren't flagged.  Null labels and null ids
aren't used for training; rows with a null id are scored.  Rows that repeat an id are each scored.  When one
class has no labelled document nothing is flagged.  An empty table gives an empty result.  Only the named
columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import Scratch, broadcast_if_small
from .urlfilter import _buffer

ORDER, PRIOR, HOLD_OUT, MAX_GRAMS, GRID, CHUNK = 5, 100, 5, 4_000_000, 2000, 3 << 20
_START, _END = 1, 2


@dataclass
class Vocabulary:
    """The distinct words of some texts, their grams, and each text's words by number."""

    first: np.ndarray
    number: np.ndarray
    grams: np.ndarray
    gram_first: np.ndarray


def vocabularies(column: pa.Array) -> Iterator[tuple[int, Vocabulary]]:
    for row, data, offs in tk.blocks(column, lower=True, size=CHUNK):
        starts, ends, h, first = tk.words(data, offs)
        _, at, number = np.unique(h, return_index=True, return_inverse=True)
        grams, gram_first = word_grams(data, starts[at], ends[at])
        yield row, Vocabulary(first, number, grams, gram_first)


def word_grams(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each word, ORDER bytes to an integer, the predicted byte lowest; and the first of each word."""
    length = ends - starts
    first = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length + 1, out=first[1:])
    wide = first + np.arange(len(first)) * (ORDER - 1)
    padded = np.full(wide[-1], _START, np.uint8)
    word = np.repeat(np.arange(len(length)), length)
    inside = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
    padded[wide[word] + ORDER - 1 + inside] = data[starts[word] + inside]
    padded[wide[1:] - 1] = _END
    owner = np.repeat(np.arange(len(length)), length + 1)
    at = np.arange(first[-1]) - first[owner] + wide[owner]
    code = np.zeros(first[-1], np.int64)
    for j in range(ORDER):
        code = code << 8 | padded[at + j]
    return code, first


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.concatenate(counts)
    return code, np.stack([np.bincount(at, total[:, j], len(code)) for j in range(total.shape[1])], 1).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each gram in ordinary, toxic and all documents of the partition."""
    codes, counts, held = [], [], 0
    for batch in batches:
        kind = batch.column(1).to_numpy()
        for row, v in vocabularies(batch.column(0)):
            n = len(v.first) - 1
            text_kind = np.repeat(kind[row : row + n], np.diff(v.first))
            m = len(v.gram_first) - 1
            by = np.stack([np.bincount(v.number[text_kind == 0], minlength=m), np.bincount(v.number[text_kind == 1], minlength=m), np.bincount(v.number, minlength=m)], 1)
            each = np.repeat(by, np.diff(v.gram_first), axis=0)
            code, total = _merge([v.grams], [each])
            codes.append(code)
            counts.append(total)
            held += len(code)
        if held > 4_000_000:
            code, total = _merge(codes, counts)
            codes, counts, held = [code], [total], 0
    if codes:
        code, total = _merge(codes, counts)
        for s in range(0, len(code), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(code[s : s + 100_000]), *(pa.array(np.ascontiguousarray(total[s : s + 100_000, j])) for j in range(3))], ["code", "ordinary", "toxic", "every"])


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(one / (one + 2 * two)) if one and two else 0.5


def _mask(m: int) -> int:
    return (1 << 8 * m) - 1


def backoff(short: DataFrame, scratch: Scratch) -> DataFrame:
    """(code, p): the shared model's probability of the last byte of each (ORDER - 1)-gram of short (code, n), interpolated to the lowest order.

    Every level is a table, so that nothing of the corpus's vocabulary comes to the driver but two counts a level.
    """
    levels = {ORDER - 1: scratch.table(short)}
    for m in range(ORDER - 2, 0, -1):
        levels[m] = scratch.table(levels[m + 1].groupBy(F.col("code").bitwiseAND(F.lit(_mask(m))).alias("code")).agg(F.count("*").alias("n")))
    lower = None
    for m in range(1, ORDER):
        one, two = levels[m].agg(F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).first()
        d = one / (one + 2 * two) if one and two else 0.5
        here = levels[m].withColumn("h", F.shiftright("code", 8))
        here = here.join(here.groupBy("h").agg(F.sum("n").alias("total"), F.count("*").alias("types")), "h")
        if lower is None:
            here = here.withColumn("low", F.lit(1 / 256))
        else:
            here = here.withColumn("suffix", F.col("code").bitwiseAND(F.lit(_mask(m - 1)))).join(lower.select(F.col("code").alias("suffix"), F.col("p").alias("low")), "suffix")
        lower = here.select("code", ((F.col("n") - d) / F.col("total") + d * F.col("types") / F.col("total") * F.col("low")).alias("p"))
        lower = scratch.table(lower) if m < ORDER - 1 else lower
    return lower


@dataclass(frozen=True)
class Model:
    """Log ratios of the seen grams, and of the backoff weights of the seen contexts."""

    codes: np.ndarray
    ratio: np.ndarray
    contexts: np.ndarray
    weight: np.ndarray

    def of(self, grams: np.ndarray) -> np.ndarray:
        at, hit = _find(self.codes, grams)
        out = np.where(hit, self.ratio[at], np.float32(0)) if len(self.codes) else np.zeros(len(grams), np.float32)
        rest = np.flatnonzero(~hit)
        at, known = _find(self.contexts, grams[rest] >> 8)
        out[rest[known]] = self.weight[at[known]]
        return out

    def score(self, column: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for _, v in vocabularies(column):
            word = tk.per_text(self.of(v.grams), v.gram_first)
            size = np.diff(v.gram_first)
            total, n = tk.per_text(word[v.number], v.first), tk.per_text(size[v.number], v.first)
            out.append(total / (n + PRIOR))
        return np.concatenate(out)


@dataclass(frozen=True)
class Files(Model):
    """A model in files (path, lowest context) in ascending order; no context is in two of them."""

    files: tuple[tuple[str, int], ...] = ()

    def of(self, grams: np.ndarray) -> np.ndarray:
        if self.files not in _opened:
            _opened.clear()  # one model at a time
            _opened[self.files] = [Model(*(np.frombuffer(_buffer(f"{path}.{c}"), t) for c, t in _ARRAYS)) for path, _ in self.files]
        out = np.zeros(len(grams), np.float32)
        part = np.searchsorted(np.array([low for _, low in self.files]), grams >> 8, "right") - 1
        for p in np.unique(part[part >= 0]):
            mine = np.flatnonzero(part == p)
            out[mine] = _opened[self.files][p].of(grams[mine])
        return out


_ARRAYS = (("codes", np.int64), ("ratio", np.float32), ("contexts", np.int64), ("weight", np.float32))
_opened: dict[tuple, list[Model]] = {}


def model_of(codes: np.ndarray, counts: np.ndarray, lower: np.ndarray, discounts: tuple[float, float] | None = None) -> Model:
    """codes, counts: the labelled grams with (ordinary, toxic) counts; lower: the shared probability of each; discounts: those of all grams, if these aren't all."""
    order = np.argsort(codes)
    codes, counts, lower = codes[order], counts[order].astype(float), lower[order]
    contexts, at = np.unique(codes >> 8, return_inverse=True)
    logs, weights = [], []
    for k in range(2):
        n = counts[:, k]
        d = discounts[k] if discounts else discount(n)
        total, types = np.bincount(at, n, len(contexts)), np.bincount(at, n > 0, len(contexts))
        weight = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
        logs.append(np.log(np.maximum(n - d, 0) / np.maximum(total[at], 1) + weight[at] * lower))
        weights.append(np.log(weight))
    return Model(codes, (logs[1] - logs[0]).astype(np.float32), contexts, (weights[1] - weights[0]).astype(np.float32))


def fit(texts: DataFrame, scratch: Scratch, max_grams: int = MAX_GRAMS) -> Model | None:
    """texts: (text, kind) with kind 0 ordinary, 1 toxic, -1 not counted in a class."""
    schema = "code bigint, ordinary bigint, toxic bigint, every bigint"
    counted = texts.mapInArrow(_count, schema).groupBy("code").agg(*(F.sum(c).alias(c) for c in ("ordinary", "toxic", "every")))
    counted = scratch.table(counted)
    kept = counted.where("ordinary + toxic > 0")
    n, ordinary, toxic, *seen = kept.agg(F.count("*"), F.sum("ordinary"), F.sum("toxic"), *(F.count_if(F.col(c) == i) for c in ("ordinary", "toxic") for i in (1, 2))).first()
    if not ordinary or not toxic:
        return None
    discounts = tuple(one / (one + 2 * two) if one and two else 0.5 for one, two in (seen[:2], seen[2:]))
    suffix = F.col("code").bitwiseAND(F.lit(_mask(ORDER - 1)))
    shared = backoff(counted.groupBy(suffix.alias("code")).agg(F.count("*").alias("n")), scratch)
    grams = kept.select("code", "ordinary", "toxic", suffix.alias("suffix")).join(shared.select(F.col("code").alias("suffix"), "p"), "suffix")
    folder = scratch.path()
    folder = folder if "://" in folder else f"file://{folder}"
    fs, inner = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(inner, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        parts = [[c.to_numpy() for c in batch.columns] for batch in batches]
        if not sum(len(p[0]) for p in parts):
            return
        code, a, b, lower = (np.concatenate(c) for c in zip(*parts))
        made = model_of(code, np.stack([a, b], 1), lower, discounts)
        path = f"{folder}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}"  # an attempt that is lost leaves files that nobody reads
        fs, inner = pa.fs.FileSystem.from_uri(path)
        for c, t in _ARRAYS:
            with fs.open_output_stream(f"{inner}.{c}") as f:
                f.write(getattr(made, c).astype(t).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([int(made.contexts[0])])], ["path", "low"])

    ranged = grams.select("code", "ordinary", "toxic", "p").repartitionByRange(-(-n // max_grams), F.shiftright("code", 8))
    files = ranged.mapInArrow(write, "path string, low bigint").collect()
    scratch.drop(counted)
    return Files(None, None, None, None, tuple(sorted(((r.path, r.low) for r in files), key=lambda r: r[1])))


def best_threshold(bins: list[tuple[int, int, int]]) -> int | None:
    """From (bin, ordinary, toxic) counts, the middle of the highest gap below which F1 falls; None without toxic ones."""
    bins = sorted(bins, reverse=True)
    positive = sum(b[2] for b in bins)
    if not positive:
        return None
    best, at, tp, fp = -1.0, 0, 0, 0
    for i, (_, ordinary, toxic) in enumerate(bins):
        tp, fp = tp + toxic, fp + ordinary
        f1 = 2 * tp / (positive + tp + fp)
        if f1 > best:
            best, at = f1, i
    low = bins[at][0]
    return (low + bins[at + 1][0] + 1) // 2 if at + 1 < len(bins) else low


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", max_grams: int = MAX_GRAMS, scratch: Scratch | None = None) -> tuple[DataFrame, float]:
    """((doc_id, score) of every document, the threshold from which a score is toxic)."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark)
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("kind")).where(f"__id is not null and {label} is not null")
    known = known.groupBy("__id").agg(F.max("kind").alias("kind"))  # documents with labels at odds are toxic
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HOLD_OUT)) == 0
    labelled = source.join(broadcast_if_small(known), F.col("doc_id") == F.col("__id"), "left").drop("__id").withColumn("held", held)
    model = fit(labelled.select("text", F.when(F.col("held"), -1).otherwise(F.coalesce("kind", F.lit(-1))).alias("kind")), scratch, max_grams)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("kind", T.IntegerType()), T.StructField("held", T.BooleanType())])
    if model is None:
        return source.select("doc_id", F.lit(0.0).alias("score")), float("inf")
    sent = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.score(batch.column("text"))), batch.column("kind"), batch.column("held")], ["doc_id", "score", "kind", "held"])

    scored = scratch.table(labelled.select("doc_id", "text", "kind", "held").mapInArrow(score, schema))
    binned = scored.where("kind is not null").groupBy("held", F.floor(F.col("score") * GRID).cast("int").alias("bin")).agg(F.count_if(F.col("kind") == 0).alias("a"), F.count_if(F.col("kind") == 1).alias("b")).collect()
    threshold = best_threshold([(r.bin, r.a, r.b) for r in binned if r.held])
    if threshold is None:
        threshold = best_threshold([(r.bin, r.a, r.b) for r in binned])
    return scored.select("doc_id", "score"), float("inf") if threshold is None else threshold / GRID


def toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, score, threshold) of every toxic document."""
    scored, threshold = scores(docs, labels, **options)
    return scored.where(F.col("score") >= threshold).withColumn("threshold", F.lit(threshold))
