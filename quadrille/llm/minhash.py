"""Near-duplicate groups by MinHash.

Universal hash minima over word shingles, banding, verification of the signatures, and connected components
by alternating large-star and small-star (Broder 1997; Kiveris et al. 2014).

Every pair of documents that shares a band is verified, without a cap: equal signatures collapse to one
representative first; a bucket of at most ``block`` representatives is searched by one task; a larger one is
cut into blocks by a hash of the id and every pair of blocks is searched.  A search returns a spanning
forest of the pairs at or above the threshold, so its output is linear while the groups stay exact.

Cases.  Null text, empty text and text without a word: never a duplicate.  A text shorter than a shingle is
one shingle.  Null ids: ignored by the search and kept by the filter.  Rows that repeat an id are one
document, of which the filter keeps one row.  The smallest id of a group is kept.  An empty table gives an empty result.  Only the id and text
columns are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import Scratch, broadcast_if_small, fresh

SHINGLE, BANDS, ROWS, THRESHOLD, BLOCK = 3, 32, 4, 0.6, 1024
SEED = 20240917


def signatures(column: pa.Array, k: int = SHINGLE, n: int = BANDS * ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(texts x n) minima of n multiply-shift hashes of the shingles, and which texts have a word."""
    a, b = tk.constants(n, SEED)
    minima, present = [np.zeros((0, n), np.uint32)], [np.zeros(0, bool)]
    for _, data, offs in tk.blocks(column, lower=True):
        _, _, h, first = tk.words(data, offs)
        s, begin = tk.shingles(h, first, k)
        s >>= np.uint64(32)
        has = np.diff(begin) > 0
        out = np.zeros((len(has), n), np.uint32)
        if has.any():
            at = begin[:-1][has]
            for p in range(n):
                out[has, p] = np.minimum.reduceat(s * a[p] + b[p], at) >> np.uint64(32)
        minima.append(out)
        present.append(has)
    return np.concatenate(minima), np.concatenate(present)


def band_keys(minima: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(minima), bands), np.uint64)
    for j in range(bands):
        key = np.full(len(minima), j, np.uint64)
        for r in range(rows):
            key = tk.mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, j * rows + r])
        out[:, j] = key
    return out.view(np.int64)


def matches_needed(threshold: float, n: int) -> int:
    """Equal bytes among n so that the estimate, freed of the 1/256 chance matches, reaches the threshold."""
    return int(np.ceil(n * (threshold * 255 / 256 + 1 / 256) - 1e-9))


def _binary(rows: np.ndarray) -> pa.Array:
    n, width = rows.shape
    fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
    return fixed.cast(pa.binary())


def _sign(k: int, bands: int, rows: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minima, has = signatures(batch.column(1), k, bands * rows)
            keep = np.flatnonzero(has)
            minima = minima[keep]
            digest = [xxhash.xxh3_128_digest(row.tobytes()) for row in minima]
            flat = pa.array(band_keys(minima, bands, rows).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * bands), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(digest, pa.binary()), _binary((minima & 0xFF).astype(np.uint8)), lists], ["id", "digest", "sig", "bands"])

    return sign


def forest(sig: np.ndarray, need: int) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the graph that joins rows with at least ``need`` equal bytes."""
    a: list[int] = []
    b: list[int] = []
    left = np.arange(len(sig))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.count_nonzero(sig[left] == sig[x], axis=1) >= need
            new = left[near]
            a.extend([x] * len(new))
            b.extend(new)
            queue.extend(new)
            left = left[~near]
    return a, b


def _verify(need: int):
    def search(part: pa.Table) -> pa.RecordBatch:
        grp = part.column("grp").to_numpy()
        sig = part.column("sig").combine_chunks()
        sig = sig if isinstance(sig, pa.Array) else pa.concat_arrays(sig.chunks)
        rows = np.frombuffer(b"".join(sig.to_pylist()), np.uint8).reshape(len(grp), -1)
        start = np.flatnonzero(np.concatenate([[True], grp[1:] != grp[:-1]]))
        count = np.diff(np.concatenate([start, [len(grp)]]))
        two = start[count == 2]
        two = two[np.count_nonzero(rows[two] == rows[two + 1], axis=1) >= need] if len(two) else two
        a, b = [two], [two + 1]
        for s, c in zip(start[count > 2], count[count > 2]):
            x, y = forest(rows[s : s + c], need)
            a.append(np.asarray(x, np.int64) + s)
            b.append(np.asarray(y, np.int64) + s)
        ids = part.column("id").combine_chunks()
        left, right = ids.take(pa.array(np.concatenate(a))), ids.take(pa.array(np.concatenate(b)))
        flat = [x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in (left, right)]
        return pa.RecordBatch.from_arrays(flat, ["a", "b"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            now = now if held is None else pa.concat_tables([held, now])
            grp = now.column("grp").to_numpy()
            cut = int(np.searchsorted(grp, grp[-1]))
            if cut:
                yield search(now.slice(0, cut))
            held = now.slice(cut)
        if held is not None:
            yield search(held)

    return verify


def verified_pairs(reps: DataFrame, need: int, block: int, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that span, within every bucket, the pairs whose signatures agree often enough."""
    member = reps.select("id", F.explode("bands").alias("key"))
    chosen = (
        member.groupBy("key")
        .agg(F.count("*").alias("n"), F.min("id").alias("low"), F.expr("bit_xor(xxhash64(id))").alias("all"))
        .where("n > 1")
        .groupBy("n", "low", "all")  # bands often repeat a bucket: each set of members is searched once
        .agg(F.min("key").alias("key"))
        .select("key", "n")
    )
    blocks = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int")
    placed = (
        scratch.table(member.join(chosen, "key"))
        .withColumn("blocks", blocks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("id", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("grp"))
    )
    located = placed.join(reps.select("id", "sig"), "id").select("grp", "id", "sig")
    id_type = reps.schema["id"].dataType
    return located.repartition("grp").sortWithinPartitions("grp").mapInArrow(_verify(need), T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)]))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): for every node of an edge, the smallest node it is connected with.

    Alternates large-star and small-star until the edges stay the same; each round is a written table.
    Self-loops and null ends are dropped, repeated edges count once.
    """

    def larger_first(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first())

    now = scratch.table(larger_first(edges.where("a is not null and b is not null")))
    known = state(now)
    while known[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = scratch.table(larger_first(large))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        following = scratch.table(larger_first(small))
        scratch.drop(large)
        scratch.drop(now)
        now, before, known = following, known, state(following)
        if known == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: float = THRESHOLD, block: int = BLOCK, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, kept_id): every document to remove, with the document of its group that stays."""
    scratch = scratch or Scratch(docs.sparkSession)
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("digest", T.BinaryType()), T.StructField("sig", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))])
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    signed = scratch.table(source.mapInArrow(_sign(k, bands, rows), schema))
    groups = scratch.table(signed.groupBy("digest").agg(F.min(F.struct("id", "sig", "bands")).alias("r"), F.count("*").alias("n")).select("digest", "n", "r.*"))
    copies = scratch.table(
        signed.select("id", "digest").join(groups.where("n > 1").select("digest", F.col("id").alias("rep")), "digest").where("id <> rep").select("id", "rep").distinct()
    )
    scratch.drop(signed)
    pairs = scratch.table(verified_pairs(groups, matches_needed(threshold, bands * rows), block, scratch))
    scratch.drop(groups)
    roots = components(pairs, scratch)
    moved = copies.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("root", "rep").alias("root"))
    found = roots.select(F.col("node").alias("id"), "root").unionByName(moved).where("id <> root")
    return found.groupBy("id").agg(F.min("root").alias("root")).select(F.col("id").alias("doc_id"), F.col("root").alias("kept_id"))


def once(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """docs with one row of each id that has several: that of the smallest text, then of the smallest hash of its other columns.

    Only rows of repeated ids are shuffled with their columns, and combined before the shuffle.
    """
    name, row = fresh(docs, "again"), F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    again = scratch.table(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias(name)).agg(F.count("*").alias("n")).where("n > 1").select(name))
    if again.isEmpty():
        return docs
    again = broadcast_if_small(again)
    hit = F.col(id_col) == F.col(name)
    plain = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    rows = docs.join(again, hit, "left_semi").select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.xxhash64(*plain).alias("h"), row.alias("row"))
    kept = rows.groupBy("i").agg(F.min_by("row", F.struct("t", "h")).alias("row")).select("row.*")
    return docs.join(again, hit, "left_anti").unionByName(kept)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None, **options) -> DataFrame:
    """One row of each document that stays, with its columns as they are."""
    scratch = scratch or Scratch(docs.sparkSession)
    name = fresh(docs, "gone")
    gone = scratch.table(near_duplicates(docs, id_col, text_col, scratch=scratch, **options).select(F.col("doc_id").alias(name)))
    return once(docs.join(broadcast_if_small(gone), F.col(id_col) == F.col(name), "left_anti"), id_col, text_col, scratch)
