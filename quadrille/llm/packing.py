"""Related-document packing: a nearest-neighbour graph, greedy low-degree-first paths, windows along the paths.

Vectors.  Words of the whole text are hashed to ``BUCKETS`` counts, square-rooted, normalised and rounded to
bytes.  Distances are between these whole profiles; as they are whole numbers, distances are exact.  Documents of
equal profiles are one node of the graph, however many they are, and stand side by side on its path.

Graph.  Nodes are cut into boxes of about ``LEAF`` by a tree whose cuts lie across the widest direction of each
part.  The boxes are files in the shared folder.  Every node looks for its ``NEIGHBOURS`` nearest in its own box
and in those with the nearest centres, ``PROBES`` in all, ties going to the smaller id.  The nodes of one box choose
among the ``READS`` boxes that most of them would look at, so what is read grows with the nodes, not with their square.
Up to ``PROBES`` boxes the graph is exact; beyond, a neighbour in a box that isn't looked at is missed (README has the
measured recall).  The tree is built from a bounded sample, about ``SAMPLE`` rows, and has at most ``MAX_LEAVES`` boxes.

Paths.  Edges are taken from the whole graph, wherever the boxes' borders are: first those of the nodes of lowest
degree (Shi et al. 2023), of these the nearest.  An edge joins two paths if each of its nodes is still an end of a
path, and not of the same one.  This is done in parallel rounds, in which a path is joined by an edge that comes first
among all those left at the ends of both; the last ``REST`` edges are done one by one by one task.  Both give what
taking all edges one by one gives.  Nodes then find their places on the paths by pointer jumping.

Windows.  Documents are sorted by path and place, in ranges of about ``RANGE``, and laid one after the other; sums over
the ranges tell where each begins.  Windows of ``WINDOW`` words are cut along the whole of it; a document across a
border continues in the next window, so only the last window isn't full.  No path, node or box has to fit a task.

Cases.  Texts that are null, empty or without a word fill no window, and rows with a null id can't be named:
both are left out.  Rows that repeat an id are one document (of several texts, the one with fewest words).
Very long texts span many windows.  An empty table gives an empty result.  Only the id and text columns are
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as tk
from .common import Scratch, broadcast_if_small

BUCKETS, NEIGHBOURS, LEAF, PROBES, READS, SAMPLE, MAX_LEAVES, REST, RANGE, WINDOW = 128, 6, 2048, 40, 64, 1 << 16, 1 << 16, 1 << 21, 1 << 16, 2048
AXES = BUCKETS
_CHUNK = 512


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, bytes of its hashed word profile)."""
    counts, profiles = [np.zeros(0, np.int64)], [np.zeros((0, BUCKETS), np.uint8)]
    for _, data, offs in tk.blocks(column, lower=True):
        _, _, h, first = tk.words(data, offs)
        n = len(offs) - 1
        owner = np.repeat(np.arange(n), np.diff(first))
        f = np.sqrt(np.bincount(owner * BUCKETS + (h % np.uint64(BUCKETS)).astype(np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS))
        f /= np.maximum(np.sqrt((f * f).sum(1, keepdims=True)), 1e-12)
        counts.append(np.diff(first))
        profiles.append(np.rint(f * 255).astype(np.uint8))
    return np.concatenate(counts), np.concatenate(profiles)


@dataclass(frozen=True)
class Tree:
    """Node i has children 2i + 1 and 2i + 2; node i of the last level is leaf i - (leaves - 1).  Directions and cuts are whole numbers, so equal points share a leaf."""

    way: np.ndarray
    cut: np.ndarray

    def leaf(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)
        for s in range(0, len(points), 1 << 14):
            x = points[s : s + (1 << 14)].astype(float)
            node = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(self.cut) + 1))):
                node = 2 * node + 1 + ((x * self.way[node]).sum(1) > self.cut[node])
            out[s : s + len(x)] = node
        return (out - len(self.cut)).astype(np.int32)


def widest(points: np.ndarray) -> np.ndarray:
    """The direction of greatest variance, by power iteration over at most 4096 of the points, in whole numbers."""
    x = points[:: -(-len(points) // 4096)].astype(float)
    x = x - x.mean(0)
    v = x[np.abs(x).sum(1).argmax()]
    for _ in range(12):
        v = v / max(np.sqrt((v * v).sum()), 1e-9)
        v = (x @ v) @ x
    return np.rint(1000 * v / max(np.abs(v).max(), 1e-9))


def grow(sample: np.ndarray, leaves: int) -> Tree:
    """A balanced tree over the sample; points on a cut are on its lower side."""
    inner = leaves - 1
    way, cut = np.zeros((inner, AXES), np.float32), np.zeros(inner)
    held = {0: sample}
    for i in range(inner):
        mine = held.pop(i)
        along = np.zeros(0)
        if len(mine):
            way[i] = widest(mine)
            along = mine.astype(float) @ way[i].astype(float)
            cut[i] = np.floor(np.median(along))
        held[2 * i + 1], held[2 * i + 2] = mine[along <= cut[i]], mine[along > cut[i]]
    return Tree(way, cut)


class Closest:
    """The hits among blocks of points that can be one of the k nearest of each query, by (row, distance, block, position)."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k = queries.astype(np.float32), k
        self.qq = (self.q * self.q).sum(1)
        self.ahead = np.column_stack([-2 * self.q, np.ones(len(queries), np.float32)])  # times (point, its square): the distance less qq, in whole numbers below 2^24
        self.far = np.full((len(queries), k), np.inf, np.float32)
        self.hits: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def look(self, rows: np.ndarray, points: np.ndarray, block: int, first: int = 0) -> None:
        p = points.astype(np.float32)
        p = np.column_stack([p, (p * p).sum(1)]).T
        n = p.shape[1]
        for s in range(0, len(rows) if n else 0, _CHUNK):
            row = rows[s : s + _CHUNK]
            d = self.ahead[row] @ p
            limit = self.far[row, -1] - self.qq[row]
            if n >= self.k and not np.isfinite(limit).all():
                limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
            at = np.flatnonzero(d <= limit[:, None])
            if not len(at):
                continue
            who, where = at // n, at % n
            dist = d.ravel()[at] + self.qq[row[who]]
            self.hits.append((row[who], dist, np.full(len(at), block, np.int32), first + where))
            some, mine = np.unique(who, return_inverse=True)
            owner, value = np.concatenate([np.repeat(np.arange(len(some)), self.k), mine]), np.concatenate([self.far[row[some]].ravel(), dist])
            order = np.lexsort((value, owner))
            begin = np.searchsorted(owner[order], np.arange(len(some)))
            self.far[row[some]] = value[order][begin[:, None] + np.arange(self.k)]

    def found(self) -> tuple[np.ndarray, ...]:
        row, d, block, at = (np.concatenate(x) for x in zip(*self.hits)) if self.hits else (np.zeros(0, t) for t in (np.int64, np.float32, np.int32, np.int64))
        able = d <= self.far[row, -1]
        return row[able], d[able].astype(np.int64), block[able], at[able]


def chosen_boxes(queries: np.ndarray, centres: np.ndarray, own: int, probes: int, reads: int = READS) -> np.ndarray:
    """(queries x probes) the boxes that each query of box ``own`` looks at: its own and those with the nearest centres, of the ``reads`` that most queries have among theirs."""

    def nearest(among: np.ndarray, take: int) -> np.ndarray:
        c = centres[among]
        out = np.empty((len(queries), take), np.int64)
        for s in range(0, len(queries), _CHUNK):
            away = (c * c).sum(1) - 2 * (queries[s : s + _CHUNK] @ c.T)
            away[:, among == own] = -np.inf
            out[s : s + _CHUNK] = among[np.argpartition(away, take - 1, axis=1)[:, :take]]
        return out

    every = np.arange(len(centres))
    if len(every) <= probes:
        return np.tile(every, (len(queries), 1))
    first = nearest(every, probes)
    votes = np.bincount(first.ravel(), minlength=len(every))
    if np.count_nonzero(votes) <= max(reads, probes):
        return first
    return nearest(np.sort(np.argsort(-votes, kind="stable")[: max(reads, probes)]), probes)


def _ranked(row: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For sorted rows: (n x k) positions of each row's k first, and which there are."""
    begin, end = np.searchsorted(row, np.arange(n)), np.searchsorted(row, np.arange(n), "right")
    at = begin[:, None] + np.arange(k)
    return at, at < end[:, None]


def fill(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans (item, window, first word, end word) of items laid one after the other."""
    end = np.cumsum(words)
    begin = end - words
    first, last = begin // window, (end - 1) // window
    count = last - first + 1
    item = np.repeat(np.arange(len(words)), count)
    win = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    a = np.maximum(win * window, begin[item]) - begin[item]
    b = np.minimum((win + 1) * window, end[item]) - begin[item]
    return item, win, a, b


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, f = features(batch.column(1))
        keep = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(n[keep]), _pack(f[keep])], ["id", "words", "f"])


def _pack(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    width = rows.shape[1] * rows.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _unpack(column: pa.Array | pa.ChunkedArray, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), width)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def boxes(docs: DataFrame, id_col: str, text_col: str, leaf: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """(every document's words and profile (id, words, f), the nodes with their box (id, f, leaf), the number of boxes)."""
    spark = docs.sparkSession
    id_field = T.StructField("id", docs.schema[id_col].dataType)
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    found = found.mapInArrow(_profile, T.StructType([id_field, T.StructField("words", T.LongType()), T.StructField("f", T.BinaryType())]))
    profile = scratch.table(found.groupBy("id").agg(F.min(F.struct("words", "f")).alias("r")).select("id", "r.words", "r.f"))
    nodes = scratch.table(profile.groupBy("f").agg(F.min("id").alias("id")).select("id", "f"))
    n, leaves = nodes.count(), 1
    while leaves < MAX_LEAVES and leaves * leaf < n:
        leaves *= 2
    sample = np.zeros((0, BUCKETS), np.uint8)
    if leaves > 1:
        some = nodes.where(F.pmod(F.xxhash64("id"), F.lit(-(-n // SAMPLE))) == 0).select("f").sort("f")
        sample = _unpack(_flat(some.toArrow().column(0)), np.uint8, BUCKETS)
    sent = spark.sparkContext.broadcast(grow(sample, leaves))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inside = sent.value.leaf(_unpack(batch.column(1), np.uint8, BUCKETS))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(inside)], ["id", "f", "leaf"])

    return profile, nodes.mapInArrow(put, T.StructType([id_field, T.StructField("f", T.BinaryType()), T.StructField("leaf", T.IntegerType())])), leaves


def neighbours(nodes: DataFrame, k: int, probes: int, scratch: Scratch) -> DataFrame:
    """(id, leaf, near): the k nearest of each node by (distance, id), from the probes boxes with the nearest centres."""
    spark, id_field = nodes.sparkSession, nodes.schema["id"]
    folder = scratch.path()
    folder = folder if "://" in folder else f"file://{folder}"
    fs, inner = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(inner, recursive=True)

    def write(part: pa.Table) -> pa.Table:
        from pyspark import TaskContext

        f, box = _unpack(part.column("f"), np.uint8, BUCKETS), part.column("leaf")[0].as_py()
        path = f"{folder}/{box}-{TaskContext.get().taskAttemptId()}"  # an attempt that is lost leaves a file that nobody reads
        fs, inner = pa.fs.FileSystem.from_uri(path)
        kept = part.select(["id", "f"])
        with fs.open_output_stream(inner) as out, pa.ipc.new_stream(out, kept.schema) as writer:
            writer.write_table(kept)
        tk.release()
        return pa.Table.from_arrays([pa.array([box], pa.int32()), pa.array([path]), pa.array([f.mean(0).astype(np.float32).tobytes()])], ["leaf", "path", "centre"])

    files = sorted(nodes.groupBy("leaf").applyInArrow(write, "leaf int, path string, centre binary").collect(), key=lambda r: r.leaf)
    centres = np.array([np.frombuffer(bytes(r.centre), np.float32) for r in files]).reshape(len(files), BUCKETS)
    sent = spark.sparkContext.broadcast(([r.leaf for r in files], [r.path for r in files], centres))

    def held(path: str) -> tuple[pa.Array, np.ndarray]:
        fs, inner = pa.fs.FileSystem.from_uri(path)
        with fs.open_input_file(inner) as source, pa.ipc.open_stream(source) as reader:
            table = reader.read_all()
        return _flat(table.column("id")), _unpack(table.column("f"), np.uint8, BUCKETS)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaves, paths, centres = sent.value
        for own in (x for batch in batches for x in batch.column(0).to_pylist()):
            ids, f = held(paths[own])
            near = Closest(f, k + 1)
            chosen = chosen_boxes(near.q, centres, own, probes)
            box, who = chosen.ravel(), np.repeat(np.arange(len(f)), chosen.shape[1])
            order = np.argsort(box, kind="stable")
            box, who = box[order], who[order]
            touched, begin = np.unique(box, return_index=True)
            end = np.append(begin[1:], len(box))
            names: dict[int, pa.Array] = {}
            for j in np.argsort((centres[touched] ** 2).sum(1) - 2 * centres[touched] @ near.q.mean(0), kind="stable"):  # the nearest first, so that later ones have a narrow limit
                b = int(touched[j])
                there, points = held(paths[b]) if b != own else (ids, f)
                before = len(near.hits)
                near.look(who[begin[j] : end[j]], points, b)
                if len(near.hits) > before:
                    names[b] = there
            row, d, block, at = near.found()
            turn = np.argsort(block, kind="stable")
            row, d, block, at = row[turn], d[turn], block[turn], at[turn]
            named = pa.concat_arrays([names[int(b)].take(pa.array(at[block == b])) for b in np.unique(block)])
            other = pc.not_equal(named, ids.take(pa.array(row))).to_numpy(zero_copy_only=False)
            hits = pa.Table.from_arrays([pa.array(row), pa.array(d), named], ["row", "d", "id"]).filter(pa.array(other)).sort_by([("row", "ascending"), ("d", "ascending"), ("id", "ascending")])
            pick, ok = _ranked(hits.column("row").to_numpy(), len(f), k)
            flat = pa.array(pick[ok])
            offsets = pa.array(np.concatenate([[0], np.cumsum(ok.sum(1))]).astype(np.int32))
            both = pa.StructArray.from_arrays([_flat(hits.column("d")).take(flat), _flat(hits.column("id")).take(flat)], ["d", "id"])
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), leaves[own], np.int32)), pa.ListArray.from_arrays(offsets, both)], ["id", "leaf", "near"])
            tk.release()

    pair_type = T.ArrayType(T.StructType([T.StructField("d", T.LongType()), id_field]))
    schema = T.StructType([id_field, T.StructField("leaf", T.IntegerType()), T.StructField("near", pair_type)])
    every = spark.range(len(files), numPartitions=max(1, len(files)))  # the boxes' files hold all that is needed, so nothing is shuffled
    return every.select(F.col("id").cast("int").alias("box")).mapInArrow(match, schema)


def _coded(columns: list[pa.ChunkedArray]) -> tuple[int, list[np.ndarray]]:
    """(number of distinct values, each column as places in them, which are in order)."""
    flat = pa.concat_arrays([_flat(c) for c in columns])
    if pa.types.is_integer(flat.type):
        values, codes = np.unique(flat.to_numpy(), return_inverse=True)
    else:
        values = pc.unique(flat)
        values = values.take(pc.array_sort_indices(values))
        codes = pc.index_in(flat, value_set=values).to_numpy()
    return len(values), np.split(codes.astype(np.int32), len(columns))


def one_by_one(part: pa.Table) -> pa.Table:
    """The edges (u, v) that are taken of (r, u, v, fu, fv, su, sv), in the order of r."""
    part = part.sort_by("r")
    n, columns = _coded([part.column(c) for c in ("u", "v", "fu", "fv")])
    used = np.zeros(n, np.int8)
    for end, twice in zip(columns, ("su", "sv")):
        used[end[part.column(twice).to_numpy()]] = 1
    used, name, taken = used.tolist(), list(range(n)), []
    for s in range(0, len(part), 1 << 16):
        for i, (a, b, x, y) in enumerate(zip(*(c[s : s + (1 << 16)].tolist() for c in columns)), s):
            if used[a] > 1 or used[b] > 1:
                continue
            while name[x] != x:
                name[x] = x = name[name[x]]
            while name[y] != y:
                name[y] = y = name[name[y]]
            if x != y:
                name[max(x, y)] = min(x, y)
                used[a] += 1
                used[b] += 1
                taken.append(i)
    tk.release()
    return part.select(["u", "v"]).take(pa.array(taken, pa.int64()))


def taken(near: DataFrame, scratch: Scratch, rest: int = REST) -> DataFrame:
    """(u, v) of the edges that are taken: those of taking all, one by one, in the order of (lower degree, distance, u, v)."""
    id_type = near.schema["id"].dataType
    edges = scratch.table(near.select("id", F.explode("near").alias("e")).select(F.least("id", "e.id").alias("u"), F.greatest("id", "e.id").alias("v"), "e.d").distinct())
    degree = edges.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    ranked = edges.join(degree.toDF("u", "nu"), "u").join(degree.toDF("v", "nv"), "v").select(F.least("nu", "nv").alias("g"), "d", "u", "v")
    ranked = ranked.repartitionByRange("g", "d", "u", "v").sortWithinPartitions("g", "d", "u", "v")
    live = scratch.table(ranked.select(F.monotonically_increasing_id().alias("r"), "u", "v", F.col("u").alias("fu"), F.col("v").alias("fv"), F.lit(False).alias("su"), F.lit(False).alias("sv")))
    scratch.drop(edges)
    pair = T.StructType([T.StructField(c, id_type) for c in "uv"])
    every = near.sparkSession.createDataFrame([], pair)
    while (left := live.count()) > rest:
        best = live.select(F.explode(F.array("fu", "fv")).alias("f"), "r").groupBy("f").agg(F.min("r").alias("r"))
        first = best.groupBy("r").agg(F.count("*").alias("n")).where("n = 2").select("r")
        won = scratch.table(live.join(first, "r", "left_semi").select("u", "v", "fu", "fv"))
        every = every.unionByName(won.select("u", "v"))
        moved = won.select(F.explode(F.array(*(F.struct(F.col(f"f{x}").alias("f"), F.col(x).alias("x"), F.least("fu", "fv").alias("new")) for x in "uv"))).alias("m")).select("m.*")
        after = live
        for x in "uv":
            m = moved.toDF("__f", "__x", "__new")
            hit = F.col("__x").eqNullSafe(F.col(x))
            after = after.join(m, F.col(f"f{x}") == F.col("__f"), "left").where(~(hit & F.col(f"s{x}")))
            after = after.withColumns({f"f{x}": F.coalesce("__new", f"f{x}"), f"s{x}": F.col(f"s{x}") | hit}).drop("__f", "__x", "__new")
        before, live = live, scratch.table(after.where("fu <> fv"))
        scratch.drop(before)
    return every.unionByName(live.groupBy(F.lit(True)).applyInArrow(one_by_one, pair)) if left else every


def places(nodes: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(f, path, pos): each node's path, named by the smaller of its ends, and place on it from that end."""
    turned = F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("to")), F.struct(F.col("v").alias("id"), F.col("u").alias("to"))))
    both = scratch.table(links.select(turned.alias("l")).select("l.*"))
    # (id, came) stands for coming to id from came: far nodes beyond it, up to and with the one that is at, coming from via; via is null at a path's end
    first = both.select(F.col("to").alias("id"), F.col("id").alias("came"))
    onward = both.join(first, "id").where("to <> came").select("id", "came", F.col("to").alias("at"), F.col("id").alias("via"), F.lit(1).cast("long").alias("far"))
    ends = both.groupBy("id").agg(F.count("*").alias("n"), F.min("to").alias("came")).where("n = 1").select("id", "came", F.col("id").alias("at"), F.lit(None).cast(nodes.schema["id"].dataType).alias("via"), F.lit(0).cast("long").alias("far"))
    now = scratch.table(onward.unionByName(ends))
    while not (open_ := now.where("via is not null")).isEmpty():  # rounds grow with the logarithm of the longest path
        then = now.toDF("at", "via", "at2", "via2", "far2")
        further = open_.join(then, ["at", "via"]).select("id", "came", F.col("at2").alias("at"), F.col("via2").alias("via"), (F.col("far") + F.col("far2")).alias("far"))
        further = scratch.table(further.unionByName(now.where("via is null")))
        scratch.drop(now)
        now = further
    # a node sees an end of its path beyond each of its links; with one link it is itself the other end
    other = both.join(now.select(F.col("id").alias("to"), F.col("came").alias("id"), "at", "far"), ["id", "to"]).select("id", "at", (F.col("far") + 1).alias("far"))
    tips = other.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("at", "far")).alias("near"))
    tip = F.when((F.col("n") == 2) | (F.col("near.at") < F.col("id")), F.col("near")).otherwise(F.struct(F.col("id").alias("at"), F.lit(0).cast("long").alias("far")))
    found = tips.select("id", tip.alias("t")).select("id", F.col("t.at").alias("path"), F.col("t.far").alias("pos"))
    return nodes.select("id", "f").join(found, "id", "left").select("f", F.coalesce("path", "id").alias("path"), F.coalesce("pos", F.lit(0)).alias("pos"))


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = 0
    for batch in batches:
        words = batch.column("words").to_numpy()
        end = total + np.cumsum(words)
        total = int(end[-1]) if len(end) else total
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(end)], [*batch.schema.names, "end"])


def windows(laid: DataFrame, window: int, scratch: Scratch, span: int = RANGE) -> DataFrame:
    """laid: (id, words, path, pos), in whatever order; the documents by (path, pos, id) one after the other, cut into windows."""
    id_type = laid.schema["id"].dataType
    parts = max(1, -(-laid.count() // span))
    order = ("path", "pos", "id")
    laid = laid.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    laid = scratch.table(laid.mapInArrow(_summed, T.StructType([*laid.schema.fields, T.StructField("end", T.LongType())])))
    sums = sorted(laid.groupBy("part").agg(F.max("end").alias("words")).collect())
    start = dict(zip((r.part for r in sums), np.cumsum([0, *(r.words for r in sums)]).tolist()))
    #: how many documents of each part reach into the window in which the next part begins
    edge = [(r.part, (start[r.part] + r.words) // window * window - start[r.part]) for r in sums]
    reach = laid.join(F.broadcast(laid.sparkSession.createDataFrame(edge, "part int, edge bigint")), "part").where(F.col("end") > F.col("edge")).groupBy("part").count()
    reach, carry, held = dict(map(tuple, reach.collect())), {}, 0
    for r in sums:
        carry[r.part] = held
        same = (start[r.part] + r.words) // window == start[r.part] // window
        held = reach.get(r.part, 0) + (held if same else 0)

    def lay(part: pa.Table) -> pa.Table:
        part = part.sort_by("end")
        key, words = part.column("part")[0].as_py(), part.column("words").to_numpy()
        begin, first = start[key], start[key] // window
        item, win, a, b = fill(np.concatenate([[begin - first * window], words])[0 if begin % window else 1 :], window)
        if begin % window:  # what the parts before put into the window in which this one begins
            keep = item > 0
            item, win, a, b = item[keep] - 1, win[keep], a[keep], b[keep]
        slot = np.arange(len(win)) - np.searchsorted(win, win)
        slot[win == 0] += carry[key]
        return pa.table({"window_id": first + win, "slot": slot.astype(np.int32), "doc_id": part.column("id").take(pa.array(item)), "path_id": part.column("path").take(pa.array(item)), "word_start": a, "word_end": b})

    schema = T.StructType([T.StructField("window_id", T.LongType()), T.StructField("slot", T.IntegerType()), T.StructField("doc_id", id_type), T.StructField("path_id", id_type), T.StructField("word_start", T.LongType()), T.StructField("word_end", T.LongType())])
    return laid.groupBy("part").applyInArrow(lay, schema)


def spread(profile: DataFrame, placed: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, words, path, pos) of every document.

    Profiles that at least one document in 1024 has are 1024 at most: they are met by broadcast, so that no task gets
    all their documents.
    """
    count = profile.groupBy("f").agg(F.count("*").alias("n")).where(F.col("n") * 1024 >= profile.count())
    hot = scratch.table(placed.join(F.broadcast(count.select("f")), "f"))
    rest = profile.join(F.broadcast(hot.select("f")), "f", "left_anti").join(placed, "f")
    return profile.join(F.broadcast(hot), "f").unionByName(rest).select("id", "words", "path", "pos")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = NEIGHBOURS, leaf: int = LEAF, window: int = WINDOW, scratch: Scratch | None = None) -> DataFrame:
    """(window_id, slot, doc_id, path_id, word_start, word_end): which words of which document fill each window, in order.

    ``path_id`` is the document at the path's beginning.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    profile, nodes, _ = boxes(docs, id_col, text_col, leaf, scratch)
    nodes = scratch.table(nodes)
    near = scratch.table(neighbours(nodes, k, PROBES, scratch))
    links = scratch.table(taken(near, scratch))
    placed = scratch.table(places(nodes, links, scratch))
    return windows(spread(profile, placed, scratch), window, scratch)


def assemble(plan: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """plan with a column ``span``: the text from each span's first word up to the word after it."""

    @F.arrow_udf("string")
    def cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for text, a, b in zip(texts.to_pylist(), starts.to_pylist(), ends.to_pylist()):
            data = np.frombuffer(text.encode(), np.uint8)
            at = tk.runs(tk.WORD[data], np.array([0, len(data)]))[0]
            raw = text.encode()
            out.append(raw[at[a] if a else 0 : at[b] if b < len(at) else len(raw)].decode())
        return pa.array(out, pa.string())

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("__text"))
    return plan.join(texts, "doc_id").withColumn("span", cut("__text", "word_start", "word_end")).drop("__text")
