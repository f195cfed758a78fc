"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has ``VNODES`` points on a ring of 64-bit hashes.  A key belongs to the first point at or after its
own hash; no shard takes more than ceil((1 + EPSILON) * keys / shards) keys, and a key that finds its shard full
goes on clockwise to the next shard with room (Mirrokni, Thorup and Zadimoghaddam 2018).  Keys arrive in the
order of a second hash, which makes the result independent of how the rows are stored.

Because every shard prefers the same keys, that sequential filling equals deferred acceptance: a shard is described
by the arrival up to which it takes keys; shards that hold too many lower it to that of their last key within
capacity, keys beyond it move on, until none holds too many.  The driver does this on counts alone: keys by arc of the
ring and leading bits of their arrival, at most ``CELLS`` counts whatever the number of keys.  Only where a shard's last
key lies inside a range of arrivals, that range is counted again by its next bits, so there are about as many
counting jobs as the logarithm of the keys, none of which shuffles keys, and one pass assigns them.

Cases.  Rows with a null key have no shard and aren't in the result.  Rows that repeat a key are one key.  Keys of
other types than whole numbers may tie in all 64 bits of arrival: those that tie at a shard's last place are all
taken, so it holds so many more.  An empty table gives an empty result; fewer keys than shards leave shards empty.  Only
the key column is read; if its name is that of a column of the result, the result's gets a name that is free.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

SHARDS, VNODES, EPSILON, CELLS = 64, 128, 0.05, 1 << 21
_SIGN = np.uint64(1 << 63)
_TOP = np.uint64((1 << 64) - 1)


@dataclass
class Ring:
    """Points in ascending order, and the shard of each."""

    shards: int = SHARDS
    vnodes: int = VNODES
    points: np.ndarray = field(init=False)
    owner: np.ndarray = field(init=False)

    def __post_init__(self):
        made = [(int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big", signed=True), s) for s in range(self.shards) for v in range(self.vnodes)]
        made.sort()
        self.points = np.array([p for p, _ in made], np.int64)
        self.owner = np.array([s for _, s in made], np.int32)

    def arc(self, at: np.ndarray) -> np.ndarray:
        """The point at or after each hash, clockwise."""
        return (np.searchsorted(self.points, at) % len(self.points)).astype(np.int32)

    def held(self, arc: np.ndarray, arrival: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """The first shard from each arc on, clockwise, that takes keys up to this arrival (unsigned); -1 if none does."""
        out, left, at = np.full(len(arc), -1, np.int32), np.arange(len(arc)), arc.astype(np.int64)
        for _ in range(len(self.owner)):
            shard = self.owner[at]
            fits = arrival[left] <= limit[shard]
            out[left[fits]] = shard[fits]
            left, at = left[~fits], (at[~fits] + 1) % len(self.owner)
            if not len(left):
                break
        return out


@dataclass
class Counts:
    """Keys by arc and range of arrivals: ``last`` is the range's highest, ``bits`` how many leading bits it fixes."""

    arc: np.ndarray
    last: np.ndarray
    bits: np.ndarray
    n: np.ndarray

    def limits(self, ring: Ring, capacity: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the limits, each at the end of a range, that no shard can lower without falling below capacity; the loads)."""
        while True:
            shard = ring.held(self.arc, self.last, limit)
            loads = np.bincount(shard, self.n, ring.shards).astype(np.int64)
            before = limit.copy()
            for s in np.flatnonzero(loads > capacity):
                mine = np.flatnonzero(shard == s)
                mine = mine[np.argsort(self.last[mine], kind="stable")]
                limit[s] = self.last[mine[np.searchsorted(np.cumsum(self.n[mine]), capacity)]]
            if (limit == before).all():
                return limit, loads


def _counted(keys: DataFrame, bits: int) -> DataFrame:
    return keys.groupBy("arc", F.shiftrightunsigned("arrival", 64 - bits).alias("prefix")).agg(F.count("*").alias("n"))


def _cells(counted: DataFrame, bits: int) -> Counts:
    found = counted.toArrow()
    prefix = found.column("prefix").to_numpy().astype(np.uint64)
    last = (prefix << np.uint64(64 - bits)) | (_TOP >> np.uint64(bits) if bits < 64 else np.uint64(0))
    return Counts(found.column("arc").to_numpy().astype(np.int32), last, np.full(len(last), bits), found.column("n").to_numpy())


def settled(keys: DataFrame, ring: Ring, capacity: int, cells: int = CELLS) -> np.ndarray:
    """The limit of each shard for keys (arc, arrival), arrival being an unsigned number in a bigint."""
    spark, arcs = keys.sparkSession, len(ring.points)
    bits = max(1, min(16, (cells // arcs).bit_length() - 1))
    counts, limit = _cells(_counted(keys, bits), bits), np.full(ring.shards, _TOP)
    while True:
        limit, loads = counts.limits(ring, capacity, limit)
        cut = np.isin(counts.last, np.unique(limit[loads > capacity])) & (counts.bits < 64)
        if not cut.any():
            return limit
        known = int(counts.bits[cut].min())  # ranges that fix fewest bits first, so that one job counts by one number of bits
        cut &= counts.bits == known
        ranges = np.unique(counts.last[cut] >> np.uint64(64 - known))
        bits = min(64, known + max(1, (cells // (arcs * len(ranges))).bit_length() - 1))
        wanted = spark.createDataFrame([(int(x.astype(np.int64)),) for x in ranges], "prefix bigint")  # at most one for each shard
        part = keys.withColumn("prefix", F.shiftrightunsigned("arrival", 64 - known)).join(F.broadcast(wanted), "prefix", "left_semi").drop("prefix")
        finer = _cells(_counted(part, bits), bits)
        counts = Counts(*(np.concatenate([a[~cut], b]) for a, b in ((counts.arc, finer.arc), (counts.last, finer.last), (counts.bits, finer.bits), (counts.n, finer.n))))


def assign(rows: DataFrame, key: str = "doc_id", shards: int = SHARDS, vnodes: int = VNODES, epsilon: float = EPSILON, scratch: Scratch | None = None) -> DataFrame:
    """(key, shard, home_shard, moved) for each distinct key; ``home_shard`` is the ring's without bounds."""
    scratch = scratch or Scratch(rows.sparkSession)
    ring = Ring(shards, vnodes)

    @F.arrow_udf("int")
    def arc(at: pa.Array) -> pa.Array:
        return pa.array(ring.arc(at.to_numpy(zero_copy_only=False)))

    unique = rows.select(F.col(key).alias("key")).where("key is not null").distinct()
    arrival = F.xxhash64("key", F.lit("arrival")).bitwiseXOR(F.lit(-(1 << 63)))  # in the order of unsigned numbers
    keys = scratch.table(unique.select("key", arc(F.xxhash64("key")).alias("arc"), arrival.alias("arrival")))
    capacity = int(np.ceil((1 + epsilon) * keys.count() / shards))
    limit = settled(keys.select("arc", "arrival"), ring, capacity)

    @F.arrow_udf("int")
    def held(arcs: pa.Array, arrivals: pa.Array) -> pa.Array:
        return pa.array(ring.held(arcs.to_numpy(zero_copy_only=False), arrivals.to_numpy(zero_copy_only=False).view(np.uint64), limit))

    @F.arrow_udf("int")
    def owner(arcs: pa.Array) -> pa.Array:
        return pa.array(ring.owner[arcs.to_numpy(zero_copy_only=False)])

    names = [n + "_" * (n == key.lower()) for n in ("shard", "home_shard", "moved")]
    out = keys.select("key", held("arc", "arrival").alias("s"), owner("arc").alias("h"))
    return out.select(F.col("key").alias(key), F.col("s").alias(names[0]), F.col("h").alias(names[1]), (F.col("s") != F.col("h")).alias(names[2]))
