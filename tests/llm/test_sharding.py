from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from quadrille.llm import sharding as s


def brute(keys, ring, epsilon):
    """Keys one by one in the order of arrival, each to the first shard with room, clockwise.  keys: (key, hash, arrival)."""
    capacity = int(np.ceil((1 + epsilon) * len(keys) / ring.shards))
    load, out = Counter(), {}
    for key, at, _ in sorted(keys, key=lambda k: k[2]):
        i = int(ring.arc(np.array([at]))[0])
        while load[int(ring.owner[i])] >= capacity:
            i = (i + 1) % len(ring.owner)
        load[int(ring.owner[i])] += 1
        out[key] = int(ring.owner[i])
    return out


def hashed(frame, key):
    return [tuple(r) for r in frame.where(f"{key} is not null").select(key, F.xxhash64(key), F.xxhash64(key, F.lit("arrival"))).distinct().collect()]


def test_same_shards_as_filling_one_by_one(spark):
    for n, shards, vnodes, epsilon in [(3000, 8, 2, 0.05), (2000, 16, 8, 0.0), (500, 7, 3, 0.3)]:
        frame = spark.range(n).select(F.col("id").alias("doc_id"))
        got = {r.doc_id: r for r in s.assign(frame, shards=shards, vnodes=vnodes, epsilon=epsilon).collect()}
        ring = s.Ring(shards, vnodes)
        assert {k: r.shard for k, r in got.items()} == brute(hashed(frame, "doc_id"), ring, epsilon)
        assert max(Counter(r.shard for r in got.values()).values()) <= np.ceil((1 + epsilon) * n / shards)
        assert all(r.moved == (r.shard != r.home_shard) for r in got.values()) and any(r.moved for r in got.values())


def test_a_new_shard_moves_few_keys(spark):
    frame = spark.range(4000).select(F.col("id").alias("doc_id"))
    a, b = ({r.doc_id: r.shard for r in s.assign(frame, shards=n, epsilon=0.25).collect()} for n in (20, 21))
    assert sum(a[k] != b[k] for k in a) < 0.2 * len(a)


def test_defined_cases(spark, make):
    rows = [(1, "a"), (1, "a"), (2, "b"), (None, "c"), (-5, None), (2**62, "")]
    frame = make([(i, t, 0, "k") for i, t in rows], "doc_id bigint, text string, shard int, key string")
    got = s.assign(frame).collect()
    assert sorted(r.doc_id for r in got) == [-5, 1, 2, 2**62] and all(0 <= r.shard < s.SHARDS for r in got)
    named = {r.text: r.shard for r in s.assign(frame, key="text", shards=3).collect()}
    assert named == brute(hashed(frame, "text"), s.Ring(3), s.EPSILON)
    assert s.assign(frame.limit(0)).collect() == []
    clash = s.assign(frame.select("shard"), key="shard")
    assert clash.columns == ["shard", "shard_", "home_shard", "moved"] and clash.count() == 1


def test_few_cells_give_the_same_limits_and_ties_end(spark):
    ring = s.Ring(8, 4)
    keys = spark.range(3000).select(F.pmod(F.xxhash64("id"), F.lit(32)).cast("int").alias("arc"), F.xxhash64("id", F.lit("x")).alias("arrival"))
    arcs, arrivals = (np.array(c) for c in zip(*keys.collect()))
    shards = [ring.held(arcs, arrivals.view(np.uint64), s.settled(keys, ring, 394, cells)) for cells in (s.CELLS, 64, 1000)]
    assert np.bincount(shards[0]).max() == 394 and all((x == shards[0]).all() for x in shards[1:])
    tied = spark.range(300).select(F.lit(3).alias("arc"), F.lit(77).cast("bigint").alias("arrival"))
    limit = s.settled(tied, ring, 10)
    assert (ring.held(np.full(300, 3), np.full(300, 77, np.uint64), limit) == ring.owner[3]).all()
