import itertools
import random

import numpy as np
from quadrille.operators import derive, graphs, lookup, mining, reports
from quadrille.streaming import incremental
from test_mining import D, QUAD, ROWS, V, brute, found, iri


def paths(near, s):
    """(distance, number of shortest paths) to every node in reach, level by level."""
    depth, count, level = {s: 0}, {s: 1}, [s]
    while level:
        following = []
        for v in level:
            for w in near.get(v, ()):
                if w not in depth:
                    depth[w], count[w] = depth[v] + 1, 0
                    following.append(w)
                if depth[w] == depth[v] + 1:
                    count[w] += count[v]
        level = following
    return depth, count


def test_centrality_against_counted_paths(spark):
    r = random.Random(5)
    names = [f"n{i:02}" for i in range(14)]
    edges = sorted({tuple(sorted(r.sample(names, 2))) for _ in range(22)})
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    every = {v: paths(near, v) for v in near}
    n = len(near)
    want = {}
    for v in near:
        score = 0.0
        for s, t in itertools.permutations(near, 2):
            if v in (s, t) or t not in every[s][0] or v not in every[s][0] or t not in every[v][0]:
                continue
            if every[s][0][v] + every[v][0][t] == every[s][0][t]:
                score += every[s][1][v] * every[v][1][t] / every[s][1][t]
        want[v] = (max(every[v][0].values()), score / ((n - 1) * (n - 2)))
    got = {x.node: (x.eccentricity, x.betweenness) for x in graphs.central(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got.keys() == want.keys() and all(got[v][0] == want[v][0] and abs(got[v][1] - want[v][1]) < 1e-9 for v in want)


def test_components_of_long_paths_and_loops(spark):
    edges = [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [("q1", "q2"), ("q2", "q1"), ("q3", "q3")]
    nodes = spark.createDataFrame([(x,) for e in edges for x in e] + [("alone",)], "node string")
    links = spark.createDataFrame(edges, "a string, b string")
    got = {r.node: r.root for r in graphs.components(nodes, links).collect()}
    assert {v for k, v in got.items() if k[0] == "p"} == {"p000"} and got["q2"] == "q1" and got["q3"] == "q3" and got["alone"] == "alone"
    ranked = {r.node: (r.component, r.size) for r in graphs.ranked_components(nodes, links).collect()}
    assert ranked["p005"] == (0, 61) and ranked["q1"] == (1, 2)


def test_no_edges(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node string")
    none = spark.createDataFrame([], "a string, b string, weight bigint")
    row = graphs.metrics(nodes, none).first()
    assert (row.n_nodes, row.n_edges, row.n_components, row.diameter, row.density) == (2, 0, 2, 0, 0.0)


def test_class_index_through_alternatives(spark):
    prefixes = spark.createDataFrame([("x", "http://x/", "r"), ("y", "http://y/", "r"), ("xl", "http://x/long/", "other")], "prefix string, ns string, resource string")
    quads = spark.createDataFrame([iri("g", "http://y/1", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", V + "A"), iri("g", "http://x/long/1", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", V + "B")], QUAD)
    asked = spark.createDataFrame([("http://x/1",), ("http://x/long/1",), ("http://z/1",), (None,)], "entity string")
    got = {tuple(r) for r in lookup.class_index(quads, asked, prefixes).collect()}
    assert got == {("http://x/1", "g", V + "A"), ("http://x/long/1", "g", V + "B")}
    none = prefixes.limit(0)
    assert {tuple(r) for r in lookup.class_index(quads, asked, none).collect()} == {("http://x/long/1", "g", V + "B")}
    assert lookup.uri_formats(prefixes, "r") == ["http://x/", "http://y/"]


def test_inversion_twice_adds_nothing(spark):
    s = "http://www.w3.org/2004/02/skos/core#"
    edges = spark.createDataFrame([("a", s + "broadMatch", "b"), ("b", s + "exactMatch", "c"), ("c", s + "exactMatch", "d")], "source string, predicate string, target string")
    once = derive.infer(edges, transitivity=False)
    twice = derive.infer(once.drop("hops"), transitivity=False)
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} and once.count() == 6
    assert ("b", s + "exactMatch", "d", 2) in {tuple(r) for r in derive.infer(edges, inversion=False).collect()}


def test_regression_against_normal_equations(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 2))
    y = 2 * x[:, 0] - x[:, 1] + r.normal(size=300) * 0.3
    table = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double")
    z, t = (x - x.mean(0)) / x.std(0, ddof=1), (y - y.mean()) / y.std(ddof=1)
    beta = np.linalg.lstsq(z, t, rcond=None)[0]
    got, r2 = reports.standardised_regression(table, ["a", "b"], "y")
    assert np.allclose([v.beta for v in got.collect()], beta, atol=1e-6) and abs(r2 - (1 - ((t - z @ beta) ** 2).sum() / (t * t).sum())) < 1e-6
    slope = reports.added_variable(table, "a", ["b"], "y").first().slope
    assert abs(slope - np.linalg.lstsq(np.column_stack([x, np.ones(300)]), y, rcond=None)[0][0]) < 1e-6
    top = reports.importances(table, ["a", "b"], "y").orderBy("importance", ascending=False).first()
    assert top.feature == "a"


def test_stream_maintains_patterns(spark, tmp_path):
    """A type that arrives after the link turns an untyped pattern into a typed one."""
    source, stored, mined = (str(tmp_path / x) for x in ("in", "quads", "patterns"))
    late = [r for r in ROWS if r[1] == D + "b" and r[3].endswith("#type")]
    batches = [[r for r in ROWS if r not in late], late]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, QUAD).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(QUAD).parquet(source)
        incremental.maintain(stream, stored, mined, str(tmp_path / "state")).awaitTermination()
        assert found(spark.read.parquet(f"{mined}/{n}")) == brute([r for b in batches[: n + 1] for r in b])


def test_pages(spark):
    assert [len(p) for p in incremental.pages(spark.range(25), 10)] == [10, 10, 5] and [len(p) for p in incremental.pages(spark.range(25), 10, 12)] == [10, 2]


def test_mined_counts_add_up(spark):
    one = [r for r in ROWS if r[4] not in (V + "A2", V + "A3")]
    quads = spark.createDataFrame(one, QUAD)
    assert sum(found(mining.mine(quads)).values()) == sum(brute(one).values())
