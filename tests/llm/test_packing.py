import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from quadrille.llm import packing as p
from quadrille.llm.common import Scratch

WORDS = [a + b for a in "bcdfgklmnprst" for b in ("a", "en", "io", "ur")]


def corpus(n=300, seed=1):
    r = random.Random(seed)
    topics = [r.sample(WORDS, 12) for _ in range(8)]
    rows = [(i, " ".join(r.choices(topics[i % 8], k=r.randint(3, 90)))) for i in range(n)]
    return rows + [(n + j, rows[4][1]) for j in range(20)]  # more equal documents than neighbours


def nodes_of(rows):
    """(id, profile) of the distinct profiles, and every document's node."""
    n, f = p.features(pa.array([t for _, t in rows]))
    first, node = {}, {}
    for (i, _), words, profile in sorted(zip(rows, n, f), key=lambda r: r[0][0]):
        if words:
            node[i] = first.setdefault(bytes(profile), i)
    return {i: np.frombuffer(profile, np.uint8).astype(np.int64) for profile, i in first.items()}, node


def brute_neighbours(profiles, k):
    ids = sorted(profiles)
    v = np.array([profiles[i] for i in ids])
    out = {}
    for n, i in enumerate(ids):
        d = ((v - v[n]) ** 2).sum(1)
        out[i] = [(int(x), j) for x, j in sorted((d[m], ids[m]) for m in range(len(ids)) if m != n)[:k]]
    return out


def graph(docs, leaf, spark):
    _, nodes, leaves = p.boxes(docs, "doc_id", "text", leaf, Scratch(spark))
    scratch = Scratch(spark)
    nodes = scratch.table(nodes)
    return nodes, scratch.table(p.neighbours(nodes, p.NEIGHBOURS, p.PROBES, scratch)), leaves


def test_neighbours_are_exact_whatever_the_boxes(spark, make):
    rows = corpus()
    for leaf in (1000, 40):
        _, near, leaves = graph(make(rows).repartition(3), leaf, spark)
        assert (leaves > 1) == (leaf == 40)
        assert {r.id: [(e.d, e.id) for e in r.near] for r in near.collect()} == brute_neighbours(nodes_of(rows)[0], p.NEIGHBOURS)


def test_neighbours_are_those_of_the_whole_profiles_when_there_are_more_boxes_than_probes(spark, make):
    rows = corpus(1500, 3)
    profiles = nodes_of(rows)[0]
    _, near, leaves = graph(make(rows).repartition(3), 16, spark)
    assert leaves > p.PROBES
    want, right = brute_neighbours(profiles, p.NEIGHBOURS), 0
    for r in near.collect():
        assert [e.d for e in r.near] == [((profiles[r.id] - profiles[e.id]) ** 2).sum() for e in r.near]
        right += sum(e.d <= want[r.id][-1][0] for e in r.near)
    assert right >= 0.9 * p.NEIGHBOURS * len(profiles)


def test_a_box_reads_few_others():
    r = np.random.default_rng(3)
    queries, centres = r.normal(size=(700, p.BUCKETS)).astype(np.float32), r.normal(size=(90, p.BUCKETS)).astype(np.float32)
    assert (p.chosen_boxes(queries, centres[:30], 4, 40) == np.arange(30)).all()
    away = (centres**2).sum(1) - 2 * queries @ centres.T
    away[:, 7] = -np.inf
    want = np.sort(np.argsort(away, axis=1)[:, :10], axis=1)
    assert (np.sort(p.chosen_boxes(queries, centres, 7, 10, 90), axis=1) == want).all()
    few = p.chosen_boxes(queries, centres, 7, 10, 20)
    votes = np.bincount(want.ravel(), minlength=90)
    assert len(np.unique(few)) <= 20 and (few == 7).any(1).all() and set(np.unique(few)) <= set(np.argsort(-votes, kind="stable")[:20])


def brute_joined(near):
    edges = {(min(i, j), max(i, j)): d for i, js in near.items() for d, j in js}
    degree = defaultdict(int)
    for e in edges:
        for x in e:
            degree[x] += 1
    path, used, taken = {i: {i} for i in near}, defaultdict(int), set()
    for u, v in sorted(edges, key=lambda e: (min(degree[e[0]], degree[e[1]]), edges[e], e)):
        if used[u] < 2 and used[v] < 2 and path[u] is not path[v]:
            used[u], used[v] = used[u] + 1, used[v] + 1
            taken.add((u, v))
            path[u] |= path[v]
            for x in path[v]:
                path[x] = path[u]
    return taken, {i: min(p) for i, p in path.items()}


def brute_places(near, taken):
    """(path, place) of each node: paths are named by the smaller of their ends and begin there."""
    links = defaultdict(list)
    for u, v in taken:
        links[u].append(v)
        links[v].append(u)
    out = {}
    for i in sorted(near):
        if i in out or len(links[i]) == 2:
            continue
        here, before, n = i, None, 0
        while here is not None:
            out[here] = (i, n)
            here, before, n = next((j for j in links[here] if j != before), None), here, n + 1
    return out


def brute_plan(rows, window):
    """The whole query by brute force: all distances, edges one by one, words one by one."""
    profiles, node = nodes_of(rows)
    near = brute_neighbours(profiles, p.NEIGHBOURS)
    place = brute_places(near, brute_joined(near)[0])
    words = {i: int(p.features(pa.array([t]))[0][0]) for i, t in rows}
    out, at = [], 0
    slots = defaultdict(int)
    for path, _, i in sorted((*place[node[i]], i) for i in node):
        done = 0
        while done < words[i]:
            n = min(words[i] - done, window - at % window)
            out.append((at // window, slots[at // window], i, path, done, done + n))
            slots[at // window] += 1
            at, done = at + n, done + n
    return sorted(out)


def test_paths_are_those_of_the_whole_graph_in_rounds_or_one_by_one(spark, make):
    nodes, near, _ = graph(make(corpus(300)), 20, spark)
    wanted = {r.id: [(e.d, e.id) for e in r.near] for r in near.collect()}
    edges, _ = brute_joined(wanted)
    place = brute_places(wanted, edges)
    profile = {bytes(r.f): r.id for r in nodes.collect()}
    for rest in (p.REST, 300, 0):
        scratch = Scratch(spark)
        links = scratch.table(p.taken(near, scratch, rest))
        assert sorted(map(tuple, links.collect())) == sorted(edges)
        assert {profile[bytes(r.f)]: (r.path, r.pos) for r in p.places(nodes, links, scratch).collect()} == place


def test_names_may_be_texts(make):
    rows = [(f"d{i:03d}", t) for i, t in corpus(60)]
    got = p.pack(make(rows, "doc_id string, text string"), window=64).collect()
    want = {r[2:] for r in brute_plan([(int(i[1:]), t) for i, t in rows], 64)}
    assert {(int(r.doc_id[1:]), int(r.path_id[1:]), r.word_start, r.word_end) for r in got} == want


def test_the_whole_query_equals_brute_force_whatever_the_boxes(make):
    rows = corpus()
    for leaf in (1000, 40):
        assert sorted(map(tuple, p.pack(make(rows), window=64, leaf=leaf).collect())) == brute_plan(rows, 64)


def test_windows_continue_over_the_borders_of_ranges(spark, make):
    r = random.Random(5)
    rows = [(i, r.choice((1, 1, 2, 3, 40)), i // 7, i % 7) for i in range(200)]
    laid = make(rows, "id bigint, words bigint, path bigint, pos bigint").repartition(5)
    whole = sorted(map(tuple, p.windows(laid, 16, Scratch(spark)).collect()))
    assert len(whole) > 200
    for span in (100, 7, 3):
        assert sorted(map(tuple, p.windows(laid, 16, Scratch(spark), span).collect())) == whole


def test_many_copies_stand_side_by_side(make):
    rows = [(i, "one text that a third of all rows have") for i in range(0, 900, 3)] + [(i, " ".join(random.Random(i).choices(WORDS, k=30))) for i in range(900) if i % 3]
    plan = p.pack(make(rows), window=64).collect()
    order = [r.doc_id for r in sorted(plan, key=lambda r: (r.window_id, r.slot)) if r.word_start == 0]
    at = [n for n, i in enumerate(order) if i % 3 == 0]
    assert at == list(range(at[0], at[0] + 300)) and len(order) == 900
    assert sorted(map(tuple, plan)) == brute_plan(rows, 64)


def test_windows_hold_every_word_once_and_are_full(make):
    rows = corpus()
    plan = p.pack(make(rows), window=64, leaf=100).collect()
    spans, fills = defaultdict(list), defaultdict(int)
    for r in plan:
        spans[r.doc_id].append((r.word_start, r.word_end))
        fills[r.window_id] += r.word_end - r.word_start
    for i, text in rows:
        mine = sorted(spans[i])
        assert mine[0][0] == 0 and mine[-1][1] == len(text.split()) and all(a[1] == b[0] for a, b in zip(mine, mine[1:]))
    assert sorted(fills) == list(range(len(fills))) and all(fills[w] == 64 for w in sorted(fills)[:-1])
    by = defaultdict(list)
    for r in plan:
        by[r.window_id].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_defined_cases(make):
    long = "word " * 100_000
    rows = [(1, None), (2, ""), (3, "?!"), (None, "lost row"), (4, long), (5, "a b"), (5, "a b"), (5, "a b c"), (6, "a b")]
    docs = make([(i, t, 1, "x") for i, t in rows], "doc_id bigint, text string, leaf int, id string")
    plan = p.pack(docs)
    got = plan.collect()
    assert {r.doc_id for r in got} == {4, 5, 6} and sum(r.word_end - r.word_start for r in got) == 100_004
    assert p.pack(docs.limit(0)).collect() == []
    whole = p.assemble(p.pack(make([(9, "Über. Alles, gut!"), (10, "x y z")]), window=2), make([(9, "Über. Alles, gut!"), (10, "x y z")])).collect()
    for i, t in ((9, "Über. Alles, gut!"), (10, "x y z")):
        assert "".join(r.span for r in sorted(whole, key=lambda r: r.word_start) if r.doc_id == i) == t
