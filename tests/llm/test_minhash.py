import random
import re

import numpy as np
import pyarrow as pa
from quadrille.llm import minhash, textkit

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "ren", "sof", "gra", "pel") for b in ("da", "ne", "ri", "vo", "sta", "lum", "que", "bir")]


def corpus(seed=3, base=60):
    r = random.Random(seed)
    texts = [" ".join(r.choices(WORDS, k=r.randint(30, 200))) for _ in range(base)]
    for i in range(0, base, 3):
        words = texts[i].split()
        texts.append(" ".join(words))
        for rate in (0.02, 0.06):
            texts.append(" ".join(r.choice(WORDS) if r.random() < rate else w for w in words))
    return list(enumerate(texts))


def exact_jaccard(a, b, k=minhash.SHINGLE):
    def shingles(t):
        w = re.findall(r"\w+", t.lower())
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 0


def groups(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {x: find(x) for x in list(parent) if find(x) != x}


def test_hash_of_a_word_does_not_depend_on_its_place():
    texts = pa.array(["alpha beta", "Beta, ALPHA!", "", None, "xbeta"])
    ((_, data, offs),) = textkit.blocks(texts, lower=True)
    _, _, h, first = textkit.words(data, offs)
    assert list(np.diff(first)) == [2, 2, 0, 0, 1]
    assert h[0] == h[3] and h[1] == h[2] and h[4] not in h[:4]


def test_same_groups_as_brute_force_over_the_signatures(make):
    rows = corpus()
    minima, _ = minhash.signatures(pa.array([t for _, t in rows]))
    low = (minima & 0xFF).astype(np.uint8)
    keys = minhash.band_keys(minima, minhash.BANDS, minhash.ROWS)
    need = minhash.matches_needed(minhash.THRESHOLD, minima.shape[1])
    brute = [(i, j) for i in range(len(rows)) for j in range(i) if (keys[i] == keys[j]).any() and (low[i] == low[j]).sum() >= need]
    for block in (minhash.BLOCK, 2):
        got = {r.doc_id: r.kept_id for r in minhash.near_duplicates(make(rows).repartition(3), block=block).collect()}
        assert got == groups(brute)


def test_recall_against_exact_jaccard_is_at_least_nine_tenths(make):
    rows = corpus(5)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if exact_jaccard(rows[i][1], rows[j][1]) >= minhash.THRESHOLD + 0.05]
    want, got = groups(pairs), {r.doc_id: r.kept_id for r in minhash.near_duplicates(make(rows)).collect()}
    assert len(want) > 40
    assert sum(got.get(i) == k for i, k in want.items()) >= 0.9 * len(want)
    assert not any(max(exact_jaccard(rows[i][1], t) for j, t in rows if j != i) < 0.4 for i in got)


def test_components_of_a_path_a_star_and_a_loop(spark, make):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (50, 50), (None, 3), (3, 2)]
    from quadrille.llm.common import Scratch

    got = {r.node: r.root for r in minhash.components(make(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 120)}
    assert minhash.components(make([], "a bigint, b bigint"), Scratch(spark)).collect() == []


def test_defined_cases(make):
    long = " ".join(WORDS * 3000)
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, "..!"), (6, "One"), (7, "one."), (8, long), (9, long), (9, long), (None, long), (10, "two words"), (11, "Two  words")]
    docs = make([(i, t, 0, "k") for i, t in rows], "doc_id bigint, text string, kept_id int, key string")
    assert {tuple(r) for r in minhash.near_duplicates(docs).collect()} == {(7, 6), (9, 8), (11, 10)}
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 10]
    assert minhash.near_duplicates(docs.limit(0)).collect() == []
    assert minhash.drop_near_duplicates(docs.limit(0)).collect() == []


def test_the_filter_keeps_one_row_of_a_repeated_id(make):
    rows = [(1, "a text of five words", "x"), (1, "a text of five words", "x"), (2, "zeta only here", "y"), (2, "alpha only there", "y"), (2, None, "z"), (None, "lost", "n"), (None, "lost", "n"), (3, "another text stands alone", "k")]
    docs = make([(i, t, s, 0) for i, t, s in rows], "doc_id bigint, text string, again string, i int").repartition(3)
    left = minhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.dtypes == docs.dtypes
    got = sorted((r.doc_id or 0, r.text or "", r.again) for r in left.collect())
    assert got == [(0, "lost", "n"), (0, "lost", "n"), (1, "a text of five words", "x"), (2, "", "z"), (3, "another text stands alone", "k")]
