import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from quadrille.llm import quality as q

WORDS = "the of and river stone garden window morning letter market people winter silver music because without never every other small great".split()


def text(r, good):
    words = r.choices(WORDS, k=r.randint(20, 120))
    if good:
        return " ".join(w + (". " if r.random() < 0.1 else "") for w in words).capitalize()
    kind = r.randrange(3)
    if kind == 0:
        return " ".join(w + r.choice(["***", "%%%", "$$$"]) for w in words)
    return "!! ".join(words).upper() if kind == 1 else " ".join([words[0]] * 80 + [words[1]] * 60)


def corpus(n=600):
    r = random.Random(2)
    good = [r.random() < 0.7 for _ in range(n)]
    return [(i, text(r, g)) for i, g in enumerate(good)], good


def test_statistics_of_a_text_do_not_depend_on_the_others():
    texts = [t for _, t in corpus(30)[0]] + ["", None, "é", "a b  c\n\nd"]
    together = q.statistics(pa.array(texts))
    alone = np.concatenate([q.statistics(pa.array([t], pa.string())) for t in texts])
    np.testing.assert_allclose(together, alone, atol=1e-9)
    names = list(q.STATISTICS)
    last = dict(zip(names, together[-1]))
    assert last["mean_word"] == 1 and np.isclose(last["log_words"], np.log(5)) and last["distinct_words"] == 1


def test_isotonic_equals_the_min_max_formula():
    r = np.random.default_rng(4)
    for _ in range(50):
        w = r.integers(1, 9, 12).astype(float)
        p = np.minimum(r.integers(0, 9, 12), w).astype(float)
        brute = [max(min(p[i : j + 1].sum() / w[i : j + 1].sum() for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
        np.testing.assert_allclose(q.isotonic(p, w), brute)


def test_kernel_is_approximated():
    r = np.random.default_rng(0)
    x = r.normal(size=(40, len(q.STATISTICS))) * 0.7
    z = q.random_features(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * q.WIDTH**2))
    assert np.abs(z @ z.T - exact).mean() < 0.07


def brute_scores(rows, labels, held):
    """(score, probability) of each text: least squares over stacked rows, then the largest of the smallest means of the held-out bins."""
    stats = q.statistics(pa.array([t for _, t in rows]))
    mean, sd = stats.mean(0), stats.std(0)
    z = q.random_features(stats, mean, np.where(sd < 1e-9, 1, sd))
    at = {i: n for n, (i, _) in enumerate(rows)}
    fit = [(at[i], y) for i, y in labels if i not in held]
    x, y = z[[n for n, _ in fit]], np.array([y for _, y in fit], float)
    penalty = np.sqrt(q.RIDGE * len(fit) / q.FEATURES) * np.eye(q.FEATURES, q.FEATURES + 1)
    w = np.linalg.lstsq(np.concatenate([x, penalty]), np.concatenate([y, np.zeros(q.FEATURES)]), rcond=None)[0]
    score, edges = z @ w, np.linspace(-0.5, 1.5, q.BINS - 1)
    p, n = np.zeros(q.BINS), np.zeros(q.BINS)
    for i, y in labels:
        if i in held:
            b = int((edges <= score[at[i]]).sum())
            p[b], n[b] = p[b] + y, n[b] + 1
    used = np.flatnonzero(n)
    level = [max(min(p[used[i] : used[j] + 1].sum() / n[used[i] : used[j] + 1].sum() for j in range(k, len(used))) for i in range(k + 1)) for k in range(len(used))]
    last = [int((used <= int((edges <= s).sum())).sum()) - 1 for s in score]
    return score, np.array([level[k] if k >= 0 else 0.0 for k in last])


def test_the_whole_query_equals_least_squares_and_brute_force_calibration(spark, make):
    rows, good = corpus(160)
    labels = [(i, int(g)) for i, g in enumerate(good) if i % 3]
    held = {r.id for r in spark.range(len(rows)).where(F.pmod(F.xxhash64("id"), F.lit(q.HOLD_OUT)) == 0).collect()}
    score, probability = brute_scores(rows, labels, held)
    got = {r.doc_id: r for r in q.scores(make(rows).repartition(3), make(labels, "doc_id bigint, quality int")).collect()}
    np.testing.assert_allclose([got[i].score for i, _ in rows], score, atol=1e-6)
    near_an_edge = np.abs((score[:, None] - np.linspace(-0.5, 1.5, q.BINS - 1))).min(1) < 1e-6
    assert all(abs(got[i].probability - probability[n]) < 1e-9 and got[i].keep == (probability[n] >= q.KEEP_AT) for n, (i, _) in enumerate(rows) if not near_an_edge[n])


def test_held_out_accuracy_is_high_whatever_the_partitions(make):
    rows, good = corpus()
    docs, labels = make(rows), make([(i, int(g)) for i, g in enumerate(good) if i % 2], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in q.scores(docs.repartition(5), labels).collect()}
    assert len(got) == len(rows)
    unseen = [i for i in range(len(rows)) if i % 2 == 0]
    assert np.mean([got[i].keep == good[i] for i in unseen]) > 0.97
    again = {r.doc_id: r for r in q.scores(docs.coalesce(1), labels).collect()}
    assert max(abs(got[i].score - again[i].score) for i in got) < 1e-6
    kept = {r.doc_id for r in q.drop_low_quality(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.keep}


def test_defined_cases(make):
    rows, good = corpus(120)
    schema = "doc_id bigint, text string, quality int, stats string"
    extra = [(500, None), (501, ""), (None, "some words here"), (7, rows[7][1]), (502, "word " * 300_000)]
    docs = make([(i, t, 0, "s") for i, t in rows + extra], schema)
    labels = make([(i, int(g)) for i, g in enumerate(good)] + [(3, None), (None, 1), (7, int(good[7]))], "doc_id bigint, quality int")
    got = q.scores(docs, labels).collect()
    assert len(got) == 125 and all(0 <= r.probability <= 1 for r in got)
    left = q.drop_low_quality(docs, labels)
    assert left.columns == docs.columns and left.count() == sum(r.keep for r in got)
    for none in (labels.limit(0), labels.where("quality = 1")):
        assert all(r.keep and r.probability == 1 for r in q.scores(docs, none).collect())
    assert q.scores(docs.limit(0), labels).collect() == [] == q.drop_low_quality(docs.limit(0), labels).collect()
