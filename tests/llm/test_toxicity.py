import random
from collections import Counter, defaultdict
from math import log

import numpy as np
import pyarrow as pa
import pytest
from quadrille.llm import toxicity as x
from quadrille.llm.common import Scratch

CALM = [a + b for a in ("ta", "ren", "sol", "mi") for b in ("ne", "dor", "li", "va", "ques")]
RUDE = ["grubling", "snotwad", "fizzbutt"]


def corpus(n=500, seed=8):
    r = random.Random(seed)
    bad = [r.random() < 0.25 for _ in range(n)]
    texts = []
    for b in bad:
        words = r.choices(CALM, k=r.randint(20, 80))
        for _ in range(max(1, len(words) // 25) if b else 0):
            words[r.randrange(len(words))] = r.choice(RUDE)
        texts.append(" ".join(words))
    return list(enumerate(texts)), bad


def grams(text):
    for w in text.lower().split():
        s = bytes([1]) * (x.ORDER - 1) + w.encode() + bytes([2])
        for i in range(len(s) - x.ORDER + 1):
            yield s[i : i + x.ORDER]


class Plain:
    """The same models, written out with dictionaries."""

    def __init__(self, ordinary, toxic, every):
        self.by = [Counter(g for t in ts for g in grams(t)) for ts in (ordinary, toxic)]
        seen = {g for t in every for g in grams(t)}
        self.level = {}
        for m in range(x.ORDER - 1, 0, -1):
            self.level[m] = Counter(g[1:] for g in (seen if m == x.ORDER - 1 else self.level[m + 1]))

    @staticmethod
    def discount(c):
        one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        return one / (one + 2 * two) if one and two else 0.5

    def shared(self, g):
        if not g:
            return 1 / 256
        c = self.level[len(g)]
        same = [v for k, v in c.items() if k[:-1] == g[:-1]]
        d = self.discount(c)
        if not same:
            return self.shared(g[1:])
        return max(c[g] - d, 0) / sum(same) + d * len(same) / sum(same) * self.shared(g[1:])

    def prob(self, k, g):
        c = self.by[k]
        same = [v for h, v in c.items() if h[:-1] == g[:-1]]
        d = self.discount(c)
        if not same:
            return self.shared(g[1:])
        return max(c[g] - d, 0) / sum(same) + d * len(same) / sum(same) * self.shared(g[1:])

    def score(self, text):
        gs = list(grams(text))
        return sum(log(self.prob(1, g)) - log(self.prob(0, g)) for g in gs) / (len(gs) + x.PRIOR)


def test_scores_equal_the_models_written_out(spark, make):
    ordinary, toxic, other = ["tane rendor tane", "soldor mili été"], ["tane grubling", "grubling snot mili mili"], ["quesne tane grub", ""]
    rows = [(t, 0) for t in ordinary] + [(t, 1) for t in toxic] + [(t, -1) for t in other]
    model = x.fit(make(rows, "text string, kind int").repartition(3), Scratch(spark))
    plain = Plain(ordinary, toxic, ordinary + toxic + other)
    texts = ordinary + toxic + other + ["grubling unseen words", "TANE, rendor!"]
    want = [plain.score(t.replace(",", "").replace("!", "")) for t in texts]
    np.testing.assert_allclose(model.score(pa.array(texts)), want, atol=1e-6)


def test_every_labelled_gram_is_kept_whatever_the_limit(spark, make):
    rows, bad = corpus(60)
    docs = make([(t, int(b)) for (_, t), b in zip(rows, bad)], "text string, kind int")
    texts = pa.array([t for _, t in rows] + ["grubling unseen"])
    whole, parts = (x.fit(docs, Scratch(spark), limit) for limit in (x.MAX_GRAMS, 20))
    assert len(whole.files) == 1 and len(parts.files) > 2
    np.testing.assert_allclose(parts.score(texts), whole.score(texts), atol=1e-6)


def test_shared_backoff_sums_to_one_over_the_seen(spark, make):
    codes = np.unique(np.concatenate([x.word_grams(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]))[0] for w in CALM]))
    short, n = np.unique(codes & ((1 << 8 * (x.ORDER - 1)) - 1), return_counts=True)
    by = defaultdict(float)
    rows = make([(int(c), int(k)) for c, k in zip(short, n)], "code bigint, n bigint")
    got = x.backoff(rows, Scratch(spark)).collect()
    assert len(got) == len(short)
    for c, p in got:
        by[int(c) >> 8] += p
    assert max(by.values()) <= 1 + 1e-9


def test_threshold_is_the_best_for_f1():
    r = random.Random(1)
    for _ in range(50):
        bins = [(i, r.randint(0, 5), r.randint(0, 5)) for i in r.sample(range(30), 10)]
        f1 = lambda t: 2 * (tp := sum(b for i, _, b in bins if i >= t)) / max(1, sum(b for _, _, b in bins) + tp + sum(a for i, a, _ in bins if i >= t))
        assert f1(x.best_threshold(bins)) == pytest.approx(max(f1(t) for t in range(31)))
    assert x.best_threshold([(1, 3, 0)]) is None


def test_held_out_accuracy(make):
    rows, bad = corpus()
    labels = make([(i, int(b)) for i, b in enumerate(bad) if i % 2], "doc_id bigint, toxic int")
    for limit in (x.MAX_GRAMS, 120):
        got = {r.doc_id for r in x.toxic(make(rows).repartition(3), labels, max_grams=limit).collect()}
        unseen = [i for i in range(len(rows)) if i % 2 == 0]
        assert np.mean([(i in got) == bad[i] for i in unseen]) > 0.95


def test_defined_cases(make):
    rows, bad = corpus(200)
    extra = [(900, None), (901, ""), (902, "?!"), (None, "grubling snotwad " * 20), (903, "tane " * 200_000), (904, "fizzbutt grubling " * 20), (904, "fizzbutt grubling " * 20)]
    docs = make([(i, t, 5, 0.5) for i, t in rows + extra], "doc_id bigint, text string, toxic int, score double")
    labels = make([(i, int(b)) for i, b in enumerate(bad)] + [(1, None), (None, 1), (904, None)], "doc_id bigint, toxic int")
    got = [r.doc_id for r in x.toxic(docs, labels).collect()]
    assert got.count(904) == 2 and None in got and not {900, 901, 902} & set(got)
    scored, _ = x.scores(docs, labels)
    assert scored.count() == 207
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert x.toxic(docs, none).collect() == []
    assert x.toxic(docs.limit(0), labels).collect() == []
