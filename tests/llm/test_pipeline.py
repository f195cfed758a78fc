import random

import corpus_pipeline as cp
import numpy as np
import pyarrow as pa
import pytest
from quadrille.llm import decontam, minhash, quality, secrets
from quadrille.llm.common import Scratch
from test_decontam import semi_global
from test_minhash import groups
from test_quality import text

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, __gone int, id string"


def write(spark, folder, rows, labels, items):
    spark.createDataFrame([(i, t, "en", s, len(t or ""), 0, "x") for i, t, s in rows], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(6)
    good = [r.random() < 0.75 for _ in range(160)]
    texts = [text(r, g) for g in good]
    item = "which quiet harbour keeps the oldest lantern of the northern coast"
    for k, i in enumerate(i for i, g in enumerate(good) if g):
        if k % 9 == 0:
            texts[i] += " " + item.replace("oldest", "oldst" if k % 2 else "oldest")
        elif k % 9 == 1:
            texts[i] += f' token = "{r.getrandbits(160):040x}" end'
        elif k % 9 == 2:
            texts.append(texts[i])
            texts.append(texts[i] + " more")
    rows = [(i, t, f"src{i % 5}") for i, t in enumerate(texts)]
    labels = [(i, int(g), 0) for i, g in enumerate(good) if i % 2]
    return write(spark, tmp_path_factory.mktemp("sf"), rows, labels, [(1, item), (2, "short")]), texts


def test_every_stage_against_brute_force(spark, folder):
    sf, _ = folder
    docs, scratch = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark)
    names = docs.columns
    stages = dict(cp.STAGES)

    def go(name):
        nonlocal docs
        before = {r.doc_id: r for r in docs.collect()}
        docs = scratch.table(stages[name](spark, docs, sf))
        if name != "related_packing":
            assert docs.columns == names
        return before, docs.collect()

    before, left = go("quality_classifier")
    verdict = {r.doc_id: r.keep for r in quality.scores(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    assert {r.doc_id for r in left} == {i for i in before if verdict[i]} and 20 < len(before) - len(left) < 80

    before, left = go("minhash_near_dedup")
    ids = sorted(before)
    minima, _ = minhash.signatures(pa.array([before[i].text for i in ids]))
    low, need = (minima & 0xFF).astype(np.uint8), minhash.matches_needed(minhash.THRESHOLD, minima.shape[1])
    keys = minhash.band_keys(minima, minhash.BANDS, minhash.ROWS)
    brute = groups((ids[a], ids[b]) for a in range(len(ids)) for b in range(a) if (low[a] == low[b]).sum() >= need and (keys[a] == keys[b]).any())
    assert {r.doc_id for r in left} == set(ids) - set(brute) and len(brute) >= 20

    before, left = go("benchmark_decontamination")
    item = decontam.normal(spark.read.parquet(f"{sf}/benchmark.parquet").where("item_id = 1").first().text)
    clean = {i for i, r in before.items() if semi_global(item, decontam.normal(r.text)) > decontam.budget(len(item))}
    assert {r.doc_id for r in left} == clean and len(clean) < len(before)

    before, left = go("secret_scan")
    assert {r.doc_id for r in left} == set(before)
    held = [r for r in left if "token =" in before[r.doc_id].text]
    assert held and all(secrets.REDACTED in r.text and r.n_chars == len(r.text) for r in held)
    assert all(r.text == before[r.doc_id].text for r in left if r not in held)

    before, left = go("related_packing")
    words = {}
    for r in left:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.word_end - r.word_start
    from quadrille.llm import packing

    assert words == {i: int(packing.features(pa.array([r.text]))[0][0]) for i, r in before.items()}


def test_run_is_the_stages_in_a_row(spark, folder):
    sf, _ = folder
    docs, scratch = spark.read.parquet(f"{sf}/documents.parquet"), Scratch(spark)
    for _, stage in cp.STAGES:
        docs = scratch.table(stage(spark, docs, sf))
    assert sorted(map(tuple, cp.run(spark, sf).collect())) == sorted(map(tuple, docs.collect()))


def test_hard_rows_pass_through(spark, tmp_path):
    rows = [(1, None, "a"), (2, "", None), (None, "a lost row of words", "a"), (3, "word " * 100_000, "a"), (4, "tie tie", "a"), (4, "tie tie", "a"), (5, "tie tie", "b")]
    sf = write(spark, tmp_path / "hard", rows, [(1, None, None)], [(1, None)])
    got = cp.run(spark, sf).collect()
    assert {r.doc_id for r in got} == {3, 4}
    empty = write(spark, tmp_path / "empty", [], [], [])
    assert cp.run(spark, empty).collect() == []
