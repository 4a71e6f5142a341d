"""Trained operators: toxicity and language identification."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import langid, toxicity

from .conftest import prose

RUDE = ["grumbol", "grumbax", "vexhead", "snarkil"]


def labelled_texts(rng, n):
    rows = []
    for i in range(n):
        words = prose(rng, rng.randrange(8, 90)).split(" ")
        toxic = rng.random() < 0.4
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE) if rng.random() < 0.6 else "grum" + rng.choice("abcdefgh") + rng.choice("xyz"))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = labelled_texts(random.Random(6), 700)
    docs = spark.createDataFrame([(i, t, 5, "s") for i, t, _ in rows], "doc_id long, text string, score int, held_out string").repartition(3)
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(None, 1, 0), (9999, 1, 0), (3, None, 0)], "doc_id long, toxic int, predicted int")
    held = F.col("doc_id") % 3 == 1
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, labels, held).collect()}
    return rows, docs, labels, held, got


def test_toxicity_on_held_out_texts(scored):
    rows, _, _, _, got = scored
    held = [(got[i], y) for i, _, y in rows if i % 3 == 1]
    assert all(got[i].held_out == (i % 3 == 1) for i, _, _ in rows)
    assert np.mean([r.predicted == y for r, y in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r, _ in held)


def test_toxicity_reads_the_end_of_long_texts(spark, scored):
    _, docs, labels, held, _ = scored
    calm = prose(random.Random(1), 20_000)
    odd = spark.createDataFrame([(1, calm), (2, calm + " grumbol vexhead grumbol snarkil"), (3, None), (4, ""), (5, " \n"), (6, "!!! ???"), (None, calm), (1, calm)], "doc_id long, text string")
    net = toxicity.fit(docs, labels, held)
    scores = toxicity.scores_of(net, pa.array([r.text for r in odd.collect()], pa.string()))
    assert scores[1] > 0.7 > scores[0] and scores[0] == scores[6] == scores[7] and len(set(scores[[2, 3, 4, 5]])) == 1


def test_scores_do_not_depend_on_the_batch(spark, scored):
    rows, docs, labels, held, got = scored
    net = toxicity.fit(docs, labels, held)
    texts = [t for _, t, _ in rows] + [None, "", prose(random.Random(3), 6000)]
    whole = toxicity.scores_of(net, pa.array(texts, pa.string()))
    for size in (1, 7, 64):
        parts = [toxicity.scores_of(net, pa.array(texts[i:i + size], pa.string())) for i in range(0, len(texts), size)]
        assert np.concatenate(parts).tolist() == whole.tolist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        again = {r.doc_id: r for r in toxicity.score_toxicity(docs.repartition(7), labels, held).collect()}
        kept = {r.doc_id for r in toxicity.keep_clean(docs, labels, held).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert again == got and kept == {i for i, r in got.items() if not r.predicted}


@pytest.mark.parametrize("joint", [".", "_", "-", "\u00a0", "\u3000", ""])
def test_toxicity_reads_the_end_of_long_words(scored, joint):
    _, docs, labels, held, _ = scored
    net = toxicity.fit(docs, labels, held)
    calm = prose(random.Random(2), 300).split()
    rude = "grumbol vexhead grumbol snarkil".split()
    scores = toxicity.scores_of(net, pa.array([joint.join(calm), joint.join(calm + rude), joint.join(calm[:150] + rude + calm[150:])], pa.string()))
    assert scores[1] > 0.7 > scores[0] and scores[2] > 0.7


def test_pieces_of_long_words_hold_every_byte():
    for word in ("x" * 1000, "ab語" * 70, "a" * 65, "é" * 33, "a." * 40, "a" * 64):
        text = pa.array(["one", word, "two " + word], pa.large_string())
        words = toxicity.Words(text)
        raw, solid = words.data, words.data != ord(".")
        lo, hi, doc = toxicity.cut_long(raw, solid, words.start, words.end, words.doc)
        held = np.zeros(len(raw), bool)
        for a, b in zip(lo, hi):
            held[a:b] = True
            bytes(raw[a:b]).decode()
        assert held[solid & (raw != 32)].all() and (np.diff(doc) >= 0).all() and (hi - lo <= toxicity.LONG).all()
        if word == "x" * 1000:
            inner = doc == 1
            assert (hi[inner][:-1] - lo[inner][1:] >= max(toxicity.GRAMS)).all()


def test_toxicity_filter_keeps_rows_whole(scored):
    rows, docs, labels, held, got = scored
    kept = toxicity.keep_clean(docs, labels, held)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _, _ in rows if not got[i].predicted)


def test_toxicity_without_labels(spark, rough_docs, no_docs):
    none = spark.createDataFrame([(1, 1)], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_toxicity(rough_docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(no_docs, none).count() == 0


def test_gradient_of_the_network():
    net = toxicity.Network.fresh(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t = toxicity.Tokens(pa.array(["one two three four five six seven eight nine ten eleven twelve thirteen fourteen", "a b"], pa.large_string()))
    windows, _ = t.windows()
    x = net.inputs(t).astype(np.float64)
    weights = np.array([0.7, -1.3, 0.4])[:len(windows)]
    value = lambda: float(net.forward(net.gate_inputs(x), windows) @ weights)
    grads, d_x = net.backward(x, windows, net.forward(net.gate_inputs(x), windows, keep=True)[1], weights)
    rng = np.random.default_rng(1)
    for name in ("in_f", "rec_f", "off_f", "in_b", "rec_b", "off_b", "attend", "query", "out", "bias"):
        flat = net.p[name].reshape(-1)
        k = int(rng.integers(len(flat)))
        kept = flat[k]
        flat[k] = kept + 1e-3
        up = value()
        flat[k] = kept - 1e-3
        down = value()
        flat[k] = kept
        assert abs((up - down) / 2e-3 - grads[name].reshape(-1)[k]) < 2e-3, name
    kept = x[2, 5]
    x[2, 5] = kept + 1e-3
    up = value()
    x[2, 5] = kept - 1e-3
    assert abs((up - value()) / 2e-3 - d_x[2, 5]) < 2e-3


SOUNDS = {"aa": ["lum", "tor", "vin", "sel"], "bb": ["çhi", "öre", "ñam", "éul"], "cc": ["kra", "zwo", "pfu", "dst"]}


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        lang = rng.choice(list(SOUNDS))
        words = ["".join(rng.choice(SOUNDS[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(4, 60))]
        rows.append((i, " ".join(words), lang if rng.random() < 0.9 else None, lang))
    docs = spark.createDataFrame([(i, t, k, 1.0, "x") for i, t, k, _ in rows], "doc_id long, text string, lang string, score double, label string").repartition(3)
    return rows, docs


def test_languages_on_held_out_texts(spoken):
    rows, docs = spoken
    got = {r.doc_id: r for r in langid.identify(docs, learn=F.col("doc_id") % 4 != 2).collect()}
    held = [(got[i], k) for i, _, _, k in rows if i % 4 == 2]
    assert np.mean([r.lang_pred == k for r, k in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([r.accepted for r, k in held if r.lang_pred == k]) > 0.9


def test_languages_of_odd_texts(spark, spoken, rough_docs, rough, no_docs):
    _, docs = spoken
    odd = spark.createDataFrame([(1000, None, None), (1001, "", None), (1002, "12 34 !!", None), (1003, "日本", None), (None, "lumtor vinsel", None), (1004, "çhiöre " * 30_000, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text", "lang").unionByName(odd), learn=F.col("doc_id") < 1000).collect()}
    assert [(got[k].lang_pred, got[k].score, got[k].accepted) for k in (1000, 1001, 1002)] == [("und", 0.0, False)] * 3
    assert got[1003].lang_pred in SOUNDS and got[None].lang_pred == "aa" and got[1004].lang_pred == "bb"
    nothing = langid.identify(rough_docs, learn=F.lit(False)).collect()
    assert len(nothing) == len(rough) and {(r.lang_pred, r.score, r.accepted) for r in nothing} == {("und", 0.0, False)}
    assert langid.identify(no_docs).count() == 0


def test_subwords_do_not_depend_on_neighbours():
    texts = ["Lumtor vin", "", "çhi-öre 12 x", "Lumtor vin", "LUMTOR  VIN"]
    doc, bucket = langid.subwords(pa.array(texts, pa.large_string()))
    bags = [sorted(bucket[doc == k].tolist()) for k in range(len(texts))]
    for k, t in enumerate(texts):
        alone = langid.subwords(pa.array([t], pa.large_string()))[1]
        assert sorted(alone.tolist()) == bags[k]
    assert bags[0] == bags[3] == bags[4] and bags[1] == []
