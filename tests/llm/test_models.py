"""Language identification and toxicity: gradients, held-out accuracy, and rows that must not disturb them."""

import random

import numpy as np
import pytest
from texts import awkward, frame, prose

from graticule.llm import langid, toxicity
from graticule.llm.common import table

SF_DIR = "/root/testdata/sf0.01"


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    net = langid.start_network(["a", "b", "c"], rng)
    for direction in (net.forth, net.back):
        direction.x, direction.u = direction.x.astype(np.float64), direction.u.astype(np.float64)
    data = rng.integers(97, 105, (9, 5))
    data[7:, 2] = 256
    label = np.array([0, 1, 2, 1, 0])
    _, grads = langid.gradients(net, data, label)
    for weights, grad in zip(net.weights(), grads):
        for _ in range(6):
            at = tuple(rng.integers(s) for s in weights.shape) if weights.shape[-1] != 257 else (rng.integers(24), rng.integers(97, 105))
            kept, step = weights[at], 3e-3
            weights[at] = kept + step
            above, _ = langid.gradients(net, data, label)
            weights[at] = kept - step
            below, _ = langid.gradients(net, data, label)
            weights[at] = kept
            assert grad[at] == pytest.approx((above - below) / (2 * step), abs=2e-3)


def test_languages_of_held_out_rows(spark):
    docs = table(spark, SF_DIR, "documents")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 250
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def network():
    rng = random.Random(4)
    english = [prose(rng, 40).encode() for _ in range(60)]
    other = [prose(rng, 40).replace("a", "é").replace("t", "ç").encode() for _ in range(60)]
    return langid.train_network([*english, *other], ["en"] * 60 + ["xx"] * 60, steps=40)


def test_awkward_rows_are_all_labelled(spark, network):
    pairs = awkward(random.Random(5))
    rows = langid.predict(frame(spark, pairs), network).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        if not any(map(str.isalpha, r.text or "")):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "xx") and 0.5 <= r.score <= 1
    assert langid.predict(frame(spark, []), network).count() == 0
    assert langid.identify(frame(spark, [])).count() == 0
    assert {r.lang_pred for r in langid.predict(frame(spark, pairs), None).collect()} == {"und"}


def test_every_position_is_labelled_and_batches_do_not_matter(network):
    text = prose(random.Random(6), 100)
    labels = network.label_positions(text)
    assert len(labels) == len(text.encode()) and labels.count("en") > 0.8 * len(labels)
    alone = network.documents([text.encode()])
    together = network.documents([b"x", text.encode(), b"\xc3\xa9" * 300])
    assert np.allclose(alone[0], together[1], atol=1e-5)


def test_toxicity_of_held_out_rows(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = toxicity.classify(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted == 1 and r.toxic == 1 for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.85
    assert hits / sum(r.predicted for r in rows) > 0.8
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


@pytest.fixture(scope="module")
def classifier():
    rng = random.Random(7)
    texts = [prose(rng, 30) + (" vile words" if k % 3 == 0 else "") + " " + prose(rng, 30) for k in range(800)]
    labels = np.array([float(k % 3 == 0) for k in range(800)])
    return toxicity.train(texts, labels, ["en" if k % 2 else None for k in range(800)], np.ones(800))


def test_a_word_decides_wherever_it_stands(classifier):
    rng = random.Random(8)
    clean = [prose(rng, n) for n in (0, 1, 50, 3000)]
    vile = [f"{a} vile words {b}" for a, b in zip(clean, reversed(clean))]
    assert (classifier.scores(vile) > 0.5).all() and (classifier.scores(clean) < 0.3).all()
    assert np.allclose(classifier.scores(vile), [classifier.scores([t])[0] for t in vile], atol=1e-5)
    assert classifier.thresholds.keys() == {"en"}


def test_awkward_rows_are_all_scored(spark, classifier):
    pairs = awkward(random.Random(9))
    rows = toxicity.predict(frame(spark, pairs), classifier).collect()
    assert len(rows) == len(pairs) and all(0 <= r.score <= 1 for r in rows)
    flagged = toxicity.flag_by_language(toxicity.predict(frame(spark, pairs, lang=None), classifier), classifier)
    assert {r.threshold for r in flagged.collect()} == {classifier.threshold}
    labels = spark.createDataFrame([(1, 0), (2, 1), (5, 1), (5, 0), (None, 1)], "doc_id bigint, toxic int")
    assert toxicity.classify(frame(spark, pairs), labels).count() == len(pairs)
    assert toxicity.classify(frame(spark, pairs), labels.where("false")).where("score = 0.5").count() == len(pairs)
    assert toxicity.classify(frame(spark, []), labels).count() == 0


def test_every_language_with_enough_rows_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    monkeypatch.setattr(langid, "STEPS", 2)
    rows = [(100 * k + i, f"words of {name} number {i}", name) for k, (name, n) in enumerate([("a", 60), ("b", 50), ("c", 30), ("d", 25), ("e", 3)]) for i in range(n)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), langid.F.lit(True))
    assert net.languages == ["a", "b", "c", "d"]


def test_calibrated_thresholds_reach_the_result(spark, monkeypatch):
    """What training calibrates for a language decides the flag of its rows, and no score."""
    monkeypatch.setattr(toxicity, "LEAST_POSITIVES", 5)
    rng = random.Random(11)
    rows = [(k, prose(rng, 20) + (" vile words" if k % 3 == 0 else ""), ("en", "xx", None)[k % 2 + (k % 7 == 0)]) for k in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k, _, _ in rows], "doc_id long, toxic int")
    net = toxicity.fit(docs, labels, ~toxicity.held_out())
    net.thresholds["xx"] = 0.9999
    assert "en" in net.thresholds
    monkeypatch.setattr(toxicity, "fit", lambda *a: net)
    found = {r.doc_id: r for r in toxicity.classify(docs, labels).collect()}
    for k, _, name in rows:
        assert found[k].threshold == net.thresholds.get(name, net.threshold)
        assert found[k].flagged == (found[k].score >= found[k].threshold)
        assert found[k].predicted == int(found[k].score >= 0.3)
    bare = {r.doc_id: r for r in toxicity.classify(docs.drop("lang"), labels).collect()}
    assert {r.threshold for r in bare.values()} == {net.threshold}
    assert all(bare[k].score == found[k].score for k in bare)
