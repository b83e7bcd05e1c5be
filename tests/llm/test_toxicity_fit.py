"""Toxicity learns from every labelled row and from whole texts, and the same however rows lie."""

import random

import numpy as np
import pyarrow as pa
from texts import prose

from graticule.llm import toxicity


def table_of(spark, rows):
    docs = spark.createDataFrame([(k, t, "en") for k, t, _ in rows], "doc_id long, text string, lang string")
    return docs, spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")


def learned(net, word):
    return net.embedding[toxicity.features(word)[0]].any()


def test_long_texts_are_learned(spark):
    """A word that only texts of more than 8,000 characters hold, and there at the end, is learned."""
    rng = random.Random(21)
    rows = [(k, prose(rng, 30), 0) for k in range(100)] + [(k, prose(rng, 1500) + (" vilest" if k % 2 else ""), k % 2) for k in range(100, 160)]
    assert min(len(t) for _, t, y in rows if y) > 8000
    net = toxicity.fit(*table_of(spark, rows))
    assert learned(net, "vilest") and not learned(net, "neverthere")
    clean, vile = net.scores([prose(rng, 1500), prose(rng, 1500) + " vilest"])
    assert vile > 0.3 > clean


def test_no_labelled_row_is_left_out(spark):
    """Words that 6 of 9,000 rows hold each are known: a sample of 3,000 rows would hardly hold three of them."""
    rows = [(k, f"word{k % 60} rare{k // 6 if k < 300 else 'none'}", int(k < 9000)) for k in range(9300)]
    net = toxicity.fit(*table_of(spark, rows))
    assert sum(learned(net, f"rare{i}") for i in range(50)) > 40


def test_layout_of_rows_does_not_matter(spark, monkeypatch):
    """Many parts, in few tasks or many: the same weights, scale and thresholds, bit by bit."""
    monkeypatch.setattr(toxicity, "PART_ROWS", 60)
    rng = random.Random(22)
    rows = [(k, prose(rng, rng.randint(0, 40)) + (" vile words" if k % 3 == 0 else ""), int(k % 3 == 0)) for k in range(700)]
    docs, labels = table_of(spark, rows)
    unlabelled = spark.createDataFrame([(k, "vile words", "en") for k in range(1000, 1500)] + [(None, "x", "en"), (5, None, "en")], docs.schema)
    one = toxicity.fit(docs.repartition(1), labels.coalesce(1))
    many = toxicity.fit(docs.union(unlabelled).repartition(13), labels.repartition(7))
    for a, b in zip([one.embedding, *one.filters, *one.bias, one.out], [many.embedding, *many.filters, *many.bias, many.out]):
        assert np.array_equal(a, b)
    assert (one.scale, one.threshold, one.thresholds) == (many.scale, many.threshold, many.thresholds)
    fresh = [prose(rng, 20) for _ in range(100)]
    assert (one.scores(fresh) < 0.3).mean() > 0.95 and (one.scores([t + " vile words" for t in fresh]) > 0.3).all()


def test_parts_hold_all_rows(monkeypatch):
    """Texts without a label are dropped, all others packed, wherever batches and parts end."""
    monkeypatch.setattr(toxicity, "PART_WORDS", 25)
    rows, wanted = [], {}
    for part in (0, 1):
        for key in range(part * 100, part * 100 + 30):
            if key % 3:
                rows.append((part, part == 1, key, key % 2, None, None))
            for copy in range(1 + (key == 4)):
                rows.append((part, part == 1, key, None, f"a b w{key}", "en"))
            if key % 3:
                wanted[part, key % 2] = wanted.get((part, key % 2), 0) + 1 + (key == 4)
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.string(), pa.string())
    arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
    whole = pa.RecordBatch.from_arrays(arrays, ["part", "back", "id", "y", "t", "l"])
    for batches in ([whole], [whole.slice(i, 7) for i in range(0, len(rows), 7)]):
        found, cuts = {}, set()
        for out in toxicity.pack(iter(batches)):
            r = out.to_pylist()[0]
            part = toxicity.unpacked(out, 0)
            cuts.add((r["part"], r["cut"]))
            assert r["texts"] == len(part.labels) and part.sizes.sum() == len(part.numbers)
            assert (r["langs"] is None) == (r["part"] == 0) == (r["counts"] is not None)
            for y in part.labels.tolist():
                found[r["part"], y] = found.get((r["part"], y), 0) + 1
        assert found == wanted and len(cuts) > 4


def test_a_rare_label_is_learned():
    """One row in 200: every part learns it beside the many others."""
    rng = random.Random(24)
    texts = [prose(rng, 20) + (" vile words" if k % 200 == 0 else "") for k in range(4000)]
    net = toxicity.train(texts, np.array([float(k % 200 == 0) for k in range(4000)]), [None] * 4000, np.ones(4000))
    fresh = [prose(rng, 20) for _ in range(100)]
    assert (net.scores(fresh) < net.threshold).mean() > 0.95 and (net.scores([t + " vile words" for t in fresh]) > net.threshold).all()


def test_whole_numbers_survive_the_way():
    values = np.array([[0, -1, 1], [1 << 50, -(1 << 50), 255]], np.int64)
    assert np.array_equal(toxicity.from_bytes(toxicity.to_bytes(values)).reshape(2, 3), values)


def test_gradients_of_a_part_equal_differences(monkeypatch):
    """With steps of length 0, one batch adds the squares of its gradients to what is kept of earlier ones."""
    monkeypatch.setattr(toxicity, "RATE", 0.0)
    rng = random.Random(23)
    known, rows = {}, [[0, 0, 0]]
    texts = [prose(rng, 12) + (" vile" if k % 2 else "") for k in range(16)]
    part = toxicity.packed([toxicity.number_words([t], known, rows)[0] for t in texts], [k % 2 for k in range(16)], rows)
    lines, _ = toxicity.start_weights(part.counts(), 16, 8, 16)
    squares = np.full_like(lines, 1e-12)
    toxicity.train_part(lines.copy(), squares, np.ones(toxicity.BUCKETS, bool), part, 0.5, [1])

    def loss(at, change):
        own = lines.copy()
        own[at] += change
        z = toxicity.cut(own).of_words(part.numbers, part.starts, part.table)
        return float(np.mean(np.log1p(np.exp(-np.where(part.labels == 1, z, -z)))))

    chosen = list(map(tuple, np.argwhere(squares > 4e-4)[::7]))
    assert len(chosen) > 5
    for at in chosen:
        assert abs(float(squares[at]) ** 0.5 - abs(loss(at, 2e-3) - loss(at, -2e-3)) / 4e-3) < 4e-3
