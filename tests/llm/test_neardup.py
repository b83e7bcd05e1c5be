"""Near duplicates against all pairs, and the signatures against the similarity they estimate."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from texts import awkward, frame, prose

from graticule.llm import bpe, common, neardup


def sets_of(pairs):
    found = {}
    for i, t in pairs:
        words = (t or "").lower().split()
        span = min(5, len(words))
        found.setdefault(i, []).append({tuple(words[k : k + span]) for k in range(len(words) - span + 1)} if span else set())
    return found


def brute_classes(pairs):
    sets = sets_of([p for p in pairs if p[0] is not None])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(x and y and len(x & y) >= 0.8 * len(x | y) for x in sets[a] for y in sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def edited(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = prose(rng, 1) + "q"
    return " ".join(words)


def planted(rng):
    pairs = awkward(rng)
    for g in range(12):
        base = prose(rng, rng.choice([40, 90, 200]))
        pairs += [(100 * (g + 1) + k, edited(rng, base, rng.randint(0, 4))) for k in range(rng.randint(1, 9))]
    hub = prose(rng, 100)
    return pairs + [(5000 + k, edited(rng, hub, 1)) for k in range(60)]


@pytest.mark.parametrize("blocks", [None, 2])
def test_classes_match_all_pairs(spark, monkeypatch, blocks):
    if blocks:  # no hub but the first, and many blocks
        monkeypatch.setattr(neardup, "HUB_BLOCKS", ((1, 1),))
        monkeypatch.setattr(neardup, "BLOCK", blocks)
    pairs = planted(random.Random(8))
    rows = neardup.classes(frame(spark, pairs)).collect()
    assert len(rows) == len(pairs)
    wanted = brute_classes(pairs)
    assert {r.doc_id: r.class_id for r in rows if r.doc_id is not None} == wanted
    assert all(r.kept == (r.doc_id is None or r.class_id == r.doc_id) for r in rows)


@pytest.mark.parametrize("more", [0, 40])
def test_families_joined_by_one_pair_of_different_hubs(spark, monkeypatch, more):
    """One bucket: 5 is like hub 1 and 6 like hub 2 alone, and only the pair 5-6 joins the two families."""
    monkeypatch.setattr(neardup, "BLOCK", 4)
    first = {1: 0, 2: 33, 3: 34, 4: 35, 5: 11, 6: 22} | {10 + k: 0 for k in range(more)}
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(x, x + 100))) for i, x in first.items()], "id long, text string")
    signs = spark.createDataFrame([(i, 100, [7], [0, 0, 0, 0]) for i in first], "id long, n long, bands array<long>, sketch array<long>")
    found = neardup.components(neardup.links(signs, docs, 0.8, 1))
    assert {r.id: r["class"] for r in found.collect()} == dict.fromkeys(first, 1)


def test_rows_sent_grow_as_the_bucket_does(spark, monkeypatch):
    """With three seekers; each of them still meets every other member in exactly one task."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    sent = []
    for size in (100, 200, 400):
        members = spark.range(size).select(F.lit(7).alias("key"), "id", F.lit(size).cast("long").alias("size"))
        members = members.unionByName(spark.range(500, 540).select(F.lit(9).alias("key"), "id", F.lit(40).cast("long").alias("size")))
        rows = neardup.dealt(members.where("id < 3"), members).collect()
        assert {r.key for r in rows} == {7}
        sent.append(len(rows))
        for s in range(3):
            blocks = {(r.x, r.y) for r in rows if r.seeks and r.id == s}
            assert sorted(r.id for r in rows if not r.seeks and (r.x, r.y) in blocks) == list(range(size))
    assert sent[2] < 4.5 * sent[0] and sent[2] < 2 * 400


def test_one_document_of_each_class_stays(spark):
    pairs = [p for p in planted(random.Random(9)) if p[0] not in (6, 14, None)]
    docs = frame(spark, pairs)
    kept = neardup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute_classes(pairs).values()))


def test_empty_tables(spark):
    assert neardup.classes(frame(spark, [])).count() == 0
    assert neardup.classes(frame(spark, [(1, None), (2, "")])).where("kept").count() == 2


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(4)
    element = rng.integers(0, 2**63, 300).astype(np.uint64)
    left, right = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    right[:100] = left[:100]
    true = np.minimum(left, right).sum() / np.maximum(left, right).sum()
    a, b = neardup.dart_signatures([element, element], [left, right], 4000)
    assert abs((a == b).mean() - true) < 0.03
    again = neardup.dart_signatures([element[::-1]], [left[::-1]], 4000)[0]
    assert (again == a).all()


def test_a_small_set_fills_its_signature():
    signature = neardup.dart_signatures([np.array([7], np.uint64)], [np.ones(1)], 228)
    assert (signature != 0).all()


def test_components_follow_long_paths(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 200), (300, 200)]
    found = {r.id: r["class"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100}


def test_many_short_texts_need_little_memory():
    """Every set throws about 1,700 darts however small it is, so their number at once must not grow with the batch."""
    sets = [np.array([3 * k, 3 * k + 1, 3 * k + 2], np.uint64) for k in range(6000)]
    weights = [np.ones(3)] * len(sets)
    tracemalloc.start()
    found = neardup.dart_signatures(sets, weights, 228)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6
    picked = [0, 511, 512, 5999]
    assert all(np.array_equal(found[k], neardup.dart_signatures([sets[k]], [weights[k]], 228)[0]) for k in picked)


def test_a_worker_keeps_the_words_of_one_operator_only():
    bpe.known_stretches("path", "pattern")["word"] = b"1234"
    neardup.known_words()["word"] = 1
    common.release("graticule.llm.neardup")
    assert neardup.known_words() == {"word": 1} and bpe.known_stretches("path", "pattern") == {}
    common.release("graticule.llm.bpe")
    assert neardup.known_words() == {}


def test_operators_release_what_others_keep(spark):
    """In the worker as well: it runs one operator's task, then another's."""
    docs = frame(spark, [(k, f"some words of text {k}") for k in range(20)]).repartition(1)
    neardup.signed(docs.select(F.col("doc_id").alias("id"), "text")).collect()

    def told(batches):
        from graticule.llm import neardup as there

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(there.known_words())], pa.int64())], ["n"])

    assert {r.n for r in common.mapped(docs.select("doc_id"), told, "n long").collect()} == {0}


@pytest.mark.parametrize("seeking", [True, False])
def test_classes_grow_by_links_found_in_blocks(spark, seeking):
    """Classes known before the blocks meet are joined by the links that the blocks add, and stay where none are added."""
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (8, 9)], "a long, b long")
    label = neardup.components(edges)
    more = spark.createDataFrame([(3, 9)] if seeking else [], "a long, b long")
    found = {r.id: r["class"] for r in neardup.components(neardup.spokes(label).unionByName(more)).collect()}
    assert found == ({k: 1 for k in (1, 2, 3, 7, 8, 9)} if seeking else {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7})
