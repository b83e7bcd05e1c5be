"""Edit matching against dynamic programming, and planted passages."""

import random

from texts import awkward, frame, prose

from graticule.llm import decontam


def brute(item, window):
    before = [0] * (len(window) + 1)
    for i, c in enumerate(item):
        row = [i + 1]
        for j, d in enumerate(window):
            row.append(min(before[j] + (c != d), before[j + 1] + 1, row[j] + 1))
        before = row
    return min(before)


def test_distance_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(1500):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        window = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        assert decontam.closest(item, window)[0] == brute(item, window)


def damaged(rng, text, edits):
    text = list(text)
    for _ in range(edits):
        k = rng.randrange(len(text))
        text[k : k + rng.randint(0, 1)] = rng.choice(["", "z", "qz"])[: rng.randint(0, 1) or 1]
    return "".join(text)


def test_matches_equal_a_search_of_every_text(spark):
    rng = random.Random(2)
    items = [(k, prose(rng, rng.randint(12, 40))) for k in range(8)] + [(8, None), (9, ""), (10, "tiny"), (3, prose(rng, 15))]
    pairs = awkward(rng)
    for k in range(60):
        item = rng.choice(items[:8])[1]
        pairs.append((200 + k, f"{prose(rng, 30)} {damaged(rng, item, rng.randint(0, 14)).upper()}\n {prose(rng, 30)}"))
    benchmark = spark.createDataFrame([(i, t, 1, "x") for i, t in items], "item_id bigint, text string, id int, item string")
    wanted = set()
    for i, t in pairs:
        text = decontam.normalised(t or "")
        for key, item in items:
            item = decontam.normalised(item or "")
            if item and text and len(text) < 5000 and brute(item, text) <= decontam.budget(len(item)):
                wanted.add((i, key))
    for block in (decontam.BLOCK_CHARACTERS, 300):
        rows = decontam.matches(frame(spark, pairs), benchmark, block=block).collect()
        assert {(r.doc_id, r.item_id) for r in rows if r.doc_id != 10} == wanted
        assert all(0 <= r.distance <= r.allowed for r in rows)
    clean = decontam.clean(frame(spark, pairs), benchmark)
    assert {r.doc_id for r in clean.collect()}.isdisjoint({i for i, _ in wanted})


def test_empty_sides(spark):
    benchmark = spark.createDataFrame([(1, "an item of some length")], "item_id bigint, text string")
    docs = frame(spark, awkward(random.Random(3)))
    assert decontam.matches(frame(spark, []), benchmark).count() == 0
    assert decontam.matches(docs, benchmark.where("false")).count() == 0
    assert decontam.clean(docs, benchmark.where("false")).count() == docs.count()
