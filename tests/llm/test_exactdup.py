"""Exact duplicates against a dictionary of normalised texts."""

import hashlib
import random
from collections import defaultdict

import pytest
from texts import awkward, frame, prose

from graticule.llm import exactdup
from graticule.llm.common import LOWER, UPPER


def normal(text):
    return (text or "").translate(str.maketrans(UPPER, LOWER))


def expected(pairs, largest):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[normal(t)].append(i)
    best = {}
    for t, ids in groups.items():
        some = [i for i in ids if i is not None]
        best[t] = (max(some) if largest else min(some)) if some else None
    return groups, best


@pytest.mark.parametrize("largest", [True, False])
def test_groups_match_a_dictionary(spark, largest):
    rng = random.Random(3)
    pool = [prose(rng, n) for n in (1, 2, 30, 30, 200)] + ["", "same start of sixty-four characters and a bit more, so a cut may fall here" + "x" * 70]
    pairs = awkward(rng) + [(100 + k, rng.choice(pool) if k % 3 else pool[4]) for k in range(1500)]
    pairs += [(5000 + k, pool[-1] + str(k % 7)) for k in range(200)]
    groups, best = expected(pairs, largest)
    rows = exactdup.groups(frame(spark, pairs), keep_largest=largest).collect()
    assert len(rows) == len(pairs)
    found = sorted((r.doc_id is None, r.doc_id or 0, r.text_sha256, r.keep_id or -1, r.group_size) for r in rows)
    wanted = sorted(
        (i is None, i or 0, hashlib.sha256(normal(t).encode()).hexdigest(), best[normal(t)] or -1, len(groups[normal(t)])) for i, t in pairs
    )
    assert found == wanted
    kept = [r for r in rows if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_deduplicate_keeps_one_row_with_all_columns(spark):
    pairs = awkward(random.Random(4)) + [(50 + k, "hot copy " * 40) for k in range(600)]
    docs = frame(spark, pairs)
    kept = exactdup.deduplicate(docs, keep_largest=True)
    assert kept.columns == docs.columns
    groups, best = expected(pairs, True)
    assert sorted((normal(r.text), r.doc_id or -1) for r in kept.collect()) == sorted((t, i or -1) for t, i in best.items())


def test_a_group_is_spread_over_ranges(spark):
    docs = frame(spark, [(k, "one text for all") for k in range(3000)])
    runs = exactdup.sorted_runs(docs, "doc_id", "text", True)
    assert runs.select("bucket").distinct().count() > 4
    assert exactdup.groups(docs).where("kept and keep_id = 0 and group_size = 3000").count() == 1


def test_no_python_in_the_plan(spark):
    plan = exactdup.groups(frame(spark, [(1, "a"), (2, "b")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_table(spark):
    empty = frame(spark, [])
    assert exactdup.groups(empty).count() == 0 and exactdup.deduplicate(empty).count() == 0
