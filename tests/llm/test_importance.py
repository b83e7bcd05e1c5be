"""Importance resampling against plain code, and the search for the cutoff under ties."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from texts import awkward, frame, prose

from graticule.llm import importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, target, percent, least_words, longest=1, buckets=10_000):
    def features(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    held = [(i, *features(t)) for i, t in rows]
    s, t = Counter(b for _, _, f in held for b in f), Counter(b for text in target for b in features(text)[1])
    all_s, all_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for i, n_words, f in held:
        gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in f]
        weight = sum(gain) // len(gain) if gain else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n_words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    ready = [r for r in out if r[1] >= least_words]
    drawn = sorted(ready, key=lambda r: (-r[4], r[0] is None, r[0] or 0))[: percent * len(ready) // 100]
    return out, drawn


@pytest.mark.parametrize("longest", [1, 3])
def test_against_plain_code(spark, longest):
    rng = random.Random(4)
    rows = [*awkward(rng), *[(i, prose(rng, rng.randint(0, 40))) for i in range(100, 400)]]
    target = [prose(rng, 30), None, "", "Ünï x ABC", rows[150][1]]
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    found = importance.resample(frame(spark, rows), items, 20, 10, longest=longest).collect()
    scores, drawn = plain(rows, target, 20, 10, longest)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in found) == Counter((r[0], *r[2:]) for r in scores)
    ranked = sorted((r for r in found if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r.doc_id, r.score) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_empty_tables_and_small_draws(spark):
    items = spark.createDataFrame([(1, "some text")], "item_id int, text string")
    assert importance.resample(frame(spark, []), items).count() == 0
    few = importance.resample(frame(spark, [(1, "a " * 30), (2, None)]), items.limit(0)).collect()
    assert [(r.doc_id, r["rank"]) for r in sorted(few)] == [(1, None), (2, None)]


def test_repeated_rows_are_drawn_one_by_one(spark):
    rows = [(7, "same words again")] * 30 + [(None, "same words again")] * 30
    items = spark.createDataFrame([(1, "words")], "item_id int, text string")
    found = importance.resample(frame(spark, rows), items, 40, 1).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 25))


@pytest.mark.parametrize("wanted", [1, 2, 500, 999, 1000])
@pytest.mark.parametrize("values", [1000, 3, 1])
def test_bracket_holds_the_cutoff(spark, wanted, values):
    rows = spark.range(1000).select((F.col("id") % values).alias("score"))
    lowest, highest, above = importance.bracket(rows, wanted, 1000, accuracy=20)
    scores = sorted((i % values for i in range(1000)), reverse=True)
    assert above == sum(s > highest for s in scores) < wanted
    assert lowest <= scores[wanted - 1] <= highest


def test_places_run_through_all_ranges(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5000).alias("key"))
    found = importance.numbered(rows, [F.desc("key")], "place").collect()
    assert sorted((5000 - r.key, r.place) for r in found) == [(i, i) for i in range(1, 5001)]


def test_outside_the_sketch_is_widened(spark):
    """A sketch that is far off: the exact counts refuse its bracket."""
    rows = spark.range(100_000).select(F.when(F.col("id") < 99_000, F.lit(0)).otherwise(F.col("id")).alias("score"))
    lowest, highest, above = importance.bracket(rows, 1500, 100_000, accuracy=5)
    assert above < 1500 and lowest <= 0
