"""Long repeats against a count of all strings."""

import hashlib
import random
from collections import Counter

import pytest
from texts import awkward, frame, prose

from graticule.llm import repeats


def brute_starts(texts, length):
    count = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    found = []
    for t in texts:
        stretches = []
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                if stretches and stretches[-1][1] == k - 1:
                    stretches[-1] = (stretches[-1][0], k)
                else:
                    stretches.append((k, k))
        found.append(stretches)
    return found


@pytest.mark.parametrize("length", [1, 3, 8, 10, 20, 200])
def test_index_finds_all_repeated_starts(monkeypatch, length):
    monkeypatch.setattr(repeats, "LENGTH", length)
    rng = random.Random(length)
    for _ in range(60 if length < 100 else 15):
        base = [bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 60 if length < 100 else 500))) for _ in range(3)]
        texts = []
        for _ in range(rng.randint(1, 7)):
            text = bytearray(rng.choice(base) + rng.choice(base)) or bytearray(b"a")
            text[rng.randrange(len(text))] = rng.choice(b"ab")
            texts.append(bytes(text[rng.randrange(len(text)) // 3 :]))
        texts.append(b"a" * rng.randint(1, 500))
        assert repeats.repeated_starts(texts) == brute_starts(texts, length)


def test_a_repetitive_text_has_few_runs():
    text = prose(random.Random(1), 100).encode()
    once, often = repeats.RunLengthIndex([text]), repeats.RunLengthIndex([text] * 50)
    assert often.runs < once.runs + 60 < 0.1 * len(often.symbols)


def corpus(rng):
    passage, line = prose(rng, 70), prose(rng, 14)
    pairs = [(i, t) for i, t in awkward(rng) if i != 10]
    for k in range(40):
        parts = [prose(rng, rng.randint(5, 60)), passage[rng.randint(0, 30) : len(passage) - rng.randint(0, 30)], prose(rng, 30), line]
        rng.shuffle(parts)
        pairs.append((100 + k, "\n".join(parts[: rng.randint(1, 4)])))
    return pairs


def expected(pairs):
    texts = [(t or "").encode() for _, t in pairs]
    for (i, _), t, starts in zip(pairs, texts, brute_starts(texts, repeats.LENGTH)):
        gone = bytearray(len(t))
        for a, b in starts:
            gone[a : b + repeats.LENGTH] = b"\1" * (b + repeats.LENGTH - a)
        spans = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        kept = bytes(c for c, g in zip(t, gone) if not g)
        yield i or -1, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("largest", [repeats.LARGEST_GROUP, 2])
def test_removed_bytes(spark, monkeypatch, largest):
    """With a small bound on groups, longer parts of the strings have to tell them apart."""
    monkeypatch.setattr(repeats, "LARGEST_GROUP", largest)
    pairs = corpus(random.Random(6))
    rows = repeats.remove(frame(spark, pairs), with_text=True).collect()
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows)
    assert found == sorted(expected(pairs))
    assert all(hashlib.sha256(bytes(r.kept or b"")).hexdigest() == r.kept_sha256 for r in rows if r.n_removed)


def test_chunks_of_a_long_text(monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 1000)
    text = prose(random.Random(7), 700).encode()
    starts = sorted((at, at + far - near) for _, *columns in repeats.pieces_of([text]) for at, far, near in zip(*columns[:3]))
    assert starts[0][0] == 0 and starts[-1][1] == len(text) - repeats.LENGTH
    assert all(b + 1 == c for (_, b), (c, _) in zip(starts, starts[1:]))


def test_empty_table(spark):
    assert repeats.remove(frame(spark, [])).count() == 0
