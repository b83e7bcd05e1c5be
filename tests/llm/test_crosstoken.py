"""Alignment of two tokenizers against plain code, and galloping against plain search."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from texts import awkward, frame, prose
from tokenizers import Tokenizer

from graticule.llm import crosstoken

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def spelled(a, b, libraries):
    """Bytes of each token, from the printed forms."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [i for i in range(256) if i not in visible]
    of = {**{chr(i): i for i in visible}, **{chr(256 + k): i for k, i in enumerate(hidden)}}
    left = [bytes(of[c] for c in libraries[0].id_to_token(i)) for i in a]
    right = []
    for i in b:
        p = libraries[1].id_to_piece(i)
        right.append(bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode())
    return left, right


def plain_groups(text, libraries):
    if not text:
        return []
    a = libraries[0].encode(" " + text, add_special_tokens=False).ids
    b = libraries[1].encode(text)
    left, right = spelled(a, b, libraries)
    if not b"".join(left) == b"".join(right) == (" " + text).encode():
        return []
    ends_a, ends_b = np.cumsum(list(map(len, left))).tolist(), np.cumsum(list(map(len, right))).tolist()
    place_a, place_b = ({end: k + 1 for k, end in enumerate(ends)} for ends in (ends_a, ends_b))
    groups, i, j = [], 0, 0
    for end in sorted(place_a.keys() & place_b.keys()):
        k, m = place_a[end], place_b[end]
        groups.append((a[i:k], b[j:m]))
        i, j = k, m
    return groups


def plain(rows, libraries):
    groups = [plain_groups(t, libraries) for _, t in rows]
    count = Counter(p for g in groups for p in {(x, y) for xs, ys in g for x in xs for y in ys})
    most = {}
    for (x, _), n in count.items():
        most[x] = max(most.get(x, 0), n)
    out = []
    for (i, _), g in zip(rows, groups):
        links = [(x, y) for xs, ys in g for x in xs for y in ys]
        told = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in g)
        out.append((
            i, sum(len(xs) for xs, _ in g), sum(len(ys) for _, ys in g), len(g), len(links),
            sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links),
            hashlib.sha256(told.encode()).hexdigest() if g else "",
        ))
    return out


def rows_of(rng):
    odd = ["  two  spaces ", "a　b ½ ﬁ", "<|endoftext|> <s> </s>", "▁ under", "日本語のテキスト", "🙂🙂 x", "a\r\n\tb", "don't we'll I'm",
           "x" * 3000, "é" * 700, "= " * 300, "\x85 \x1c", "ab" * 2000, "<0x41> <unk>", " lead", "trail "]
    return [*awkward(rng), *[(100 + i, t) for i, t in enumerate(odd)], *[(200 + i, prose(rng, rng.randint(1, 80))) for i in range(60)]]


@pytest.mark.parametrize("most_frequent", [1 << 20, 300, 0])
def test_against_plain_code(spark, libraries, most_frequent):
    """Also where few or none of the pairs may be held by every task, and the others are joined."""
    rows = rows_of(random.Random(3))
    found = crosstoken.align(frame(spark, rows), *PATHS).cache()
    width = libraries[1].get_piece_size()
    summed = crosstoken.summed(found, crosstoken.pair_counts(found, width), most_frequent)
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, summed.select(*names).collect())) == Counter(plain(rows, libraries))


def test_groups_and_links_are_returned(spark, libraries):
    text = prose(random.Random(5), 12)
    row = crosstoken.align(frame(spark, [(1, text)]), *PATHS).first()
    groups = plain_groups(text, libraries)
    assert row.groups == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
    width = libraries[1].get_piece_size()
    links = Counter(x * width + y for a, b in groups for x in a for y in b)
    assert dict(zip(row.pairs, row.links)) == links and row.pairs == sorted(links)


def test_large_groups_pair_distinct_ids(monkeypatch):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 5, 60), rng.integers(0, 4, 50)
    stops_a, stops_b, owner = np.array([30, 31, 60]), np.array([20, 25, 50]), np.array([0, 0, 1])
    whole = crosstoken.linked_pairs(a, b, stops_a, stops_b, owner, 10)
    monkeypatch.setattr(crosstoken, "LARGE_GROUP", 10)
    assert all(np.array_equal(x, y) for x, y in zip(whole, crosstoken.linked_pairs(a, b, stops_a, stops_b, owner, 10)))
    assert whole[2].sum() == 30 * 20 + 1 * 5 + 29 * 25


def test_galloping_finds_what_plain_search_finds():
    rng = np.random.default_rng(2)
    for _ in range(300):
        ends = np.unique(rng.integers(0, 3000, rng.integers(1, 400)))
        wanted = np.unique(rng.integers(0, 3200, rng.integers(0, 60)))
        assert np.array_equal(crosstoken.gallop(wanted, ends), np.searchsorted(ends, wanted))
    assert len(crosstoken.gallop(np.zeros(0, np.int64), ends)) == 0


def test_empty_table(spark):
    assert crosstoken.alignment_counts(frame(spark, []), *PATHS).count() == 0


def test_spelling_tells_which_texts_the_tokens_spell():
    tokens = [b"a", b"", b"bc", b" \xc3", b"\xa9"]
    spelling = crosstoken.Spelling(tokens)
    rng = random.Random(6)
    for _ in range(100):
        ids = [np.array([rng.randrange(5) for _ in range(rng.randrange(6))], np.int64) for _ in range(rng.randrange(8))]
        wanted = [b"".join(tokens[i] for i in one) for one in ids]
        wrong = [rng.random() < 0.5 for _ in ids]
        wanted = [rng.choice([w + b"a", w[:-1] + b"?", w[1:]]) if bad and w else w for w, bad in zip(wanted, wrong)]
        right = [b"".join(tokens[i] for i in one) == w for one, w in zip(ids, wanted)]
        assert spelling.spells(ids, wanted).tolist() == right


def test_encoding_looks_at_new_stretches_only(libraries):
    """The work of a batch must not grow with the number of stretches that the worker has met."""

    class Met(str):
        def __hash__(self):
            nonlocal read
            read += 1
            return super().__hash__()

    side, read = crosstoken.ByteLevel(PATHS[0]), 0
    side.known = {Met(f"met {k}"): b"" for k in range(1000)}
    texts, read = [prose(random.Random(7), 40), "x", prose(random.Random(8), 40)], 0
    found = side.encode(texts)
    assert read == 0
    assert [x.tolist() for x in found] == [libraries[0].encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_links_of_no_group():
    none = np.zeros(0, np.int64)
    assert [len(x) for x in crosstoken.linked_pairs(none, none, none, none, none, 10)] == [0, 0, 0]
