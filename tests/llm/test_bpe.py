"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from texts import awkward, frame

from graticule.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def hard_texts():
    rng = random.Random(1)
    alphabets = ["ab", "aàé", "abc ", "th", "0123", "é", "日本", "=-", "x", " \n\t a", "a \x1c\x85 b", "I'll we've ", "🙂a"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(0, 300))) for a in alphabets for _ in range(60)]
    return [*texts, "a" * 20000, "ab" * 9000, "=" * 10001, "thth" * 5000, "", "der" * 3000 + "ing" * 3000, " lead", "trail ", "a  b", "\n\n a"]


def test_ids_equal_the_library(library):
    words, cut = bpe.vocabulary(PATH), regex.compile(public_tokenizers.PATTERN)
    texts = hard_texts()
    for text, ids in zip(texts, bpe.encode_texts(texts, words, cut, {})):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), text[:50]
        assert bpe.decode_ids(ids, words) == text.encode()


def test_queue_gives_ranks_in_order_and_skips_nothing():
    rng = random.Random(2)
    queue, waiting = bpe.RankQueue(), {}
    for _ in range(3000):
        if waiting and rng.random() < 0.4:
            rank, positions = queue.pop()
            assert rank == min(waiting) and positions.tolist() == sorted(waiting.pop(rank))
        else:
            rank, position = rng.choice([rng.randrange(64**3), rng.randrange(50)]), rng.randrange(10**6)
            waiting.setdefault(rank, []).append(position)
            queue.push(rank, np.array([position]))
    while popped := queue.pop():
        assert popped[0] == min(waiting) and popped[1].tolist() == sorted(waiting.pop(popped[0]))
    assert not waiting


def test_whole_table(spark, library):
    pairs = awkward(random.Random(5))
    rows = bpe.encode(frame(spark, pairs), PATH, public_tokenizers.PATTERN).collect()
    assert len(rows) == len(pairs)
    wanted = []
    for i, t in pairs:
        ids = np.array(library.encode_ordinary(t or ""), "<u4").tobytes()
        wanted.append((i or -1, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == sorted(wanted)
    assert all(bytes(r.decoded) == bpe.decode_ids(bytes(r.ids), bpe.vocabulary(PATH)) for r in rows)
    assert bpe.encode(frame(spark, []), PATH, public_tokenizers.PATTERN).count() == 0
