"""Rows that every text operator must bear: missing values, ties, repeats, a long text and clashing column names."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, doc string, key string, score string,"
    " lang_pred string, kept string, bucket int, run int, head int, norm string, cut int, bands int, content int, `class` int"
)
EMPTY_TAIL = (None,) * 14


def prose(rng: random.Random, words: int) -> str:
    stems = [a + b for a in ("tha", "whe", "ing", "ou", "re", "sti", "bla") for b in ("nd", "er", "ly", "tion", "as", "o")]
    return " ".join("".join(rng.choice(stems) for _ in range(rng.randint(1, 3))) for _ in range(words))


def frame(spark, pairs, **columns):
    """Documents from (doc_id, text) pairs, with columns whose names the operators use themselves."""
    rows = [(i, t, columns.get("lang", "en"), "s", len(t) if t else None, *EMPTY_TAIL) for i, t in pairs]
    return spark.createDataFrame(rows, SCHEMA)


def awkward(rng: random.Random) -> list[tuple[int | None, str | None]]:
    base = prose(rng, 60)
    return [
        (1, None), (2, ""), (3, "   \n "), (4, "x"), (5, base), (6, base), (6, base), (7, base.upper()), (None, base), (None, None),
        (8, "ÄÖ äö Ünï"), (9, "äö äö ünï"), (10, prose(rng, 20000)), (11, "a" * 3000), (12, "\x00 \x1f odd"), (13, "日本語 テキスト" * 40),
        (14, prose(rng, 3)), (14, prose(rng, 4)),
    ]
