"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pre-tokens of a batch that are not yet known lie in one linked list of symbols. A bucket per merge rank holds the
positions whose pair has that rank; three levels of 64-bit words tell which buckets hold anything, so that the next
rank is found by taking the lowest set bit three times. A position whose pair has changed since it was queued is stale
and skipped. Positions of one rank are merged together, and no pair crosses a pre-token, so each pre-token sees its
merges in the order of ranks, leftmost first, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import kept_by_worker, mapped, small_batches

KNOWN_STRETCHES = 400_000
LONG_STRETCH = 100
SCHEMA = "n_tokens long, ids binary, ids_sha256 string, decoded binary, decoded_sha256 string"


class RankQueue:
    """Buckets by rank under three levels of bitmaps: room for 64 * 64 * 64 ranks."""

    def __init__(self) -> None:
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.top, self.middle, self.low = 0, [0] * 64, [0] * 4096

    def push(self, rank: int, positions: np.ndarray) -> None:
        held = self.buckets.get(rank)
        if held is None:
            self.buckets[rank] = [positions]
            word, part = rank >> 6, rank >> 12
            self.low[word] |= 1 << (rank & 63)
            self.middle[part] |= 1 << (word & 63)
            self.top |= 1 << part
        else:
            held.append(positions)

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        edges = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
        for rank, start, stop in zip(ranks[edges[:-1]].tolist(), edges, edges[1:]):
            self.push(rank, positions[start:stop])

    def pop(self) -> tuple[int, np.ndarray] | None:
        """The lowest rank and its positions, ascending."""
        if not self.top:
            return None
        part = (self.top & -self.top).bit_length() - 1
        word = part << 6 | (self.middle[part] & -self.middle[part]).bit_length() - 1
        rank = word << 6 | (self.low[word] & -self.low[word]).bit_length() - 1
        self.low[word] &= self.low[word] - 1
        if not self.low[word]:
            self.middle[part] &= self.middle[part] - 1
            if not self.middle[part]:
                self.top &= self.top - 1
        held = self.buckets.pop(rank)
        positions = np.sort(held[0] if len(held) == 1 else np.concatenate(held))
        return rank, positions


class Vocabulary:
    """Tokens by rank, and the rank that each pair of adjacent tokens makes."""

    NONE = np.iinfo(np.int32).max

    def __init__(self, path: str) -> None:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        if max(ranks.values()) >= 64**3:
            raise ValueError("the rank queue has room for 262,144 ranks")
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        made = [
            (ranks[t[:i]] << 20 | ranks[t[i:]], rank)
            for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks
        ]
        made.sort()
        # Tokens that make a pair of a lower rank than their own with some neighbour.
        self.lowering = {t for k, r in made for t in (k >> 20, k & 0xFFFFF) if r < t}
        self.pairs = np.array([k for k, _ in made] + [1 << 62], np.int64)
        self.makes = np.array([r for _, r in made] + [self.NONE], np.int32)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.makes[at], self.NONE)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit words. Each must be non-empty."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        owner = np.repeat(np.arange(len(pieces), dtype=np.int64), sizes)
        symbol = self.bytes[data]
        after, before = np.arange(1, n + 1, dtype=np.int64), np.arange(-1, n - 1, dtype=np.int64)
        ends = np.cumsum(sizes)
        after[ends - 1] = -1
        before[ends - sizes] = -1
        alive = np.ones(n, bool)
        queued = np.full(n, self.NONE, np.int32)  # the rank of the pair that starts at a position
        queue = RankQueue()

        def queue_pairs(at: np.ndarray) -> None:
            right = after[at]
            ranks = np.full(len(at), self.NONE, np.int32)
            paired = right >= 0
            ranks[paired] = self.pair_ranks(symbol[at[paired]], symbol[right[paired]])
            queued[at] = ranks
            live = ranks != self.NONE
            queue.push_all(ranks[live], at[live])

        queue_pairs(np.arange(n))
        while popped := queue.pop():
            rank, at = popped
            fresh = alive[at] & (queued[at] == rank)  # the rest is stale
            fresh[1:] &= at[1:] != at[:-1]
            at = at[fresh]
            if not len(at):
                continue
            if len(at) > 1:  # of a stretch of overlapping pairs, the first, the third, and so on
                chained = after[at[:-1]] == at[1:]
                if chained.any():
                    chained = np.concatenate([[False], chained])
                    starts = np.flatnonzero(~chained)
                    place = np.arange(len(at)) - starts[np.cumsum(~chained) - 1]
                    at = at[place % 2 == 0]
            right = after[at]
            beyond = after[right]
            left = before[at]
            joined = np.zeros(len(at), bool)
            joined[1:] = right[:-1] == left[1:]
            # A merge may make a pair of a lower rank, which comes first: later positions of that pre-token wait.
            if len(at) > 1 and rank in self.lowering:
                lefts = np.where(joined, rank, np.where(left >= 0, symbol[left], 0))
                lower = (left >= 0) & (self.pair_ranks(lefts, np.full(len(at), rank)) < rank)
                lower |= (beyond >= 0) & (self.pair_ranks(np.full(len(at), rank), symbol[beyond]) < rank)
                if lower.any():
                    whose = owner[at]
                    first = np.flatnonzero(lower)
                    names, where = np.unique(whose[first], return_index=True)
                    limit = np.full(len(at), len(at))
                    spot = np.searchsorted(names, whose)
                    hit = (spot < len(names)) & (names[np.minimum(spot, len(names) - 1)] == whose)
                    limit[hit] = first[where][spot[hit]]
                    wait = np.arange(len(at)) > limit
                    if wait.any():
                        queue.push(rank, at[wait])
                        at, right, beyond, left, joined = (x[~wait] for x in (at, right, beyond, left, joined))
            symbol[at] = rank
            alive[right] = False
            after[at] = beyond
            linked = beyond >= 0
            before[beyond[linked]] = at[linked]
            queue_pairs(np.concatenate([at, left[(left >= 0) & ~joined]]))
        left_over = np.flatnonzero(alive)
        stops = (4 * np.cumsum(np.bincount(owner[left_over], minlength=len(pieces)))).tolist()
        coded = symbol[left_over].astype("<u4").tobytes()
        return [coded[a:b] for a, b in zip([0, *stops], stops)]


@kept_by_worker(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@kept_by_worker(maxsize=2)
def known_stretches(path: str, pattern: str) -> dict[str, bytes]:
    """Kept by a worker from task to task."""
    return {}


def stretches(text: str) -> list[str]:
    """Cuts a text before each space, or not at all. No pre-token holds a space behind another character, unless white
    space stands beside the space, so the pattern finds the same pre-tokens in the parts."""
    if len(text.split()) != text.count(" ") + text.count("\n") + text.count("\t") + 1:
        return [text]  # some white space stands beside other white space or at an end, or is of a rarer kind
    first, *rest = text.split(" ")
    return [first, *[f" {r}" for r in rest]]


def encode_texts(texts: list[str], words: Vocabulary, pattern: regex.Pattern, known: dict[str, bytes]) -> Iterator[bytes]:
    """The ids of each text, as little-endian 32-bit words. ``known`` keeps short stretches of text between batches."""
    split = [stretches(t) for t in texts]
    if len(known) > KNOWN_STRETCHES:
        known.clear()
    new = list({s for parts in split for s in parts} - known.keys())
    if new:
        # A space and letters are one pre-token.
        pieces = [[s.encode()] if s[1:].isalpha() and s[0] == " " else list(map(str.encode, pattern.findall(s))) for s in new]
        todo = list({p for ps in pieces for p in ps if p not in words.ranks})
        ids = dict(zip(todo, words.encode(todo))) if todo else {}
        for s, ps in zip(new, pieces):
            known[s] = b"".join([ids[p] if p in ids else words.ranks[p].to_bytes(4, "little") for p in ps])
    for parts in split:
        yield b"".join(map(known.__getitem__, parts))
    for s in new:
        if len(s) > LONG_STRETCH:
            del known[s]


def decode_ids(ids: bytes, words: Vocabulary) -> bytes:
    return b"".join(map(words.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", digests_only: bool = False) -> DataFrame:
    """Encodes each whole text and decodes the ids again: the identifier, ``n_tokens``, ``ids`` (little-endian unsigned
    32-bit words), ``decoded`` and the lowercase hexadecimal SHA-256 of both; ``digests_only`` leaves out the two.

    A missing or empty text has no ids. Rows are independent: repeated rows give repeated results, an empty table an
    empty one, and other columns are ignored. Nothing is shuffled. A task holds one batch of texts of 4 MB, or one
    longer text, and up to 400,000 words that its worker has met.
    """
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests_only else SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, cut, known = vocabulary(path), regex.compile(pattern), known_stretches(path, pattern)
        for batch in small_batches(batches, "text"):
            ids = list(encode_texts([t or "" for t in batch.column("text").to_pylist()], words, cut, known))
            decoded = [decode_ids(i, words) for i in ids]
            held = [
                batch.column("id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array(decoded, pa.binary()),
                pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
            ]
            names = ["id", "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays(held, names).select(
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"] if digests_only else names
            )

    return mapped(chosen, run, schema).withColumnRenamed("id", doc_id)


