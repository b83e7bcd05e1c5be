"""Benchmark decontamination by pigeonhole edit matching.

A test item may occur in a document with up to E edits, E being a share of its length. Cut into E + 1 pieces, at least
one piece then occurs unchanged. An Aho-Corasick automaton finds the pieces in the whole text of every document, and
Myers' bit-parallel algorithm gives the smallest edit distance of the item to any passage around the hit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from graticule.llm.common import free_name, mapped, small_batches

ERROR_SHARE = 0.05  # edits allowed, as a share of an item's characters
SHORTEST_PIECE = 8  # items whose pieces would be shorter allow fewer edits instead
BLOCK_CHARACTERS = 4_000_000  # of items that a task searches for in one pass


def normalised(text: str) -> str:
    """Lower-cased, with every run of white space as one space."""
    return " ".join(text.lower().split())


def budget(length: int, share: float = ERROR_SHARE) -> int:
    return max(0, min(int(length * share), length // SHORTEST_PIECE - 1))


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """The item in ``errors`` + 1 parts of about equal length, with their places."""
    edges = [k * len(item) // (errors + 1) for k in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:])]


def closest(item: str, window: str, masks: dict[str, int] | None = None) -> tuple[int, int]:
    """Smallest edit distance of the item to a passage of the window, and where the first such passage ends.

    One bit per character of the item; a step of the window updates all of them at once.
    """
    m = len(item)
    masks = match_masks(item) if masks is None else masks
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance = full, 0, m
    best, end = m, 0
    for i, c in enumerate(window):
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(horizontal | plus) & full, plus & horizontal
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        up, down = up << 1 & full, down << 1 & full  # a passage may begin anywhere: the first row stays 0
        plus, minus = down | ~(vertical | up) & full, up & vertical
        if distance < best:
            best, end = distance, i + 1
    return best, end


def match_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Searcher:
    """An automaton over the pieces of a block of items."""

    def __init__(self, items: list[tuple[object, str]], share: float) -> None:
        self.items = [(key, text, budget(len(text), share), match_masks(text)) for key, text in items]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, errors, _) in enumerate(self.items):
            for place, piece in pieces(text, errors):
                where.setdefault(piece, []).append((n, place))
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def search(self, text: str) -> Iterator[tuple[object, int, int, int]]:
        """Items found in a normalised text: key, distance, edits allowed, and the place where the closest passage ends."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for stop, (length, uses) in self.automaton.iter(text):
            for n, place in uses:
                _, item, errors, _ = self.items[n]
                start = stop + 1 - length - place
                spans.setdefault(n, []).append((max(0, start - errors), start + len(item) + errors))
        for n, around in spans.items():
            key, item, errors, masks = self.items[n]
            best, end = errors + 1, 0
            for low, high in merged(around, len(item)):
                distance, stop = closest(item, text[low:high], masks)
                if distance < best:
                    best, end = distance, low + stop
                if best == 0:
                    break
            if best <= errors:
                yield key, best, errors, end


def merged(spans: list[tuple[int, int]], reach: int) -> Iterator[tuple[int, int]]:
    """Windows that overlap by half an item or more as one, so that pieces of one passage are checked once."""
    low, high = None, 0
    for a, b in sorted(spans):
        if low is not None and a <= high - reach // 2:
            high = max(high, b)
            continue
        if low is not None:
            yield low, high
        low, high = a, b
    if low is not None:
        yield low, high


def blocks(items: list[tuple[object, str]], most: int = BLOCK_CHARACTERS) -> Iterator[list[tuple[object, str]]]:
    block, held = [], 0
    for key, text in items:
        if block and held + len(text) > most:
            yield block
            block, held = [], 0
        block.append((key, text))
        held += len(text)
    if block:
        yield block


def matches(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", share: float = ERROR_SHARE, block: int = BLOCK_CHARACTERS,
) -> DataFrame:
    """One row per document row and test item that occurs in it: the identifiers, ``distance``, ``allowed`` edits and
    ``end``, the place in the normalised text after the closest passage (the first of the closest).

    Texts are lower-cased and runs of white space become one space. Missing or empty items and texts match nothing;
    repeated items are searched once per identifier, repeated documents give repeated rows; an empty table on either
    side gives an empty result. Other columns are ignored. The benchmark is the stated query set: it is read by the
    driver and sent in blocks of at most ``block`` characters (one longer item is a block by itself), and every block
    is one pass over all documents. Nothing is shuffled.
    """
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    item = benchmark.select(F.col(item_id).alias("item"), F.col(item_text).cast("string").alias("t"))
    kinds = chosen.schema["id"].dataType.simpleString(), item.schema["item"].dataType.simpleString()
    schema = f"id {kinds[0]}, item {kinds[1]}, distance int, allowed int, end long"
    listed = [(r["item"], normalised(r["t"])) for r in item.where("t is not null").distinct().orderBy("item", "t").toLocalIterator()]
    listed = [(k, t) for k, t in listed if t]
    result = chosen.sparkSession.createDataFrame([], schema)
    for part in blocks(listed, block):
        sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(part))
        result = result.unionByName(mapped(chosen, searching(sent, share, item.schema["item"].dataType), schema))
    return result.select(F.col("id").alias(doc_id), F.col("item").alias(item_id), "distance", "allowed", "end")


def searching(sent, share: float, kind):
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(pickle.loads(sent.value), share)
        for batch in small_batches(batches, "text"):
            rows = [(i, *hit) for i, t in enumerate(batch.column("text").to_pylist()) if t for hit in searcher.search(normalised(t))]
            if rows:
                at, keys, distances, limits, ends = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(pa.array(at)), pa.array(keys, arrow), pa.array(distances, pa.int32()), pa.array(limits, pa.int32()), pa.array(ends, pa.int64())],
                    ["id", "item", "distance", "allowed", "end"],
                )

    return run


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no test item occurs, with all their columns. All rows of an identifier go together;
    rows without an identifier are judged with each other. Columns may have any names."""
    mark = free_name(docs, "found")
    found = matches(docs, benchmark, doc_id, text).select(F.col(doc_id).alias(mark)).distinct()
    return docs.join(found, F.col(doc_id).eqNullSafe(F.col(mark)), "left_anti")
