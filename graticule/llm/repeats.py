"""Long repeats across a corpus by run-length index.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts elsewhere. Each such string holds an anchor: the
``GRAM`` bytes with the smallest hash, the first of equal ones. Equal strings have equal anchors at equal places, so all
starts with the same anchor are one piece of text, and pieces meet those of the same anchor only. Anchors that occur once
end there, and equal pieces need no search. The others are indexed in groups: a Burrows-Wheeler transform in runs, with
suffix-array samples at the run ends, from which matching statistics are streamed; starts that match ``LENGTH`` bytes
elsewhere are marked. Groups too large for one task are split by longer and longer parts of the strings instead.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import mapped, scratch_path, small_batches, stored, text_of

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1  # places of an anchor in a string
LARGEST_GROUP = 1000  # different pieces that are indexed together
INDEX_BYTES = 2 << 20  # groups are indexed together up to this size
CHUNK = 8 << 20  # bytes of a long text that are hashed at once; below 2 ** 24
PIECE = "doc long, at long, far int, near int, key long, content long"
ODD = [int(x) | 1 for x in np.random.default_rng(17).integers(0, 2**63, 6)]
BYTES = np.random.default_rng(19).integers(0, 2**64 - 1, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each place; doubling the length step by step."""
    h, size, step = BYTES[data], 1, 0
    while size < GRAM:
        h = h[:-size] * np.uint64(ODD[step]) + h[size:]
        size, step = 2 * size, step + 1
    h ^= h >> np.uint64(32)
    h *= np.uint64(ODD[5])
    h ^= h >> np.uint64(29)
    return h


def anchors(grams: np.ndarray) -> np.ndarray:
    """For each place, where the smallest hash among the next ``SPAN`` places is, the first of equal ones."""
    low = (grams & np.uint64(~0xFFFFFF & 2**64 - 1)) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= SPAN:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = SPAN - size
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return (low & np.uint64(0xFFFFFF)).astype(np.int64)


def pieces_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """The pieces of each text of at least ``LENGTH`` bytes: text number, first start, distance of the anchor from the
    first and from the last start, anchor hash, content hash. A piece's bytes end ``LENGTH`` after its last start."""
    group, held = [], 0
    for i, text in enumerate(texts):
        for base in range(0, max(1, len(text) - LENGTH + 1), CHUNK):
            part = text[base : base + CHUNK + LENGTH - 1]
            if len(part) >= LENGTH:
                group.append((i, base, part))
                held += len(part)
            if held >= 1 << 20:
                yield pieces_of_group(group)
                group, held = [], 0
    if group:
        yield pieces_of_group(group)


def pieces_of_group(group: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    whole = b"".join(part for _, _, part in group)
    data = np.frombuffer(whole, np.uint8)
    grams = gram_hashes(data)
    anchor = anchors(grams)
    sizes = np.array([len(part) for _, _, part in group])
    begins = np.cumsum(sizes) - sizes
    fits = np.zeros(len(anchor) + 1, np.int8)  # starts whose string stays in its text
    fits[begins] += 1
    fits[begins + sizes - LENGTH + 1] -= 1
    fits = np.cumsum(fits[:-1]).astype(bool)
    first = fits.copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~fits[:-1]
    last = fits.copy()
    last[:-1] &= (anchor[1:] != anchor[:-1]) | ~fits[1:]
    lows, highs = np.flatnonzero(first), np.flatnonzero(last)
    which = np.searchsorted(begins, lows, side="right") - 1
    view = memoryview(whole)
    digest = xxhash.xxh3_64_intdigest
    content = np.fromiter((digest(view[a:b]) for a, b in zip(lows.tolist(), (highs + LENGTH).tolist())), np.uint64, len(lows))
    place = anchor[lows]
    return (
        np.array([i for i, _, _ in group])[which],
        lows - begins[which] + np.array([base for _, base, _ in group])[which],
        (place - lows).astype(np.int32), (place - highs).astype(np.int32),
        grams[place].view(np.int64), content.view(np.int64),
    )


class RunLengthIndex:
    """A Burrows-Wheeler transform of texts in runs, with suffix-array samples at both ends of every run.

    Texts end in separators that differ from each other and sort below all bytes. For every place of the texts the
    neighbours in suffix order follow from the samples alone: between two samples, a neighbour and what the place shares
    with it move along together. So the statistics stream over the text from its end, in one pass.
    """

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(sizes + 1) - 1  # where the separators stand
        self.begins = self.ends - sizes
        symbols = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8).astype(np.int64) + 1
        symbols[self.ends] = 0
        self.symbols = symbols
        order = self.suffix_order()
        n = len(order)
        row = np.empty(n, np.int64)
        row[order] = np.arange(n)
        before = symbols[order - 1]  # the transform; the last symbol of all stands before the first
        before[before == 0] = -order[before == 0] - 1  # separators differ
        head = np.concatenate([[True], before[1:] != before[:-1]])
        self.runs = int(head.sum())
        tail = np.concatenate([head[1:], [True]])
        self.up = self.sampled(order[head], order, row, -1)
        self.down = self.sampled(order[tail], order, row, 1)

    def suffix_order(self) -> np.ndarray:
        """Suffixes in order, by doubling; only suffixes that still tie are sorted again."""
        s, n = self.symbols, len(self.symbols)
        packed, clear = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(7):  # seven symbols of nine bits; a separator ends the text
            here = np.zeros(n, np.int64)
            here[: max(0, n - k)] = s[k:]
            clear &= here > 0
            packed = packed << 9 | np.where(clear, here, 0)
        order = np.argsort(packed, kind="stable")
        tied = (packed[order[1:]] == packed[order[:-1]]) & clear[order[1:]] & clear[order[:-1]]
        rank = np.empty(n, np.int64)
        depth = 7
        first = np.concatenate([[True], ~tied])
        rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))  # ties share the first row of theirs
        rows = np.flatnonzero(np.concatenate([tied, [False]]) | ~first)
        while len(rows):
            places = order[rows]
            ahead = rank[places + depth]  # a tie has no separator within its depth
            key = rank[places] * n + ahead
            sorting = np.argsort(key, kind="stable")
            key, places = key[sorting], places[sorting]
            order[rows] = places
            new = np.concatenate([[True], key[1:] != key[:-1]])
            rank[places] = np.maximum.accumulate(np.where(new, rows, 0))
            single = new & np.concatenate([new[1:], [True]])
            rows = rows[~single]
            depth *= 2
        return order

    def sampled(self, ends: np.ndarray, order: np.ndarray, row: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the places before the run ends, in text order: the neighbour on one side, and how much both share."""
        places = np.sort((ends - 1) % len(order))
        beside = row[places] + side
        there = (beside >= 0) & (beside < len(order))
        other = np.where(there, order[np.clip(beside, 0, len(order) - 1)], -1)
        return places, other, self.shared(places, other)

    def shared(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Length of the common part of two suffixes, up to ``LENGTH``; separators differ."""
        n, s = len(self.symbols), self.symbols
        length = np.zeros(len(left), np.int64)
        open_ = np.flatnonzero(right >= 0)
        reach = 0
        packed = np.zeros(n + 8, np.uint64)
        bytes_ = np.concatenate([(s - 1) & 0xFF, np.zeros(15, np.int64)]).astype(np.uint64)
        for k in range(8):
            packed |= bytes_[k : k + n + 8] << np.uint64(8 * k)
        stop = np.repeat(self.ends, np.diff(self.ends, prepend=-1))
        room = np.minimum(stop[left] - left, stop[right] - right)
        while len(open_) and reach < LENGTH:
            differ = packed[left[open_] + reach] ^ packed[right[open_] + reach]
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(lowest, np.uint64(1)).astype(np.float64)).astype(np.int64) // 8)
            length[open_] = np.minimum(reach + same, room[open_])
            reach += 8
            open_ = open_[(same == 8) & (room[open_] > reach)]
        return np.minimum(length, LENGTH)

    def matching_statistics(self) -> np.ndarray:
        """For every place, the length of its longest match elsewhere, up to ``LENGTH``."""
        n = len(self.symbols)
        best = np.zeros(n, np.int64)
        for places, _, shared in (self.up, self.down):
            # What a sample shares counts back from its place to the one before.
            reach = np.repeat(shared + places, np.diff(places, prepend=-1))
            best[: len(reach)] = np.maximum(best[: len(reach)], reach)
        stop = np.repeat(self.ends, np.diff(self.ends, prepend=-1))
        return np.clip(np.minimum(best, stop) - np.arange(n), 0, LENGTH)


def repeated_starts(texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each text, the stretches (first, last) of starts whose ``LENGTH`` bytes also start elsewhere in the texts."""
    index = RunLengthIndex(texts)
    long = index.matching_statistics() >= LENGTH
    padded = np.concatenate([[False], long, [False]])
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # separators part the texts
        k = int(np.searchsorted(index.ends, a))
        found[k].append((a - int(index.begins[k]), b - 1 - int(index.begins[k])))
    return found


def cut_pieces(rows: DataFrame) -> DataFrame:
    """The pieces of all texts of rows (doc, text); see ``pieces_of``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            docs = batch.column("doc").to_numpy(zero_copy_only=False)
            for which, *columns in pieces_of([t.encode() for t in batch.column("text").to_pylist()]):
                yield pa.RecordBatch.from_arrays([pa.array(docs[which]), *map(pa.array, columns)], ["doc", "at", "far", "near", "key", "content"])

    return mapped(rows, run, PIECE)


def copy_bytes(rows: DataFrame) -> DataFrame:
    """The bytes of the wanted pieces of rows (doc, text, wanted)."""
    wanted = rows.select("doc", "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 1 << 20):
            found = []
            for doc, text, pieces in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), batch.column("wanted").to_pylist()):
                data = text.encode()
                for p in pieces:
                    found.append((doc, p["at"], p["far"], p["near"], p["key"], p["known"], p["different"], data[p["at"] : p["at"] + p["far"] - p["near"] + LENGTH]))
            yield as_pieces(found)

    return mapped(wanted, run, f"{PIECE.replace(', content long', '')}, known boolean, different long, bytes binary")


KINDS = {"doc": pa.int64(), "at": pa.int64(), "far": pa.int32(), "near": pa.int32(), "key": pa.int64(), "known": pa.bool_(), "different": pa.int64(), "bytes": pa.binary()}


def as_pieces(found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found) if found else [[]] * len(KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS.values())], list(KINDS))


def split_pieces(pieces: DataFrame, size: int) -> DataFrame:
    """Cuts pieces at multiples of ``size`` in the distance of the anchor from the start. A part's key is a hash of its
    piece's key, its number, and all bytes that the strings of this number share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "bytes", 1 << 20):
            found, contents = [], []
            for p in batch.to_pylist():
                for number in range(p["near"] // size, p["far"] // size + 1):
                    far, near = min(p["far"], (number + 1) * size - 1), max(p["near"], number * size)
                    anchor = p["far"]  # where the anchor stands in the bytes
                    part = p["bytes"][anchor - far : anchor - near + LENGTH]
                    low, high = min((number + 1) * size - 1, SPAN - 1), number * size
                    core = p["bytes"][anchor - high : anchor - low + LENGTH]
                    key = xxhash.xxh3_64_intdigest(core, seed=xxhash.xxh64_intdigest(f"{p['key']} {number}")) - 2**63
                    found.append((p["doc"], p["at"] + p["far"] - far, far, near, key, p["known"], 0, part))
                    contents.append(xxhash.xxh3_64_intdigest(part) - 2**63)
            parts = as_pieces(found)
            yield pa.RecordBatch.from_arrays([*parts.columns, pa.array(contents, pa.int64())], [*KINDS, "content"])

    return mapped(pieces, run, f"{PIECE.replace(', content long', '')}, known boolean, different long, bytes binary, content long")


def index_groups(pieces: DataFrame) -> DataFrame:
    """Marks (doc, first, last) of the starts in pieces not yet known that a group's index finds elsewhere."""
    parts = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pieces.repartition(parts, "key").sortWithinPartitions("key").select("key", "doc", "at", "known", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for batch in batches:
            for p in batch.to_pylist():
                if held and size > INDEX_BYTES and p["key"] != held[-1]["key"]:
                    yield marks_of(held)
                    held, size = [], 0
                held.append(p)
                size += len(p["bytes"])
        if held:
            yield marks_of(held)

    return mapped(dealt, run, "doc long, first long, last long")


def marks_of(pieces: list[dict]) -> pa.RecordBatch:
    found = repeated_starts([p["bytes"] for p in pieces])
    rows = [(p["doc"], p["at"] + a, p["at"] + b) for p, stretches in zip(pieces, found) if not p["known"] for a, b in stretches]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 3)], ["doc", "first", "last"])


def compared(pieces: DataFrame, carried: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of pieces whose key occurs more than once: marks for those that are equal to another, and one of each kind where a
    key has several, with ``known``, whether its starts are repeated anyway, and ``different``, how many kinds there are.
    Counts combine before the shuffle."""
    kinds = stored(
        pieces.groupBy("key", "content").agg(
            F.count("*").alias("rows"), F.max("known").alias("marked"), F.min(F.struct("doc", "at", "far", "near", *carried)).alias("one")
        ),
        "repeats-kinds",
    )
    equal = kinds.where("rows > 1").select("key", "content")
    marks = pieces.where("not known").join(equal, ["key", "content"]).select("doc", F.col("at").alias("first"), (F.col("at") + F.col("far") - F.col("near")).alias("last"))
    several = kinds.groupBy("key").agg(F.count("*").alias("different")).where("different > 1")
    left = kinds.join(several, "key").select("one.*", "key", ((F.col("rows") > 1) | F.col("marked")).alias("known"), "different")
    return marks, left


def marks_in_large(pieces: DataFrame) -> DataFrame:
    """Marks in groups of more than ``LARGEST_GROUP`` kinds. Longer and longer parts of the strings tell them apart, down
    to whole strings; a part that occurs once is dropped, and groups that have become small enough are indexed."""
    size, found = 256, None
    while size > 1:
        size //= 2
        parts = stored(split_pieces(pieces, size), "repeats-parts")
        often = parts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        marks, left = compared(parts.join(often, "key"), ["bytes"])
        left = stored(left, "repeats-left")
        marks = marks.unionByName(index_groups(left.where(F.col("different") <= LARGEST_GROUP)))
        found = marks if found is None else found.unionByName(marks)
        pieces = left.where(F.col("different") > LARGEST_GROUP)
        if pieces.isEmpty():
            break
    return found


def cut_out(rows: DataFrame, with_text: bool) -> DataFrame:
    """Removes the marked bytes of rows (id, n, sha, text, marks); rows without marks keep what they have."""
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            removed, spans, digests, texts = [], [], [], []
            for sha, text, marks in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "marks"))):
                merged: list[list[int]] = []
                for a, b in sorted((m["first"], m["last"] + LENGTH) for m in marks or ()):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], b)
                    else:
                        merged.append([a, b])
                data = text.encode() if text else b""
                edges = [0, *(x for span in merged for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])) if merged else data
                removed.append(sum(b - a for a, b in merged))
                spans.append(len(merged))
                digests.append(hashlib.sha256(kept).hexdigest() if merged else sha)
                texts.append(kept)
            columns = [batch.column("id"), batch.column("n"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())]
            names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns, names = [*columns, pa.array(texts, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return mapped(rows, run, schema)


def remove(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """One row per document: the identifier, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal removed runs), the SHA-256
    ``kept_sha256`` of the remaining bytes, and with ``with_text`` these bytes.

    Texts are UTF-8 bytes, a missing one is empty; no string crosses documents. Every string is judged on the input, so
    all copies go, repeated rows and overlapping copies within a text included. Texts below ``LENGTH`` bytes stay as they
    are. Rows are told apart by a 64-bit hash of identifier and text, so identifiers may be missing or repeated. Other
    columns are ignored, and an empty table gives an empty result. Several jobs run at once; their intermediate tables
    hold hashes, and the bytes of pieces that share an anchor but differ.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), text_of(text).alias("text")).withColumn("doc", F.xxhash64("id", "text"))
    pieces = cut_pieces(rows.where(F.octet_length("text") >= LENGTH).select("doc", "text"))
    often = stored(pieces.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeats-keys")
    shared = stored(pieces.join(often, "key").withColumn("known", F.lit(False)), "repeats-pieces")
    marks, left = compared(shared, [])
    want = left.groupBy("doc").agg(F.collect_list(F.struct("at", "far", "near", "key", "known", "different")).alias("wanted"))
    touched = shared.select("doc").distinct().join(want, "doc", "left").withColumn("touched", F.lit(True))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = rows.join(touched, "doc", "left").select(
        "doc", "id", F.octet_length("text").cast("long").alias("n"), F.sha2("text", 256).alias("sha"), F.when(F.col("touched"), F.col("text")).alias("text"), "wanted"
    )
    texts = bucketed(split, "doc", parts)
    unlike = copy_bytes(texts.where("wanted is not null"))
    marks = marks.unionByName(index_groups(unlike.where(F.col("different") <= LARGEST_GROUP)))
    large = unlike.where(F.col("different") > LARGEST_GROUP)
    if not left.where(F.col("different") > LARGEST_GROUP).isEmpty():
        marks = marks.unionByName(marks_in_large(large))
    by_doc = marks.groupBy("doc").agg(F.collect_set(F.struct("first", "last")).alias("marks"))
    return cut_out(texts.drop("wanted").join(by_doc, "doc", "left"), with_text).withColumnRenamed("id", doc_id)


def bucketed(df: DataFrame, key: str, parts: int) -> DataFrame:
    """A stored table in buckets of ``key``, so that joins on it move the other side only."""
    spark = df.sparkSession
    name = f"repeats_{uuid.uuid4().hex}"
    path = scratch_path(spark, "repeats-texts")
    df.repartition(parts, key).write.bucketBy(parts, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved now; the files outlive the name
    spark.sql(f"drop table {name}")
    return table
