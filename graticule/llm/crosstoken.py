"""Alignment of two tokenizations of the same texts, by galloping intersection of their token ends.

The byte offsets where tokens end form an ascending list for each tokenizer. The shorter list drives: each of its ends is
looked for in the longer one by steps that double, then by halving what lies between. Ends that both have cut the text
into groups; the places of a group's borders in both lists are the ranges of tokens that overlap there. Every token of
one side of a group is linked with every token of the other.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graticule.llm.bpe import stretches
from graticule.llm.common import kept_by_worker, mapped, small_batches, stored

BATCH_BYTES = 1 << 20
KNOWN_STRETCHES = 400_000
LONG_STRETCH = 100
LARGE_GROUP = 1 << 12  # links of a group from which its tokens are made distinct before they are paired
FREQUENT_PAIRS = 1 << 20  # pairs of ids, with their counts, that every task may hold


class ByteLevel:
    """A byte-level tokenizer of the `tokenizers` library. A text is encoded with a space before it."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks already take all cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Printable characters of Latin-1 stand for their own byte, the next code points from 256 on for the others.
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in own]
        byte_of = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}
        vocabulary = self.tokenizer.get_vocab()
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.known: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """A text is cut before spaces that stand alone, since no token holds a space behind another character there."""
        split = []
        for text in texts:
            first, *rest = stretches(text)
            split.append([f" {first}", *rest])
        if len(self.known) > KNOWN_STRETCHES:
            self.known.clear()
        new = list(set().union(*split).difference(self.known))
        for s, encoding in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.known[s] = array("I", encoding.ids).tobytes()
        found = [np.frombuffer(b"".join(map(self.known.__getitem__, parts)), np.uintc).astype(np.int64) for parts in split]
        for s in new:
            if len(s) > LONG_STRETCH:
                del self.known[s]
        return found


class Pieces:
    """A sentencepiece model, which adds the space itself."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.tokens = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.tokens.append(bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.int64) for ids in self.model.encode(texts, num_threads=1)]


@kept_by_worker(maxsize=2)
def tokenizers(path_a: str, path_b: str) -> tuple[ByteLevel, Pieces, "Spelling", "Spelling", np.ndarray]:
    """Both tokenizers, the bytes of their tokens, and the texts of ids as they stand in a description of groups: at
    4 * id, + 1 if it ends its side of a group, + 2 if it is of the second tokenizer."""
    a, b = ByteLevel(path_a), Pieces(path_b)
    named = [f"{i}{end}" for i in range(max(len(a.tokens), len(b.tokens))) for end in (",", "|", ",", ";")]
    return a, b, Spelling(a.tokens), Spelling(b.tokens), np.array(named, "S")


class Spelling:
    """The bytes of all tokens of a vocabulary in one array."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.sizes = np.array([len(t) for t in tokens], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def spells(self, ids: list[np.ndarray], wanted: list[bytes]) -> np.ndarray:
        """Which of the texts ``wanted`` the tokens ``ids`` spell."""
        told = np.array([self.sizes[i].sum() for i in ids], np.int64) == np.array([len(w) for w in wanted])
        texts = np.flatnonzero(told)
        if not len(texts):
            return told
        every = np.concatenate([ids[k] for k in texts])
        sizes = self.sizes[every]
        at = np.arange(sizes.sum()) + np.repeat(self.starts[every] - np.cumsum(sizes) + sizes, sizes)
        other = np.flatnonzero(self.data[at] != np.frombuffer(b"".join([wanted[k] for k in texts]), np.uint8))
        stops = np.cumsum([len(wanted[k]) for k in texts])
        told[texts[np.searchsorted(stops, other, side="right")]] = False
        return told


def first_at_least(wanted: np.ndarray, ends: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """For each wanted value the first place at or after ``begin`` whose end is not below it: steps that double until one
    is reached, then halving."""
    low, high, step = begin.copy(), begin.copy(), 1
    behind = np.flatnonzero((high < len(ends)) & (ends[np.minimum(high, len(ends) - 1)] < wanted))
    while len(behind):
        low[behind] = high[behind] + 1
        high[behind] = np.minimum(high[behind] + step, len(ends))
        step *= 2
        reached = (high[behind] >= len(ends)) | (ends[np.minimum(high[behind], len(ends) - 1)] >= wanted[behind])
        behind = behind[~reached]
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_]) // 2
        below = ends[middle] < wanted[open_]
        low[open_[below]] = middle[below] + 1
        high[open_[~below]] = middle[~below]
    return low


def gallop(wanted: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Places in ascending ``ends`` of the first value not below each of the ascending ``wanted``. Every search starts
    where the search of an earlier value ended: of the first, then of every half of the list, of every quarter, and so on,
    so that all searches of one round run at once."""
    places = np.zeros(len(wanted), np.int64)
    if not len(wanted) or not len(ends):
        return places
    places[:1] = first_at_least(wanted[:1], ends, places[:1])
    stride = 1 << (len(wanted) - 1).bit_length()
    while stride := stride >> 1:
        at = np.arange(stride, len(wanted), 2 * stride)
        places[at] = first_at_least(wanted[at], ends, places[at - stride])
    return places


def common_ends(a_ends: np.ndarray, b_ends: np.ndarray, a_sizes: np.ndarray, b_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both lists of the ends that both have. The lists are those of several texts, one behind the other;
    ``a_sizes`` and ``b_sizes`` tell how many ends each text has, and in each text the shorter list drives."""
    shorter = a_sizes <= b_sizes
    mine, theirs = np.flatnonzero(np.repeat(shorter, a_sizes)), np.flatnonzero(np.repeat(~shorter, b_sizes))
    in_b, in_a = gallop(a_ends[mine], b_ends), gallop(b_ends[theirs], a_ends)
    hit_b = b_ends[np.minimum(in_b, len(b_ends) - 1)] == a_ends[mine] if len(b_ends) else np.zeros(0, bool)
    hit_a = a_ends[np.minimum(in_a, len(a_ends) - 1)] == b_ends[theirs] if len(a_ends) else np.zeros(0, bool)
    a_places, b_places = np.concatenate([mine[hit_b], in_a[hit_a]]), np.concatenate([in_b[hit_b], theirs[hit_a]])
    order = np.argsort(a_places)
    return a_places[order], b_places[order]


def linked_pairs(
    a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray, owner: np.ndarray, width: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, links): the distinct pairs ``a * width + b`` of each text and how many links each has. Groups end at
    ``a_stops`` and ``b_stops`` and belong to the texts ``owner``. Large groups pair their distinct ids only. Text and pair
    make one number, which is sorted by itself where every row is one link."""
    a_starts, b_starts = np.concatenate([[0], a_stops[:-1]]), np.concatenate([[0], b_stops[:-1]])
    n_a, n_b = a_stops - a_starts, b_stops - b_starts
    links = n_a * n_b
    small = np.flatnonzero(links <= LARGE_GROUP)
    group = np.repeat(small, links[small])
    place = np.arange(len(group)) - np.repeat(np.cumsum(links[small]) - links[small], links[small])
    over, under = np.divmod(place, n_b[group])
    room = (int(a.max(initial=0)) + 1) * width
    key = owner[group] * room + a[a_starts[group] + over] * width + b[b_starts[group] + under]
    keys, counts = [key], [np.ones(len(key), np.int64)]
    for g in np.flatnonzero(links > LARGE_GROUP).tolist():
        left, of_left = np.unique(a[a_starts[g] : a_stops[g]], return_counts=True)
        right, of_right = np.unique(b[b_starts[g] : b_stops[g]], return_counts=True)
        keys.append((owner[g] * room + left[:, None] * width + right).ravel())
        counts.append((of_left[:, None] * of_right).ravel())
    if len(keys) == 1:
        key.sort()
    else:
        key, count = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    if len(keys) == 1:
        count = np.diff(at, append=len(key))
    else:
        count = np.add.reduceat(count, at)
    return *np.divmod(key[at], room), count


def described(a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray, named: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The texts of all ids in the order of a description, the first side of a group, then its second; and where each ends."""
    n_a, n_b = np.diff(a_stops, prepend=0), np.diff(b_stops, prepend=0)
    codes = np.empty(len(a) + len(b), np.int64)
    a_at = np.arange(len(a)) + np.repeat(b_stops - n_b, n_a)
    b_at = np.arange(len(b)) + np.repeat(a_stops, n_b)
    codes[a_at], codes[b_at] = a * 4, b * 4 + 2
    codes[a_at[a_stops - 1]] += 1
    codes[b_at[b_stops - 1]] += 1
    padded = named[codes].view(np.uint8).reshape(len(codes), -1)
    there = padded != 0
    return padded[there].tobytes(), np.cumsum(np.count_nonzero(there, axis=1))


def aligned_batch(texts: list[str | None], path_a: str, path_b: str, with_groups: bool) -> dict[str, list]:
    side_a, side_b, spelling_a, spelling_b, named = tokenizers(path_a, path_b)
    n = len(texts)
    present = [i for i, t in enumerate(texts) if t]
    ids_a, ids_b = (side.encode([texts[i] for i in present]) for side in (side_a, side_b))
    wanted = [b" " + texts[i].encode() for i in present]
    kept = np.flatnonzero(spelling_a.spells(ids_a, wanted) & spelling_b.spells(ids_b, wanted)).tolist()
    out = {c: [0] * n for c in ("n_a", "n_b", "n_groups", "n_links")}
    out |= {"groups_sha256": [""] * n, "groups": [""] * n, "pairs": [[]] * n, "links": [[]] * n}
    if not kept:
        return out
    rows = np.array([present[k] for k in kept])
    a, b = np.concatenate([ids_a[k] for k in kept]), np.concatenate([ids_b[k] for k in kept])
    a_sizes, b_sizes = (np.array([len(ids[k]) for k in kept]) for ids in (ids_a, ids_b))
    a_at, b_at = common_ends(np.cumsum(spelling_a.sizes[a]), np.cumsum(spelling_b.sizes[b]), a_sizes, b_sizes)
    a_stops, b_stops = a_at + 1, b_at + 1
    owner = np.repeat(np.arange(len(kept)), a_sizes)[a_at]
    group_stops = np.searchsorted(owner, np.arange(len(kept)), side="right")
    links = np.cumsum(np.diff(a_stops, prepend=0) * np.diff(b_stops, prepend=0))[group_stops - 1]
    text, pair, count = linked_pairs(a, b, a_stops, b_stops, owner, len(spelling_b.sizes))
    pair_edges = np.searchsorted(text, np.arange(len(kept) + 1))
    words, word_stops = described(a, b, a_stops, b_stops, named)
    word_edges = [0, *word_stops[np.cumsum(a_sizes + b_sizes) - 1].tolist()]
    numbers = zip(rows.tolist(), a_sizes.tolist(), b_sizes.tolist(), np.diff(group_stops, prepend=0).tolist(), np.diff(links, prepend=0).tolist())
    for (row, *counts), (p, q), (v, w) in zip(numbers, pairwise(pair_edges.tolist()), pairwise(word_edges)):
        for c, value in zip(("n_a", "n_b", "n_groups", "n_links"), counts):
            out[c][row] = value
        groups = words[v : w - 1]
        out["groups_sha256"][row] = hashlib.sha256(groups).hexdigest()
        out["groups"][row] = groups.decode() if with_groups else ""
        out["pairs"][row], out["links"][row] = pair[p:q], count[p:q]
    return out


def align(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text", with_groups: bool = True) -> DataFrame:
    """Each text's ``n_a`` and ``n_b`` tokens, ``n_groups``, ``n_links``, ``groups`` as ``a1,a2|b1;a3|b2,b3`` with their
    ``groups_sha256``, and the distinct linked ``pairs`` (first id times the size of the second vocabulary, plus second
    id) with the number of ``links`` of each.

    ``path_a`` names a byte-level tokenizer of the `tokenizers` library and ``path_b`` a sentencepiece model. Missing and
    empty texts, and those whose tokens do not spell a space and the text, have no tokens: zeros and empty strings. Rows
    are independent; repeated rows give repeated results, an empty table an empty one, and other columns are ignored.
    Nothing is shuffled. A task holds a batch of texts of 1 MB, or one longer text, with its tokens and links.
    """
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    columns = {c: pa.int64() for c in numbers} | {"groups_sha256": pa.string()}
    columns |= ({"groups": pa.string()} if with_groups else {}) | {c: pa.list_(pa.int64()) for c in ("pairs", "links")}
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    schema += ("groups string, " if with_groups else "") + "pairs array<long>, links array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", BATCH_BYTES):
            found = aligned_batch(batch.column("text").to_pylist(), path_a, path_b, with_groups)
            held = [pa.array(found[c], t) for c, t in columns.items()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *held], ["id", *columns])

    return mapped(chosen, run, schema).withColumnRenamed("id", doc_id)


def pair_counts(aligned: DataFrame, width: int) -> DataFrame:
    """How many rows hold each pair (``n``), and whether no other pair of its first id is held by more (``best``)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts, "pair-counts")
    first = F.floor(F.col("pair") / width).cast("int")
    most = counts.groupBy(first.alias("first")).agg(F.max("n").alias("most"))  # a row for each id of the vocabulary at most
    return counts.withColumn("first", first).join(F.broadcast(most), "first").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def summed(aligned: DataFrame, counts: DataFrame, most_frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """Adds ``n_best``, the links whose pair is the best of its first id, and ``count_sum``, the sum of the counts of all
    links, to rows that hold ``pairs`` and ``links``, which go.

    The most frequent pairs, of which every task holds at most ``most_frequent``, are looked up where the rows are. The
    others lie below a count, a power of two, so none of them is held by many rows: these join by shuffle, and no key of
    that join is hot.
    """
    spark = aligned.sparkSession
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    sizes = dict(map(tuple, counts.groupBy(level.alias("level")).count().collect()))  # 63 levels at most
    held, least = 0, 63
    for step in sorted(sizes, reverse=True):
        held += sizes[step]
        if held > most_frequent:
            break
        least = step
    frequent = counts.where(level >= least).toArrow().sort_by("pair")
    table = spark.sparkContext.broadcast([frequent[c].combine_chunks().to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])
    plain = [f for f in aligned.schema if f.name not in ("pairs", "links")]
    names = [f.name for f in plain]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = table.value
        for batch in batches:
            pairs, links = batch.column("pairs"), batch.column("links")
            stops = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(pairs).to_numpy(zero_copy_only=False))]).astype(np.int64)
            pair, link = pairs.flatten().to_numpy(), links.flatten().to_numpy()
            at = np.searchsorted(keys, pair)
            known = np.zeros(len(pair), bool)
            inside = at < len(keys)
            known[inside] = keys[at[inside]] == pair[inside]
            at = np.where(known, at, 0)
            sums = [np.concatenate([[0], np.cumsum(link * np.where(known, v[at], 0) if len(keys) else link * 0)]) for v in (best, n)]
            rest = np.concatenate([[0], np.cumsum(~known)])[stops].astype(np.int32)
            left = [pa.ListArray.from_arrays(rest, pa.array(v[~known])) for v in (pair, link)]
            found = [pa.array(s[stops[1:]] - s[stops[:-1]], pa.int64()) for s in sums]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *found, *left], [*names, "n_best", "count_sum", "pairs", "links"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain)
    rows = mapped(aligned, run, f"{fields}, n_best long, count_sum long, pairs array<long>, links array<long>")
    if len(frequent) == sum(sizes.values()):
        return rows.drop("pairs", "links")
    rows = stored(rows.withColumn("__row", F.monotonically_increasing_id()), "partly-counted")
    links = rows.select("__row", F.explode(F.arrays_zip("pairs", "links")).alias("of")).select("__row", "of.pairs", "of.links")
    rare = links.join(counts.where(level < least), F.col("pairs") == F.col("pair"))
    more = rare.groupBy("__row").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("__best"), F.sum(F.col("links") * F.col("n")).alias("__sum")
    )
    both = rows.drop("pairs", "links").join(more, "__row", "left").fillna(0, ["__best", "__sum"])
    both = both.withColumns({"n_best": F.col("n_best") + F.col("__best"), "count_sum": F.col("count_sum") + F.col("__sum")})
    return both.drop("__row", "__best", "__sum")


def alignment_counts(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256`` of every row.

    Edge cases are those of ``align``; a repeated row counts as a document of its own. Runs jobs at once: alignments are
    written to the shared folder, then counts.
    """
    found = stored(align(docs, path_a, path_b, doc_id, text, with_groups=False), "aligned")
    width = len(tokenizers(path_a, path_b)[1].tokens)
    rows = summed(found, pair_counts(found, width))
    return rows.select(doc_id, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
