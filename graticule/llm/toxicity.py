"""Toxicity scores from a convolutional text classifier with hashed word embeddings, trained in numpy.

A word's vector is the sum of hashed embeddings of the word and of its first four and five letters. Filters of widths
one to three run over the words of the whole text, the maximum of each filter is pooled, and a logistic layer gives the
score. The score is scaled on held-back training rows, on which a threshold for each language is chosen as well.

All labelled rows are learned from, with their whole texts. They are dealt in parts by the hash of their identifiers; in
each epoch every part trains a copy of the weights, and the copies are averaged. Which tasks hold which parts changes
nothing, since sums are those of whole numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from graticule.llm.common import crc_bucket, kept_by_worker, mapped, small_batches, stored

BUCKETS, WIDTH = 1 << 16, 16
FILTERS, SPANS = 8, (1, 2, 3)
SEEN = 3  # embeddings of buckets in fewer learned texts are zero: a rare or unknown word says nothing
PART_ROWS = 4000  # rows of a part, about: they train one copy of the weights
PART_WORDS, PART_DISTINCT = 4_000_000, 300_000  # a part of more words, or of more different ones, is cut
EPOCHS, BATCH, RATE = 6, 32, 0.05
LEAST_SHARE = 0.1  # rows of a rarer label are dealt several times an epoch, to make up about this share of each batch
POSITIONS = 1 << 15  # words that filters run over in one go, or one longer text
START = 0.15
KNOWN_WORDS = 300_000
LEAST_POSITIVES = 20  # rows with label 1 that a language needs for a threshold of its own
PADDING = len(SPANS)
DENSE = sum(SPANS) * WIDTH * FILTERS + 2 * len(SPANS) * FILTERS + 1  # weights that are not embeddings
LINES = BUCKETS - -DENSE // WIDTH  # of ``WIDTH`` weights: the embeddings, then the others
CHUNKS = 64  # of lines, summed apart
CHUNK_LINES = -(-LINES // CHUNKS)
TASK_PARTS = 8  # that train in one task if there are more than cores: a task sends its sums once an epoch
UNIT = 1 << 22  # changes of weights are summed in whole numbers of 1 / UNIT
LOGIT_UNIT = 256  # held-back rows are counted by logit in steps of 1 / LOGIT_UNIT
FILTER_BITS = 1 << 26  # at most, of the filter that keeps most texts without a label out of the shuffle
BITMAP = 1 << 15  # bits of one of Spark's bitmaps

PARTS = "part long, cut int, texts long, positives long, numbers binary, sizes binary, labels binary, features binary, langs array<string>, counts binary"
SUMS = "chunk int, at binary, sums binary"

WORD = re.compile(r"\w+")


def features(word: str) -> list[int]:
    named = (f"w{word}", f"4{word[:4]}", f"5{word[:5]}")
    return [xxhash.xxh64_intdigest(x) % BUCKETS for x in named]


@kept_by_worker(maxsize=1)
def known_words() -> tuple[dict[str, int], list[list[int]]]:
    """Kept by a worker from task to task; features do not depend on the classifier."""
    return {}, [[0, 0, 0]]


def number_words(texts: list[str], known: dict[str, int], rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in one array, each text behind ``PADDING`` zeros, and where each begins.

    ``known`` numbers words from 1 and ``rows`` holds the features of each; both grow.
    """
    numbers, starts = [], []
    for text in texts:
        starts.append(len(numbers))
        numbers.extend([0] * PADDING)
        for word in WORD.findall(text.lower()):
            n = known.get(word)
            if n is None:
                n = known[word] = len(rows)
                rows.append(features(word))
            numbers.append(n)
    return np.array(numbers, np.int64), np.array(starts, np.int64)


@dataclass
class Classifier:
    embedding: np.ndarray  # (buckets, width)
    filters: list[np.ndarray]  # for each span: (span, width, filters)
    bias: list[np.ndarray]
    out: np.ndarray  # pooled filters, then the bias
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        found = np.take(self.embedding, rows[:, 0], axis=0)
        for k in range(1, rows.shape[1]):
            found += np.take(self.embedding, rows[:, k], axis=0)
        return found

    def pooled(self, vectors: np.ndarray, numbers: np.ndarray, starts: np.ndarray, where: bool = False):
        """Largest value of each filter in each text; with ``where`` also its position. Row 0 of ``vectors`` is padding."""
        stops = np.append(starts[1:], len(numbers))
        parts = [[vectors @ w for w in weights] for weights in self.filters]
        best = np.empty((len(starts), FILTERS * len(SPANS)), np.float32)
        places = np.empty(best.shape if where else (0, 0), np.int64)
        first = 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(stops, starts[first] + POSITIONS, "right")))
            offset = starts[first]
            mine = numbers[offset : stops[last - 1]]
            begin, stop = starts[first:last] - offset + PADDING - 1, stops[first:last] - offset
            for k, bias in enumerate(self.bias):
                columns = slice(k * FILTERS, (k + 1) * FILTERS)
                total = np.take(parts[k][0], mine, axis=0)
                for back in range(1, len(parts[k])):  # the filter ends at a position and reaches back
                    total[back:] += np.take(parts[k][back], mine[: len(mine) - back], axis=0)
                total += bias
                if where:
                    at = np.stack([a + total[a:b].argmax(axis=0) for a, b in zip(begin, stop)])
                    places[first:last, columns] = at + offset
                    best[first:last, columns] = total[at, np.arange(FILTERS)]
                else:
                    edges = np.stack([begin, stop], axis=1).reshape(-1)[:-1]
                    best[first:last, columns] = np.maximum.reduceat(total, edges)[::2]
            first = last
        np.maximum(best, 0, out=best)
        return (best, places) if where else best

    def of_words(self, numbers: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Logits of texts whose words are numbered; ``table`` holds the features of each word in use."""
        vectors = self.vectors(table)
        vectors[0] = 0
        return self.pooled(vectors, numbers, starts) @ self.out[:-1] + self.out[-1]

    def logits(self, texts: list[str], known: dict[str, int] | None = None, rows: list[list[int]] | None = None) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if known is None:
            known, rows = {}, [[0, 0, 0]]
        numbers, starts = number_words(texts, known, rows)
        used, numbers = renumbered(numbers, len(rows))
        return self.of_words(numbers, starts, np.array([rows[i] for i in used]))

    def scores(self, texts: list[str], known: dict[str, int] | None = None, rows: list[list[int]] | None = None) -> np.ndarray:
        return self.scaled(self.logits(texts, known, rows))

    def scaled(self, logits: np.ndarray) -> np.ndarray:
        slope, shift = self.scale
        return 1 / (1 + np.exp(-np.clip(slope * logits + shift, -30, 30)))


def renumbered(numbers: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, of which ``words`` is above all, and the place of each number among them."""
    found = np.zeros(words, bool)
    found[numbers] = True
    used = np.flatnonzero(found)
    place = np.zeros(words, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    return used, np.take(place, numbers)


def cut(lines: np.ndarray) -> Classifier:
    """The classifier whose weights are views of ``lines``."""
    rest, at = lines[BUCKETS:].reshape(-1), 0

    def take(*shape: int) -> np.ndarray:
        nonlocal at
        at += int(np.prod(shape))
        return rest[at - int(np.prod(shape)) : at].reshape(shape)

    return Classifier(lines[:BUCKETS], [take(s, WIDTH, FILTERS) for s in SPANS], [take(FILTERS) for _ in SPANS], take(FILTERS * len(SPANS) + 1))


@dataclass
class Part:
    """Labelled texts whose words are numbered from 1; each text begins with ``PADDING`` zeros."""

    numbers: np.ndarray
    sizes: np.ndarray
    labels: np.ndarray
    table: np.ndarray  # features of each word

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes, dtype=np.int64) - self.sizes

    def counts(self) -> np.ndarray:
        """Texts in which each bucket is, and those of label 1 (bucket, 2)."""
        found = np.zeros((BUCKETS, 2), np.int64)
        for start, size, label in zip(self.starts, self.sizes, self.labels):
            if size > PADDING:
                buckets = np.unique(self.table[np.unique(self.numbers[start + PADDING : start + size])])
                found[buckets, 0] += 1
                found[buckets, 1] += int(label)
        return found


def packed(sequences: list[np.ndarray], labels: list[int], rows: list[list[int]]) -> Part:
    numbers = np.concatenate(sequences)
    used, numbers = renumbered(numbers, len(rows))
    return Part(numbers, np.array([len(s) for s in sequences], np.int32), np.array(labels, np.int8), np.array([rows[i] for i in used], np.uint16))


def start_weights(counts: np.ndarray, learned: int, positives: int, texts: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights in lines, and the buckets that may have an embedding. Without both labels there is none."""
    rng = np.random.default_rng(seed)
    seen, marked = counts.T.astype(np.float64)
    share = positives / learned if learned else 0.0
    live = (seen >= min(SEEN, max(1, texts // 20))) & (0 < share < 1)
    embedding = rng.normal(0, 0.05, (BUCKETS, WIDTH))
    # The first dimension starts from how far a bucket's count in texts of label 1 lies above chance.
    embedding[:, 0] = START * np.clip((marked - seen * share) / np.sqrt(seen * share * (1 - share) + 1), -10, 10)
    lines = np.zeros((LINES, WIDTH), np.float32)
    net = cut(lines)
    net.embedding[:] = embedding * live[:, None]
    for s, weights in zip(SPANS, net.filters):
        weights[:] = rng.normal(0, (s * WIDTH) ** -0.5, weights.shape)
    net.out[:-1] = rng.normal(0, 0.3, FILTERS * len(SPANS))
    return lines, live


def train_part(lines: np.ndarray, past: np.ndarray, live: np.ndarray, part: Part, share: float, seed: list[int]) -> np.ndarray:
    """One epoch of the part, in place. Returns which lines it moved.

    Both labels are dealt evenly over the batches, and weigh the same in all. ``share`` is that of label 1 among all
    learned rows.
    """
    rng = np.random.default_rng(seed)
    net, squares = cut(lines), cut(past)
    moved = np.zeros(LINES, bool)
    moved[BUCKETS:] = True
    starts = part.starts
    times = [max(1, round(LEAST_SHARE / x)) for x in (1 - share, share)]
    dealt = [np.repeat(np.flatnonzero(part.labels == label), times[label]) for label in (0, 1)]
    place = [(rng.permutation(len(rows)) + rng.random()) / max(1, len(rows)) for rows in dealt]
    order = np.concatenate(dealt)[np.argsort(np.concatenate(place), kind="stable")]
    share = share * times[1] / (share * times[1] + (1 - share) * times[0])

    def step(value: np.ndarray, square: np.ndarray, grad: np.ndarray) -> None:
        square += grad * grad
        value -= RATE * grad / np.sqrt(square)

    for chosen in np.array_split(order, -(-len(order) // BATCH)):
        labels = part.labels[chosen]
        numbers = np.concatenate([part.numbers[starts[i] : starts[i] + part.sizes[i]] for i in chosen])
        begin = np.cumsum(part.sizes[chosen], dtype=np.int64) - part.sizes[chosen]
        used, numbers = renumbered(numbers, len(part.table))
        rows_used = part.table[used]
        vectors = net.vectors(rows_used)
        vectors[0] = 0
        best, at = net.pooled(vectors, numbers, begin, where=True)
        score = 1 / (1 + np.exp(-np.clip(best @ net.out[:-1] + net.out[-1], -30, 30)))
        even = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
        d = ((score - labels) * even / len(chosen)).astype(np.float32)
        d_best = (d[:, None] * net.out[:-1]) * (best > 0)
        d_out = np.append(best.T @ d, d.sum()) + 1e-4 * net.out
        words_hit, d_words = [], []
        for k, weights_k in enumerate(net.filters):
            mine = slice(k * FILTERS, (k + 1) * FILTERS)
            grad, place_k = d_best[:, mine], at[:, mine]
            d_weights = np.zeros_like(weights_k)
            for reach in range(len(weights_k)):
                words = numbers[place_k - reach]
                d_weights[reach] = np.einsum("bf,bfw->wf", grad, vectors[words])
                words_hit.append(words.reshape(-1))
                d_words.append((grad[:, :, None] * weights_k[reach].T[None]).reshape(-1, WIDTH))
            step(weights_k, squares.filters[k], d_weights + 1e-4 * weights_k)
            step(net.bias[k], squares.bias[k], grad.sum(axis=0))
        words, d_words = np.concatenate(words_hit), np.concatenate(d_words)
        hit = (words > 0) & d_words.any(axis=1)
        if hit.any():
            buckets = rows_used[words[hit]].reshape(-1)
            by_bucket = np.argsort(buckets, kind="stable")
            buckets = buckets[by_bucket]
            edges = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
            d_rows = np.add.reduceat(d_words[hit][by_bucket // rows_used.shape[1]], edges)
            touched = buckets[edges]
            d_rows, touched = d_rows[live[touched]], touched[live[touched]]
            d_rows += 1e-5 * net.embedding[touched]
            held = squares.embedding[touched] + d_rows * d_rows
            squares.embedding[touched] = held
            net.embedding[touched] -= RATE * d_rows / np.sqrt(held)
            moved[touched] = True
        step(net.out, squares.out, d_out)
    return moved


def changes(lines: np.ndarray, past: np.ndarray, live: np.ndarray, part: Part, share: float, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The lines that an epoch of the part moves, and for each, in whole numbers: the changes of weights and of squares
    times the part's rows, then these rows."""
    own, own_past = lines.copy(), past.copy()
    at = np.flatnonzero(train_part(own, own_past, live, part, share, seed))
    change = np.concatenate([own[at] - lines[at], own_past[at] - past[at]], axis=1).astype(np.float64)
    found = np.full((len(at), 2 * WIDTH + 1), len(part.labels), np.int64)
    found[:, :-1] = np.rint(change * UNIT).astype(np.int64) * len(part.labels)
    return at, found


def moved_by(lines: np.ndarray, past: np.ndarray, sums: np.ndarray) -> None:
    """Moves each line by the mean of the changes that the parts made to it, in place."""
    at = np.flatnonzero(sums[:, -1])
    mean = sums[at, :-1] / (sums[at, -1:] * float(UNIT))
    lines[at] += mean[:, :WIDTH].astype(np.float32)
    past[at] += mean[:, WIDTH:].astype(np.float32)


def to_bytes(values: np.ndarray) -> bytes:
    """Whole numbers, their sign in the lowest bit, all lowest bytes first: the shuffle's compression then drops the others."""
    folded = ((values << 1) ^ (values >> 63)).reshape(-1).view(np.uint8).reshape(-1, 8)
    return np.ascontiguousarray(folded.T).tobytes()


def from_bytes(data: bytes) -> np.ndarray:
    folded = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).reshape(-1).view(np.uint64)
    return (folded >> np.uint64(1)).view(np.int64) ^ -(folded & np.uint64(1)).view(np.int64)


def first_squares() -> np.ndarray:
    return np.full((LINES, WIDTH), 1e-2, np.float32)


def train(texts: list[str], labels: np.ndarray, langs: list[str | None], weights: np.ndarray, seed: int = 5) -> Classifier:
    """A classifier for the rows, as one part, of which every fifth is held back for the scale and the thresholds.

    ``weights`` says how many rows each one stands for. Same rows in the same order give the same classifier.
    """
    back = np.arange(len(texts)) % 5 == 4
    known, rows = {}, [[0, 0, 0]]
    sequences = [number_words([text], known, rows)[0] for text in texts]
    learn = np.flatnonzero(~back)
    if not len(learn):
        return cut(start_weights(np.zeros((BUCKETS, 2)), 0, 0, 0, seed)[0])
    part = packed([sequences[i] for i in learn], labels[learn], rows)
    share = float(part.labels.mean())
    lines, live = start_weights(part.counts(), len(learn), int(part.labels.sum()), len(texts), seed)
    past = first_squares()
    if 0 < share < 1:
        for epoch in range(EPOCHS):
            train_part(lines, past, live, part, share, [seed, epoch, 0, 0])
    net = cut(lines)
    logits = net.logits([t for t, b in zip(texts, back) if b])
    calibrate(net, logits, labels[back], [g for g, b in zip(langs, back) if b], weights[back])
    return net


def calibrate(net: Classifier, logits: np.ndarray, labels: np.ndarray, langs: list[str | None], weights: np.ndarray) -> None:
    """Scales the score to the share of label 1, and sets the thresholds with the best F1, overall and by language."""
    if weights.sum() < 10 or labels.min() == labels.max():
        return
    mean = float(np.average(logits, weights=weights))
    spread = max(float(np.average((logits - mean) ** 2, weights=weights)) ** 0.5, 1e-6)
    x, slope, shift = (logits - mean) / spread, 1.0, 0.0
    aim = np.where(labels == 1, 0.995, 0.005)
    weight = weights / weights.sum()
    for _ in range(500):
        error = (1 / (1 + np.exp(-(slope * x + shift))) - aim) * weight
        slope, shift = max(0.05, slope - 0.5 * float((error * x).sum())), shift - 0.5 * float(error.sum())
    net.scale = (slope / spread, shift - slope * mean / spread)
    score = net.scaled(logits)
    net.threshold = best_threshold(score, labels, weights)
    names = pd.Series(langs, dtype=object).fillna("")
    for name in sorted(set(names)):
        mine = (names == name).to_numpy()
        if name and (labels * weights)[mine].sum() >= LEAST_POSITIVES:
            net.thresholds[name] = best_threshold(score[mine], labels[mine], weights[mine])


def best_threshold(score: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> float:
    """Half way between the neighbouring scores that give the best F1. Equal scores are on one side."""
    order = np.argsort(-score, kind="stable")
    score, hits = score[order], np.cumsum((labels * weights)[order])
    f1 = 2 * hits / (np.cumsum(weights[order]) + (labels * weights).sum())
    ends = np.flatnonzero(np.append(score[1:] != score[:-1], True))
    k = int(ends[f1[ends].argmax()])
    return float((score[k] + (score[k + 1] if k + 1 < len(score) else 0.0)) / 2)


def held_out(doc_id: str = "doc_id") -> Column:
    """The rows that are never learned from."""
    return crc_bucket(doc_id, 4) == 2


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts from rows in the order of part and identifier, where the label of an identifier comes before its texts. A part
    ends where the next one begins, or where its words reach ``PART_WORDS`` or its different words ``PART_DISTINCT``."""
    known, rows = {}, [[0, 0, 0]]
    sequences, labels, langs, words, at, label_of, label = [], [], [], 0, None, None, None

    def done() -> Iterator[pa.RecordBatch]:
        if sequences:
            part = packed(sequences, labels, rows)
            row = (
                at[0], at[1], len(labels), sum(labels), part.numbers.tobytes(), part.sizes.tobytes(), part.labels.tobytes(), part.table.tobytes(),
                langs if at[2] else None, None if at[2] else to_bytes(part.counts()),
            )
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.list_(pa.string()), pa.binary())
            names = ("part", "cut", "texts", "positives", "numbers", "sizes", "labels", "features", "langs", "counts")
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], list(names))

    for batch in small_batches(batches, "t"):
        for part, back, key, y, text, lang in zip(*(batch.column(c).to_pylist() for c in ("part", "back", "id", "y", "t", "l"))):
            if y is not None:
                label_of, label = key, y
                continue
            if label is None or key != label_of:
                continue
            if at is None or part != at[0] or words >= PART_WORDS or len(known) >= PART_DISTINCT:
                yield from done()
                at = (part, at[1] + 1 if at and part == at[0] else 0, back)
                known, rows = {}, [[0, 0, 0]]
                sequences, labels, langs, words = [], [], [], 0
            sequences.append(number_words([text], known, rows)[0].astype(np.int32))
            labels.append(label)
            langs.append(lang)
            words += len(sequences[-1])
    yield from done()


def unpacked(batch: pa.RecordBatch, i: int) -> Part:
    numbers, sizes, labels, features = (batch.column(c)[i].as_py() for c in ("numbers", "sizes", "labels", "features"))
    return Part(np.frombuffer(numbers, np.int32), np.frombuffer(sizes, np.int32), np.frombuffer(labels, np.int8), np.frombuffer(features, np.uint16).reshape(-1, 3))


def summed(rows: DataFrame, columns: int) -> np.ndarray:
    """The sums by line (``LINES``, columns) of what tasks send: chunk, lines in it, and whole numbers for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, at, sums in zip(*(c.to_pylist() for c in batch.columns)):
                total = held.setdefault(chunk, np.zeros((CHUNK_LINES, columns), np.int64))
                total[np.frombuffer(at, np.int32)] += from_bytes(sums).reshape(-1, columns)
        for chunk, total in held.items():
            yield sent_sums([(chunk, total)])

    out = np.zeros((CHUNKS * CHUNK_LINES, columns), np.int64)
    for r in mapped(rows.repartition("chunk"), run, SUMS).collect():
        out[r["chunk"] * CHUNK_LINES + np.frombuffer(r["at"], np.int32)] += from_bytes(r["sums"]).reshape(-1, columns)
    return out[:LINES]


def sent_sums(chunks: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    rows = []
    for chunk, total in chunks:
        at = np.flatnonzero(total.any(axis=1)).astype(np.int32)
        if len(at):
            rows.append((chunk, at.tobytes(), to_bytes(total[at])))
    arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(arrays, ["chunk", "at", "sums"])


def by_chunk(total: np.ndarray) -> list[tuple[int, np.ndarray]]:
    return [(k, total[k * CHUNK_LINES : (k + 1) * CHUNK_LINES]) for k in range(CHUNKS)]


def labelled_rows(docs: DataFrame, marked: DataFrame, n: int, doc_id: str, text: str, lang: str) -> DataFrame:
    """The labels, and the texts of these ``n`` identifiers and of a few others.

    Labels and texts then go through one shuffle. Bitmaps of hashed identifiers, of ``FILTER_BITS`` at most, keep most
    texts without a label out of it.
    """
    width = BITMAP
    while width < min(16 * n, FILTER_BITS):
        width *= 2
    bit = F.pmod(F.xxhash64("id", F.lit(12)), F.lit(width))
    slots = marked.withColumn("bit", bit).groupBy(F.expr(f"bit div {BITMAP}").alias("slot")).agg(F.bitmap_construct_agg(F.col("bit") % BITMAP).alias("bits"))
    language = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col(doc_id).cast(marked.schema["id"].dataType).alias("id"), F.col(text).cast("string").alias("t"), language.alias("l"))
    found = f"bit_get(cast(conv(hex(substring(bits, cast(bit % {BITMAP} div 8 as int) + 1, 1)), 16, 10) as int), cast(bit % 8 as int)) = 1"
    likely = texts.where("id is not null and t is not null").withColumn("bit", bit).withColumn("slot", F.expr(f"bit div {BITMAP}")).join(F.broadcast(slots), "slot").where(found)
    none = F.lit(None)
    return marked.select("id", "y", none.cast("string").alias("t"), none.cast("string").alias("l")).unionByName(likely.select("id", none.cast("int").alias("y"), "t", "l"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", label: str = "toxic") -> Classifier:
    """Learns from all labelled rows and their whole texts: four fifths, by the hash of the identifier, train the weights,
    and the others set the scale and the thresholds.

    ``learn`` is a condition on the rows of ``labels``. Rows without an identifier or a text, or with a label other than 0
    and 1, are not learned from. Of several labels of one identifier the largest counts. Without rows of both labels every
    score is 0.5. Runs jobs at once: they store the labels and the parts with their words numbered, count buckets, train
    ``EPOCHS`` times, and count the held-back rows by logit. The driver holds the weights and these counts.
    """
    kind = docs.select(doc_id).union(labels.select(doc_id)).schema[0].dataType
    wanted = F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & (F.lit(True) if learn is None else learn)
    marked = labels.where(wanted).groupBy(F.col(doc_id).cast(kind).alias("id")).agg(F.max(label).cast("int").alias("y"))
    marked = stored(marked, "toxicity-labels")
    n = marked.count()
    trained, kept = max(1, -(-4 * n // (5 * PART_ROWS))), max(1, -(-n // (5 * PART_ROWS)))
    back = F.pmod(F.xxhash64("id", F.lit(10)), F.lit(5)) == 4
    dealt = F.xxhash64("id", F.lit(11))
    rows = (
        labelled_rows(docs, marked, n, doc_id, text, lang)
        .withColumns({"back": back, "luck": F.xxhash64("id", F.lit(9)), "part": F.when(back, trained + F.pmod(dealt, F.lit(kept))).otherwise(F.pmod(dealt, F.lit(trained)))})
        .repartitionById(trained + kept, F.col("part").cast("int"))
        .sortWithinPartitions("part", "luck", "id", F.col("y").isNull(), "t", "l")
        .select("part", "back", "id", "y", "t", "l")
    )
    parts = stored(mapped(rows, pack, PARTS), "toxicity-parts")
    found = {r["b"]: r for r in parts.groupBy((F.col("part") >= trained).alias("b")).agg(F.sum("texts").alias("n"), F.sum("positives").alias("p"), F.count("*").alias("k")).collect()}
    learned, positives = (found[False]["n"], found[False]["p"]) if False in found else (0, 0)
    texts = learned + (found[True]["n"] if True in found else 0)
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-found[False]["k"] // TASK_PARTS)) if learned else 1
    own = parts.where(F.col("part") < trained).coalesce(tasks)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LINES, 2), np.int64)
        for batch in batches:
            for counts in batch.column(0):
                total[:BUCKETS] += from_bytes(counts.as_py()).reshape(-1, 2)
        yield sent_sums(by_chunk(total))

    counts = summed(mapped(own.select("counts"), counted, SUMS), 2)[:BUCKETS] if learned else np.zeros((BUCKETS, 2))
    lines, live = start_weights(counts, learned, positives, texts)
    if not 0 < positives < learned:
        return cut(lines)
    past, share = first_squares(), positives / learned
    for epoch in range(EPOCHS):
        train_all(own, lines, past, live, share, epoch)
    net = cut(lines)
    counts = logit_counts(parts.where(F.col("part") >= trained), net)
    calibrate(net, counts["logit"].to_numpy(np.float64) / LOGIT_UNIT, counts["y"].to_numpy(np.float64), counts["l"].tolist(), counts["n"].to_numpy(np.float64))
    return net


def train_all(parts: DataFrame, lines: np.ndarray, past: np.ndarray, live: np.ndarray, share: float, epoch: int, seed: int = 5) -> None:
    """One epoch over all parts, in place."""
    sent = parts.sparkSession.sparkContext.broadcast((lines, past, live))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LINES, 2 * WIDTH + 1), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                at, found = changes(*sent.value, unpacked(batch, i), share, [seed, epoch, batch.column("part")[i].as_py(), batch.column("cut")[i].as_py()])
                total[at] += found
        yield sent_sums(by_chunk(total))

    moved_by(lines, past, summed(mapped(parts.select("part", "cut", "numbers", "sizes", "labels", "features"), run, SUMS), 2 * WIDTH + 1))
    sent.destroy()


def logit_counts(parts: DataFrame, net: Classifier) -> pd.DataFrame:
    """The rows of the parts by language, label and logit in whole steps. Languages with too few rows of label 1 for a
    threshold of their own count as none."""
    sent = parts.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = unpacked(batch, i)
                logit = np.rint(sent.value.of_words(part.numbers, part.starts, part.table) * LOGIT_UNIT).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("langs")[i].values, pa.array(part.labels, pa.int32()), pa.array(logit)], ["l", "y", "logit"])

    logits = mapped(parts.select("numbers", "sizes", "labels", "features", "langs"), run, "l string, y int, logit long")
    counts = stored(logits.groupBy("l", "y", "logit").agg(F.count("*").alias("n")), "toxicity-logits")
    sent.destroy()
    own = counts.where("y = 1").groupBy("l").agg(F.sum("n").alias("p")).where(F.col("p") >= LEAST_POSITIVES).select("l", F.col("l").alias("own"))
    counts = counts.join(F.broadcast(own), "l", "left").groupBy(F.col("own").alias("l"), "y", "logit").agg(F.sum("n").alias("n"))
    return counts.orderBy("l", "y", "logit").toPandas()


def predict(docs: DataFrame, net: Classifier, text: str = "text") -> DataFrame:
    """Adds ``score``, from 0 to 1, of the whole text. A missing text is scored as an empty one. A column of that name
    is replaced; rows are independent, nothing is shuffled, and the classifier is a few megabytes whatever the input."""
    kept = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (known, rows) = sent.value, known_words()
        for batch in small_batches(batches, text):
            if len(known) > KNOWN_WORDS:
                known.clear()
                del rows[1:]
            found = model.scores([t or "" for t in batch.column(text).to_pylist()], known, rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, "score"])

    return mapped(kept, run, StructType(list(kept.schema.fields)).add("score", DoubleType()))


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learns from the labelled rows that are not held out and scores every row: identifier, ``held_out``, ``score`` and
    ``predicted``, 1 from the cutoff up; then ``threshold``, the calibrated one of the row's language, and ``flagged``, whether
    the score reaches it. The language chooses the threshold only, and a table without that column takes the common one.
    Repeated rows give equal results, other columns are ignored, and an empty table gives an empty result."""
    net = fit(docs, labels, ~held_out(doc_id), doc_id, text, lang)
    language = F.col(lang).cast("string") if lang in docs.columns else F.lit(None).cast("string")
    chosen = docs.select(F.col(doc_id).alias("id"), held_out(doc_id).alias("held_out"), F.col(text).cast("string").alias("text"), language.alias("lang"))
    return flag_by_language(predict(chosen, net), net).select(
        F.col("id").alias(doc_id), "held_out", "score", (F.col("score") >= cutoff).cast("int").alias("predicted"), "threshold", "flagged"
    )


def flag_by_language(scored: DataFrame, net: Classifier, lang: str = "lang") -> DataFrame:
    """Adds ``threshold`` and ``flagged`` by the threshold of each row's language; others take the common one."""
    limit = F.lit(net.threshold)
    if net.thresholds:
        own = F.create_map(*[F.lit(x) for pair in net.thresholds.items() for x in pair])
        limit = F.coalesce(F.try_element_at(own, F.coalesce(F.col(lang), F.lit(""))), limit)
    return scored.withColumn("threshold", limit).withColumn("flagged", F.col("score") >= F.col("threshold"))
