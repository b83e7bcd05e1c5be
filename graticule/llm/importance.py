"""Importance resampling towards a target corpus: documents that look like the target are drawn more often.

Every word, or run of words, falls into a hashed bucket. Both corpora are counted over all texts, and an array holds the
log ratio of each bucket; a document weighs the mean over its features. Scores are weights with Gumbel noise, of which
the highest are a draw without replacement. The cutoff is found by bracketing: a mergeable quantile sketch proposes two
scores, exact counts outside them validate or widen the bracket, and only the rows inside it are sorted.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graticule.llm.common import mapped, small_batches, stored

BUCKETS = 10_000
ACCURACY = 10_000  # of the quantile sketch: a rank is off by at most one part in so many
KNOWN_FEATURES = 400_000  # that a task keeps with their buckets

# Words are runs of the digits, a to z, and everything beyond ASCII, once A to Z are lower-cased. In UTF-8 all bytes of the
# latter are beyond ASCII too, so a table of bytes cuts them.
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in bytes(range(256)).lower())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLDED).split()


def features_of(words: list[bytes], longest: int) -> Iterable[bytes]:
    """All runs of 1 to ``longest`` consecutive words, joined by a space."""
    yield from words
    for n in range(2, longest + 1):
        for at in range(len(words) - n + 1):
            yield b" ".join(words[at : at + n])


class Buckets(dict):
    """The bucket of each feature, or what an array holds for it."""

    def __init__(self, buckets: int, values: list[int] | None = None) -> None:
        self.buckets, self.values = buckets, values

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN_FEATURES:
            self.clear()
        bucket = zlib.crc32(feature) % self.buckets
        self[feature] = found = bucket if self.values is None else self.values[bucket]
        return found


def counted(texts: DataFrame, text: str, longest: int, buckets: int, name: str) -> DataFrame:
    """Features by bucket, at most one row for each. A task sends at most one row for each as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in small_batches(batches, "text"):
            for value in batch.column(0).to_pylist():
                held += np.bincount([known[f] for f in features_of(words_of(value), longest)], minlength=buckets)
        found = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(held[found])], ["bucket", "n"])

    counts = mapped(texts.select(F.col(text).cast("string").alias("text")), run, "bucket int, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias(name))


def gains(docs: DataFrame, target: DataFrame, text: str, target_text: str, longest: int, buckets: int) -> list[int]:
    """The gain of each bucket: ``buckets`` numbers, whatever the corpora hold."""
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    held = every.join(counted(docs, text, longest, buckets, "s"), "bucket", "left")
    held = held.join(counted(target, target_text, longest, buckets, "t"), "bucket", "left").fillna(0, ["s", "t"])
    rows = held.select("bucket", "s", "t").toArrow().sort_by("bucket")  # `buckets` rows
    sums = {c: sum(rows[c].to_pylist()) for c in "st"}
    all_s, all_t = float(sums["s"] + buckets), float(sums["t"] + buckets)
    ratios = (rows["t"].to_numpy() + 1.0) * all_s / ((rows["s"].to_numpy() + 1.0) * all_t)
    return [math.floor(1000 * math.log(r)) for r in ratios.tolist()]


def scored(
    docs: DataFrame, target: DataFrame, seed: int = 2024, longest: int = 1, buckets: int = BUCKETS,
    doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` and ``score`` of every document.

    A missing or empty text has no features and weighs 0. A missing identifier counts as empty in the noise; repeated
    rows are scored alike. Other columns are ignored. Two scans of the documents, one shuffle of at most ``buckets`` rows
    a task. Tasks get the array of gains, ``buckets`` numbers. Counting runs a job at once.
    """
    by_bucket = gains(docs, target, text, target_text, longest, buckets)
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = Buckets(buckets, by_bucket)
        for batch in small_batches(batches, "text"):
            n_words, n_features, weights = [], [], []
            for value in batch.column("text").to_pylist():
                words = words_of(value)
                found = [gain[f] for f in features_of(words, longest)]
                n_words.append(len(words))
                n_features.append(len(found))
                weights.append(sum(found) // len(found) if found else 0)
            numbers = [pa.array(v, pa.int64()) for v in (n_words, n_features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *numbers], ["id", "n_words", "n_features", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    weighed = mapped(rows, run, f"id {kind}, n_words long, n_features long, weight long")
    number = F.coalesce(F.col("id").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), number), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.ln(-F.ln((h + 0.5) / 4294967296.0)) * -1000.0)
    return weighed.select(F.col("id").alias(doc_id), "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row in the whole order, 1, 2, 3, ...: ranges are sorted apart and offset by the rows before
    them. Runs a job, which writes the sorted rows, so that a lost executor cannot move a border between ranges. The order
    must tell all rows apart."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The upper bits are the range, the lower 33 the place in it.
    dealt = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    sizes = dealt.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*").alias("n")).collect()  # one row a range
    before, so_far = {}, 0
    for part, n in sorted(map(tuple, sizes)):
        before[part], so_far = so_far, so_far + n
    offsets = F.from_json(F.lit(str([before.get(p, 0) for p in range(max(before, default=0) + 1)])), "array<bigint>")
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn(name, F.get(offsets, F.shiftright("__at", 33).cast("int")) + inside + 1).drop("__at")


def bracket(rows: DataFrame, wanted: int, total: int, accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(lowest, highest, rows above): scores between which the cutoff of the ``wanted`` highest rows lies, and how many
    rows lie above the bracket. The sketch's guess is checked by exact counts and widened until it holds."""
    margin = 2 / accuracy
    while True:
        places = [max(0.0, 1 - wanted / total - margin), min(1.0, 1 - wanted / total + margin)]
        lowest, highest = rows.agg(F.percentile_approx("score", places, accuracy)).first()[0]
        above, reached = rows.agg(F.count_if(F.col("score") > highest), F.count_if(F.col("score") >= lowest)).first()
        if above < wanted <= reached:
            return lowest, highest, above
        margin *= 4  # at 1 the bracket holds every row


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, longest: int = 1,
    buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
) -> DataFrame:
    """Draws ``percent`` of the documents of ``least_words`` words and more, those with the highest scores, ties to the
    smaller identifier. Every document comes back: ``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank``, which is
    1, 2, 3, ... from the highest score down and NULL for what is not drawn.

    Missing and empty texts have no words and are not drawn, unless ``least_words`` is 0. Rows without an identifier come
    last among ties; rows equal in both count as rows of their own, in an order fixed when the scores are written. An
    empty table, or one too small for a draw, gives no rank. Other columns are ignored.

    Runs jobs at once. Scores are written to the shared folder; the sketch, the counts and the final order read only
    those narrow rows. What is sorted is the bracket, about 4 in ``ACCURACY`` rows and their ties, and the drawn rows,
    by ranges of a key that tells all rows apart, so no range holds more than its share.
    """
    rows = scored(docs, target, seed, longest, buckets, doc_id, text, target_text)
    rows = rows.select(F.col(doc_id).alias("id"), "n_words", "n_features", "weight", "score", F.monotonically_increasing_id().alias("row"))
    rows = stored(rows, "scores")
    named = [F.col("id").alias(doc_id), "n_features", "weight", "score"]
    ready = rows.where(F.col("n_words") >= least_words)
    total = ready.count()
    wanted = percent * total // 100
    if wanted == 0:
        return rows.select(*named, F.lit(None).cast("long").alias("rank"))
    lowest, highest, above = bracket(ready, wanted, total)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("row")]
    inside = numbered(ready.where(F.col("score").between(lowest, highest)), order, "place")
    last = inside.where(F.col("place") == wanted - above).select("score", "id", "row").first()
    # Before the cutoff in the order, or at it.
    same = F.col("score") == last["score"]
    if last["id"] is None:
        ahead = same & (F.col("id").isNotNull() | (F.col("row") <= last["row"]))
    else:
        smaller = F.coalesce(F.col("id") < last["id"], F.lit(False))
        ahead = same & (smaller | (F.col("id").eqNullSafe(F.lit(last["id"])) & (F.col("row") <= last["row"])))
    drawn = (F.col("n_words") >= least_words) & ((F.col("score") > last["score"]) | ahead)
    ranked = numbered(rows.where(drawn), order, "rank")
    rest = rows.where(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*named, "rank").unionByName(rest.select(*named, "rank"))
