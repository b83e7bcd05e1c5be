"""Near duplicates by DartMinHash signatures and banded joining.

Every shingle owns a strip of the weight axis, as wide as its weight, and darts hit the strip at the times of a Poisson
process that depends on the shingle alone. Each dart falls on one coordinate of the signature; the earliest dart of a
coordinate is its value, so that two texts agree on a coordinate with the probability of their weighted similarity. Only
the first darts are ever thrown: about k log k + 2k a text, however many shingles it has.

Texts that agree on a whole band of coordinates share a bucket. Buckets are not expanded into pairs: their members are
compared with the members that collide most often; then whatever these links leave in different classes of a bucket is
compared as well, in blocks. Every link is checked on the full shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.llm.common import free_name, kept_by_worker, mapped, small_batches, stored
from graticule.shipping import ship

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 38, 6  # a pair of similarity 0.8 shares no band once in 100,000 cases, one of 0.2 some band in 400
HUB_BLOCKS = ((1, 1), (2, 4), (5, 16))  # ranks of the members that the others are compared with, by round
MOST_UNLIKE = 44  # of the sketch's bits; a pair of similarity 0.8 differs in more once in 100,000 cases
BLOCK = 512
SETS_AT_ONCE = 512  # sets for which darts are held at once, about 1,700 for a set of any size
SALTS = 32
KNOWN_WORDS = 300_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser of the splitmix kind."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@kept_by_worker(maxsize=1)
def known_words() -> dict[str, int]:
    """Hashes of words, kept by a worker from task to task."""
    return {}


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """The hashes of each text's runs of ``words`` lower-cased words, with repeats. A shorter text is one run."""
    split = [t.lower().split() for t in texts]
    known = known_words()
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in {w for ws in split for w in ws} - known.keys():
        known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
    found = []
    for ws in split:
        h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
        span = min(words, len(ws))
        total = np.full(max(0, len(h) - span + 1) if span else 0, span, np.uint64)
        factor = GOLDEN
        for i in range(span):
            total += h[i : len(h) - span + 1 + i] * factor
            factor = np.uint64((int(factor) * 0xD1342543DE82EF95 + 2) % 2**64 | 1)
        found.append(mixed(total))
    return found


def dart_signatures(sets: list[np.ndarray], weights: list[np.ndarray], size: int) -> np.ndarray:
    """Signatures (set, coordinate) of weighted sets of 64-bit elements. Sets must not be empty, nor weights zero."""
    signature = np.zeros((len(sets), size), np.uint64)
    reach = (size * math.log(size) + 2 * size) / np.array([w.sum() for w in weights])
    for start in range(0, len(sets), SETS_AT_ONCE):
        todo = np.arange(start, min(start + SETS_AT_ONCE, len(sets)))
        while len(todo):
            filled = throw(sets, weights, todo, reach, size, signature)
            todo = todo[~filled]
            reach[todo] *= 2  # a coordinate without a dart: throw for twice as long
    return signature


def throw(sets: list, weights: list, todo: np.ndarray, reach: np.ndarray, size: int, signature: np.ndarray) -> np.ndarray:
    """Throws all darts up to each set's ``reach``, writes the earliest of each coordinate, and says which sets are full."""
    element = np.concatenate([sets[i] for i in todo])
    weight = np.concatenate([weights[i] for i in todo])
    owner = np.repeat(np.arange(len(todo)), [len(sets[i]) for i in todo])
    strips = np.ceil(weight).astype(np.int64)
    strip = np.arange(strips.sum()) - np.repeat(np.cumsum(strips) - strips, strips)
    width = np.minimum(1.0, np.repeat(weight, strips) - strip)
    owner = np.repeat(owner, strips)
    seed = mixed(np.repeat(element, strips) + mixed(strip.astype(np.uint64) + np.uint64(1)) * GOLDEN)
    limit, time = reach[todo][owner], np.zeros(len(seed))
    hits = []
    while len(seed):
        seed = mixed(seed + GOLDEN)
        time = time - np.log1p(-(seed >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        going = time <= limit
        seed, time, limit, owner, width = (x[going] for x in (seed, time, limit, owner, width))
        value = mixed(seed ^ np.uint64(0x5851F42D4C957F2D))
        inside = (mixed(value) >> np.uint64(11)).astype(np.float64) * 2.0**-53 < width
        hits.append((owner[inside] * size + (value[inside] % np.uint64(size)).astype(np.int64), time[inside], value[inside]))
    place, time, value = (np.concatenate(x) for x in zip(*hits))
    earliest = np.full(len(todo) * size, np.inf)
    np.minimum.at(earliest, place, time)
    first = time == earliest[place]
    flat = np.zeros(len(todo) * size, np.uint64)
    flat[place[first]] = value[first]
    signature[todo] = flat.reshape(-1, size)
    return np.isfinite(earliest).reshape(-1, size).all(axis=1)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each band, which tells the bands apart."""
    key = np.tile(np.arange(bands, dtype=np.uint64), (len(signature), 1))
    parts = signature.reshape(len(signature), bands, rows)
    for r in range(rows):
        key = mixed(key + parts[:, :, r] + GOLDEN)
    return key.view(np.int64)


def sketches(signature: np.ndarray) -> np.ndarray:
    """One bit of every coordinate, in four 64-bit words. Two texts differ in half the bits that they disagree on."""
    bits = np.zeros((len(signature), 256), np.uint8)
    bits[:, : signature.shape[1]] = (mixed(signature[:, :256]) & np.uint64(1)).astype(np.uint8)
    return np.packbits(bits, axis=1).view(np.int64)


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, weight: str = "binary") -> DataFrame:
    """For rows (id, text): ``content``, a 128-bit hash of the shingle set, ``n`` shingles, the keys of the ``bands`` and
    the ``sketch``. Texts without a word have NULL content and no bands. With ``weight`` "count" a shingle weighs as often as it occurs.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            runs = [np.unique(s, return_counts=True) for s in shingles([t or "" for t in batch.column("text").to_pylist()], words)]
            some = [i for i, (s, _) in enumerate(runs) if len(s)]
            sets = [runs[i][0] for i in some]
            counts = [runs[i][1].astype(np.float64) if weight == "count" else np.ones(len(runs[i][0])) for i in some]
            keys: list = [None] * len(runs)
            content: list = [None] * len(runs)
            sketch: list = [None] * len(runs)
            if some:
                signature = dart_signatures(sets, counts, bands * rows)
                for i, s, c, k, bits in zip(some, sets, counts, band_keys(signature, bands, rows), sketches(signature)):
                    keys[i], sketch[i] = k, bits
                    content[i] = xxhash.xxh3_128_digest(s.tobytes() + (c.tobytes() if weight == "count" else b""))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(content, pa.binary()), pa.array([len(s) for s, _ in runs], pa.int64()), *(pa.array(x, pa.list_(pa.int64())) for x in (keys, sketch))],
                ["id", "content", "n", "bands", "sketch"],
            )

    return mapped(docs, run, f"id {kind}, content binary, n long, bands array<long>, sketch array<long>")


def shingle_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """For rows (id, text): the distinct shingles, 32 bits of each hash."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            found = [np.unique(s.astype(np.uint32)).view(np.int32) for s in shingles([t or "" for t in batch.column("text").to_pylist()], words)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.int32()))], ["id", "shingles"])

    return mapped(docs, run, f"id {kind}, shingles array<int>")


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the given Jaccard similarity."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    alike = pairs.join(left, "a").join(right, "b").withColumn("common", common)
    return alike.where(F.col("common") >= similarity * (F.size("left") + F.size("right") - F.col("common")) - 1e-9).select("a", "b")


def hubs(members: DataFrame, most: int) -> DataFrame:
    """The ``most`` members of each bucket that collide most often, with their rank. First within salted parts of a
    bucket, then among what is left of these: no task ranks a whole large bucket."""
    best = [F.col("degree").desc(), F.col("id")]
    salted = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    part = salted.withColumn("rank", F.row_number().over(Window.partitionBy("key", "salt").orderBy(*best))).where(F.col("rank") <= most)
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*best))).where(F.col("rank") <= most)
    return as_hubs(ranked, "rank")


def as_hubs(members: DataFrame, *more: str) -> DataFrame:
    return members.select("key", F.col("id").alias("hub"), F.col("n").alias("hub_n"), *[F.col(f"s{k}").alias(f"hub_s{k}") for k in range(4)], *more)


def links(signatures: DataFrame, docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """Edges (a, b) from the smallest identifier of each class to its other texts."""
    return spokes(linked(signatures, docs, similarity, words))


def spokes(label: DataFrame) -> DataFrame:
    return label.where("id <> class").select(F.col("class").alias("a"), F.col("id").alias("b"))


def linked(signatures: DataFrame, docs: DataFrame, similarity: float, words: int) -> DataFrame:
    """The classes (id, class) that verified links connect, of texts that have any; one text stands for all with its
    shingle set. Links found in blocks are added to the classes known before, not to the links that made these."""
    rows = signatures.select("id", "n", F.explode("bands").alias("key"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = stored(rows.join(sizes, "key"), "neardup-shared")
    sketch = signatures.select("id", *[F.col("sketch")[k].alias(f"s{k}") for k in range(4)])
    degree = shared.groupBy("id").agg(F.sum(F.col("size") - 1).alias("degree"))
    members = stored(shared.join(degree.join(sketch, "id"), "id"), "neardup-members")
    # A merge join at every size: what is shuffled then grows with the input, not by steps.
    wanted = members.select("id").distinct().hint("merge")
    sets = stored(shingle_sets(docs.join(wanted, "id", "left_semi"), words), "neardup-sets")
    ranked = stored(hubs(members, HUB_BLOCKS[-1][1]), "neardup-hubs")
    close = F.least("n", "hub_n") >= similarity * F.greatest("n", "hub_n") - 1e-9
    if similarity >= SIMILARITY:
        close &= sum((F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"hub_s{k}"))) for k in range(4)), F.lit(0)) <= MOST_UNLIKE
    open_members, found = members, []
    for low, high in HUB_BLOCKS:
        large = open_members.where(F.col("size") >= low)
        if large.isEmpty():
            break
        tried = large.join(ranked.where(F.col("rank").between(low, high)), "key").where((F.col("id") != F.col("hub")) & close)
        tried = tried.select("key", "id", F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))
        good = stored(verified(stored(tried.select("a", "b").distinct(), "neardup-pairs"), sets, similarity), "neardup-links")
        found.append(good)
        done = tried.join(good, ["a", "b"]).select("key", "id")
        if low == 1:
            done = done.unionByName(ranked.where("rank = 1").select("key", F.col("hub").alias("id")))
        open_members = stored(large.join(done.distinct(), ["key", "id"], "left_anti"), "neardup-open")
    if not found:
        return members.select("id", F.col("id").alias("class")).where("false")
    label = components(union_of(found).distinct())
    seekers = stored(apart(members, open_members, label), "neardup-apart")
    if seekers.isEmpty():
        return label
    more = stored(met_in_blocks(seekers, members, label, sets, similarity), "neardup-links")
    return label if more.isEmpty() else components(spokes(label).unionByName(more))


def apart(members: DataFrame, open_members: DataFrame, label: DataFrame) -> DataFrame:
    """The members of each bucket outside its largest class: any two of different classes have one of these. Left out are
    the open ones of a bucket no larger than the ranks tried, which have met all its members, and buckets no larger than
    the ranks of the second round, where all have met but those that resemble one hub."""
    large = members.where(F.col("size") > HUB_BLOCKS[:2][-1][1])
    named = large.select("key", "id", "size").join(label, "id", "left").withColumn("class", F.coalesce("class", "id"))
    counts = named.groupBy("key", "class").agg(F.count("*").alias("rows"))
    largest = counts.groupBy("key").agg(F.max(F.struct("rows", "class")).alias("top"), F.count("*").alias("classes"))
    largest = largest.where("classes > 1").select("key", F.col("top.class").alias("main"))
    met = open_members.where(F.col("size") <= HUB_BLOCKS[-1][1]).select("key", "id")
    return named.join(largest, "key").where(F.col("class") != F.col("main")).join(met, ["key", "id"], "left_anti").select("key", "id", "size")


def dealt(seekers: DataFrame, members: DataFrame) -> DataFrame:
    """Which block of a bucket's seekers (x) meets which block of its members (y), as rows (key, id, seeks, x, y). Seekers
    and members fill blocks of about ``BLOCK`` each, so with few seekers the rows grow as the bucket does, and a bucket
    without seekers has none."""
    counts = seekers.groupBy("key").agg(F.count("*").alias("seekers"))
    across, down = F.ceil(F.col("seekers") / BLOCK).cast("int"), F.ceil(F.col("size") / BLOCK).cast("int")

    def place(parts: Column) -> Column:
        return F.pmod(F.xxhash64("id"), parts).cast("int")

    def every(parts: Column) -> Column:
        return F.explode(F.sequence(F.lit(0), parts - 1))

    left = seekers.join(counts, "key").select("key", "id", F.lit(True).alias("seeks"), place(across).alias("x"), every(down).alias("y"))
    right = members.join(counts, "key").select("key", "id", F.lit(False).alias("seeks"), every(across).alias("x"), place(down).alias("y"))
    return left.unionByName(right)


def met_in_blocks(seekers: DataFrame, members: DataFrame, label: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links of members outside the largest class of their bucket with all its other members, unless links connect the
    two already. A task compares a block of seekers with a block of members on the full shingle sets and returns links
    only, so pairs are never rows."""
    labelled = sets.join(label, "id", "left").select("id", F.coalesce("class", "id").alias("class"), "shingles")
    units = dealt(seekers, members).join(labelled, "id")
    kind = dict(members.dtypes)["id"]

    def compare(unit: pa.Table) -> pa.Table:
        seeks = unit.column("seeks").to_numpy()
        ids, names = unit.column("id"), unit.column("class").to_pylist()
        shingles_of = [np.asarray(x, np.int32) for x in unit.column("shingles").to_pylist()]
        there = np.flatnonzero(~seeks)
        size = np.array([len(s) for s in shingles_of], np.int64)
        owner = np.repeat(there, size[there])
        token = np.concatenate([shingles_of[i] for i in there] or [np.zeros(0, np.int32)])
        order = np.argsort(token, kind="stable")
        owner, token = owner[order], token[order]
        found = []
        for i in np.flatnonzero(seeks):
            low = np.searchsorted(token, shingles_of[i], "left")
            count = np.searchsorted(token, shingles_of[i], "right") - low
            at = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=len(size))
            alike = (common > 0) & (common >= similarity * (size + size[i] - common) - 1e-9)
            found.extend((i, j) for j in np.flatnonzero(alike) if names[i] != names[j])
        a, b = (pa.array(x, pa.int64()) for x in (zip(*found) if found else ((), ())))
        return pa.table({"a": ids.take(a), "b": ids.take(b)})

    ship(sets.sparkSession)
    links = units.groupBy("key", "x", "y").applyInArrow(compare, f"a {kind}, b {kind}")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def union_of(tables: list[DataFrame]) -> DataFrame:
    every = tables[0]
    for more in tables[1:]:
        every = every.unionByName(more)
    return every


def components(edges: DataFrame) -> DataFrame:
    """The smallest identifier reachable from each end of the edges (a, b): (id, class). Labels take the smallest of
    their neighbours' and then that label's own label, so that paths halve; every round is a few joins."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "components-edges")
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("class")), "components")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "class"), "b").groupBy(F.col("a").alias("id")).agg(F.min("class").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        jump = lower.select(F.col("id").alias("class"), F.col("class").alias("far"))
        step = lower.join(jump, "class", "left").select("id", "was", F.least("class", F.coalesce("far", "class")).alias("class"))
        new = stored(step, "components")
        if new.where("was <> class").isEmpty():
            return labels
        labels = new.drop("was")


def classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, words: int = WORDS
) -> DataFrame:
    """One row per document: the identifier, ``class_id``, ``n_shingles`` and ``kept``.

    Two texts are linked when their sets of ``words``-word shingles have at least the given Jaccard similarity; a class
    is what links connect, ``class_id`` its smallest identifier, and the document with that identifier stays. Words are
    lower-cased and cut at white space; a text of fewer words is one shingle. A text without words is missing from no
    result: it is a class by itself. Rows that share an identifier are one document, of which all texts count; rows
    without one are classes by themselves, with NULL ``class_id``. Other columns are ignored. Several jobs run at once.
    """
    chosen = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    signs = stored(signed(chosen, words=words), "neardup-signed")
    known = signs.where("content is not null and id is not null")
    first = stored(known.groupBy("content").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "neardup-texts")
    found = linked(first, chosen, similarity, words)
    lead = first.select("content", F.col("id").alias("lead")).join(found.withColumnRenamed("id", "lead"), "lead", "left")
    lead = lead.select("content", F.coalesce("class", "lead").alias("class_id"))
    joined = signs.join(lead, "content", "left")
    class_id: Column = F.coalesce("class_id", "id")
    return joined.select(
        F.col("id").alias(doc_id), F.when(F.col("id").isNotNull(), class_id).alias("class_id"), F.col("n").alias("n_shingles"),
        (F.col("id").isNull() | (F.col("id") == class_id)).alias("kept"),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that ``classes`` keeps: one document of each class, with all its columns, whatever their names.
    Rows without an identifier stay; an empty table gives an empty one."""
    mark = free_name(docs, "dropped")
    dropped = classes(docs, doc_id, text, similarity).where("not kept").select(F.col(doc_id).alias(mark)).distinct()
    return docs.join(dropped, F.col(doc_id) == F.col(mark), "left_anti")
