"""Exact duplicates by content sort, in DataFrame operations only.

Splitters sampled from the texts range-partition the rows by normalised content; each range is sorted by its task,
spilling where it must, so that equal texts are neighbours and each is compared in full with the one before it. A
splitter holds the first characters of a text and a hash of the row's identifier, so that a group of copies that
outgrows a range is spread over several. Only the texts that a splitter cuts through can have copies in more than one
range: one head per range and text is then grouped by whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graticule.llm.common import ascii_lower, stored

PREFIX = 64
RANGES_PER_PARTITION = 3
SAMPLES_PER_RANGE = 32
INNER = "__in"


def sort_key(text: Column, row_hash: Column) -> Column:
    """Orders rows by the start of the normalised text, then by hash. Fixed-width hexadecimal keeps byte order."""
    return F.concat(prefix_mark(text), F.lpad(F.hex(row_hash), 16, "0"))


def prefix_mark(text: Column) -> Column:
    return F.concat(ascii_lower(F.substring(text, 1, PREFIX)), F.lit("\x00"))


def splitters(keys: DataFrame, ranges: int) -> list[str]:
    """At most ``ranges - 1`` ascending keys that cut the rows into about equal ranges, from a bounded sample."""
    rows = keys.count()
    if rows == 0 or ranges < 2:
        return []
    sample = keys.sample(min(1.0, SAMPLES_PER_RANGE * ranges / rows), seed=7)
    tiles = sample.withColumn("tile", F.ntile(ranges).over(Window.orderBy("key")))
    cuts = tiles.groupBy("tile").agg(F.min("key").alias("key")).where("tile > 1").select("key").distinct()
    return sorted((r["key"] for r in cuts.collect()), key=lambda k: k.encode())


def range_of(key: Column, cuts: list[str]) -> tuple[Column, Column, Column]:
    """The number of cuts at or below the key, found by halving, and the cuts around the key (NULL at the ends)."""
    if not cuts:
        return F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string")
    held = F.array(*[F.lit(c) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def advance(low: Column, step: Column) -> Column:
        fits = low + step <= F.lit(len(cuts))
        return F.when(fits, F.when(F.get(held, low + step - 1) <= key, low + step).otherwise(low)).otherwise(low)

    bucket = F.aggregate(steps, F.lit(0), advance)
    return bucket, F.get(held, bucket - 1), F.get(held, bucket)


def sorted_runs(docs: DataFrame, doc_id: str, text: str, keep_largest: bool) -> DataFrame:
    """The rows of ``docs``, nested in one column, in content order.

    Adds ``norm``; ``bucket`` and ``run``, which number the stretch of equal neighbours; ``head``, true for the row of
    the stretch that stays; and ``cut``, true where the same text may also occur in another range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(INNER))
    content = F.coalesce(F.col(INNER)[text].cast("string"), F.lit(""))
    key = sort_key(content, F.xxhash64(F.col(INNER)[doc_id]))
    cuts = splitters(rows.select(key.alias("key")), RANGES_PER_PARTITION * parts)
    keyed = rows.withColumn("key", key).withColumn("mark", prefix_mark(content))
    bucket, below, above = range_of(F.col("key"), cuts)
    cut = F.coalesce(below.startswith(F.col("mark")), F.lit(False)) | F.coalesce(above.startswith(F.col("mark")), F.lit(False))
    dealt = keyed.select(INNER, bucket.alias("bucket"), cut.alias("cut")).repartition("bucket")
    order = F.col(INNER)[doc_id]
    neighbours = Window.partitionBy("bucket").orderBy("norm", order.desc_nulls_last() if keep_largest else order.asc_nulls_last())
    return (
        dealt.withColumn("norm", ascii_lower(content))
        .withColumn("head", ~F.lag("norm").over(neighbours).eqNullSafe(F.col("norm")))
        .withColumn("run", F.sum(F.col("head").cast("int")).over(neighbours.rowsBetween(Window.unboundedPreceding, 0)))
    )


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_largest: bool = False) -> DataFrame:
    """One row per input row: the identifier, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after lower-casing A to Z; a missing text is empty, and all empty texts are equal.
    The row with the smallest identifier of its group stays (the largest with ``keep_largest``); a missing identifier
    comes last, and of rows that share an identifier and a text exactly one stays. Other columns, whatever their
    names, are ignored. An empty table gives an empty result. Sampling and the sorted rows run as jobs at once.
    """
    best = F.max if keep_largest else F.min
    runs = sorted_runs(docs.select(F.col(doc_id), F.col(text)), doc_id, text, keep_largest)
    alike = Window.partitionBy("bucket", "run")
    rows = stored(
        runs.select(
            F.col(INNER)[doc_id].alias("id"), "bucket", "run", "head", F.sha2(F.col("norm"), 256).alias("sha"),
            F.when(F.col("head") & F.col("cut"), F.col("norm")).alias("cut_text"),
        ).withColumns({"best": best("id").over(alike), "rows": F.count("*").over(alike)}),
        "exactdup",
    )
    across = Window.partitionBy("cut_text")
    first = F.col("best").desc_nulls_last() if keep_largest else F.col("best").asc_nulls_last()
    joined = rows.where("cut_text is not null").select(
        F.col("bucket").alias("b"), F.col("run").alias("r"), best("best").over(across).alias("all_best"),
        F.sum("rows").over(across).alias("all_rows"), (F.row_number().over(across.orderBy(first, "bucket")) == 1).alias("wins"),
    )
    return rows.join(joined, (F.col("bucket") == F.col("b")) & (F.col("run") == F.col("r")), "left").select(
        F.col("id").alias(doc_id), F.when(F.col("b").isNull(), F.col("best")).otherwise(F.col("all_best")).alias("keep_id"),
        F.coalesce("all_rows", "rows").cast("long").alias("group_size"),
        (F.col("head") & F.coalesce("wins", F.lit(True))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_largest: bool = False) -> DataFrame:
    """The rows of ``docs`` that ``groups`` keeps, with all their columns. The texts are shuffled once."""
    runs = stored(
        sorted_runs(docs, doc_id, text, keep_largest).where("head")
        .select(INNER, "bucket", "run", F.when(F.col("cut"), F.col("norm")).alias("cut_text")),
        "exactdup-heads",
    )
    best = F.col(INNER)[doc_id]
    rank = F.row_number().over(Window.partitionBy("cut_text").orderBy(best.desc_nulls_last() if keep_largest else best.asc_nulls_last(), "bucket"))
    lost = runs.where("cut_text is not null").withColumn("rank", rank).where("rank > 1").select("bucket", "run")
    return runs.join(lost, ["bucket", "run"], "left_anti").select(*[F.col(INNER)[c].alias(c) for c in docs.columns])
