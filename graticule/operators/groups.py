"""Attaching per-group facts to rows, and cutting lineage.

A fact table has one row per group, so its size grows with the number of datasets, variables or time steps. It is
broadcast only after it has been counted. Beyond the bound the rows are joined on the group and a salt, so that a
group holding a large share of all rows is spread over many tasks.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
WIDE_BYTES = 256  # of a value that is not a number, about
NARROW = {"byte", "short", "integer", "long", "float", "double", "boolean", "date", "timestamp", "timestamp_ntz"}
SHARES = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it. Only a local session falls back to a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):  # local-cluster has executors with folders of their own
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="graticule-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    context.setCheckpointDir(made)
    return made


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes a small table to the shared folder, so that it is computed once and survives the loss of an executor.

    Runs a job at once, as do all that call it: ``attach``, ``steps_at``, ``time_slice``, ``select_variable``, grouped
    ``extremes`` and ``hotspot``, and the pages. The files go with the session's references if
    spark.cleaner.referenceTracking.cleanCheckpoints is set, and with the driver where the folder is its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def fits(facts: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a table whose lineage is cut may be broadcast: by its count, and by the bytes that so many rows take."""
    width = sum(f.dataType.jsonValue() in NARROW and 8 or WIDE_BYTES for f in facts.schema)
    return facts.count() <= min(rows, BROADCAST_BYTES // width)


def broadcast_if_small(facts: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Marks a table whose lineage is cut for broadcast when it is within the bound; else leaves it to a shuffle."""
    return F.broadcast(facts) if fits(facts, rows) else facts


def attach(
    df: DataFrame,
    facts: DataFrame,
    by: Sequence[str],
    spread: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
    how: str = "inner",
) -> DataFrame:
    """Adds the columns of ``facts``, which has one row per ``by`` group, to every row of ``df``.

    Without keys the single row of facts is read as a scalar subquery: no join takes place. Facts beyond the bound are
    joined on the group. Only groups that hold more than their share of all rows are dealt by the hash of ``spread``
    as well, each over as many parts as it has shares, and only their facts are copied. Runs a job to write the facts,
    and counts the rows of each group if they are beyond the bound.
    """
    new = [c for c in facts.columns if c not in by]
    if not by:
        row = facts.select(F.struct(*new).alias("facts")).scalar()
        return df.withColumn("__facts", row).select(*df.columns, *[F.col("__facts")[c].alias(c) for c in new])

    facts = cut_lineage(facts)
    keyed = facts.withColumnsRenamed({c: f"__by_{c}" for c in by})
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    if fits(facts, broadcast_rows):
        joined = df.join(F.broadcast(keyed), same, how)
    else:
        counts = cut_lineage(df.groupBy(*by).agg(F.count("*").alias("__n")))
        share = max(1, (counts.agg(F.sum("__n")).first()[0] or 0) // SHARES)
        large = counts.where(F.col("__n") > share)  # fewer than SHARES groups, whatever the table holds
        parts = large.select(*[F.col(c).alias(f"__big_{c}") for c in by], F.ceil(F.col("__n") / share).cast("int").alias("__parts"))
        big = [F.col(c).eqNullSafe(F.col(f"__big_{c}")) for c in by]
        big_facts = [F.col(f"__by_{c}").eqNullSafe(F.col(f"__big_{c}")) for c in by]
        own = F.pmod(F.xxhash64(*spread), F.coalesce("__parts", F.lit(1))).cast("int")
        dealt = df.join(F.broadcast(parts), big, "left").withColumn("__salt", own)
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
        copied = keyed.join(F.broadcast(parts), big_facts, "left").select(*keyed.columns, copies.alias("__by_salt"))
        joined = dealt.join(copied, [*same, F.col("__salt") == F.col("__by_salt")], how)
    return joined.select(*df.columns, *new)
