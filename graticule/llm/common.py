"""What the text operators share: reading tables, storing intermediate tables, and iterating over text columns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graticule.operators.groups import shared_dir
from graticule.shipping import ship

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEPT: list = []  # the functions of which a worker keeps results


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names in spark.checkpoint.dir, as a qualified URI."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes a table to the shared folder and returns it reread: lineage ends there, and lost executors cost nothing.

    Runs a job at once. The files stay until the shared folder is cleaned, since the result is read lazily.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have, in any spelling."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str) -> Column:
    """The text, where a missing one counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z only. A text of single-byte characters takes the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def crc_bucket(column: str, parts: int) -> Column:
    """crc32 of the value as text, modulo ``parts``; a missing value counts as an empty one."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(parts))


def kept_by_worker(maxsize: int) -> Callable[[Callable], Callable]:
    """``lru_cache`` for what a Python worker keeps from task to task, until it runs a task of another module."""

    def wrapped(make: Callable) -> Callable:
        KEPT.append(lru_cache(maxsize=maxsize)(make))
        return KEPT[-1]

    return wrapped


def release(owner: str) -> None:
    """Drops what modules other than ``owner`` keep: a worker outlives the stage that started it."""
    for held in KEPT:
        if held.__module__ != owner:
            held.cache_clear()


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow``, with this package at hand wherever the tasks run, and with room in the workers: they first drop what
    other operators keep."""
    ship(df.sparkSession)
    owner = run.__module__

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(owner)
        yield from run(batches)

    return df.mapInArrow(alone, schema)


def small_batches(batches: Iterable[pa.RecordBatch], column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts record batches where ``column`` would exceed ``most_bytes``; a longer single value is a batch by itself."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > most_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(sizes):
            yield batch.slice(start)
