"""The corpus pipeline: language identification, exact and near duplicates, benchmark decontamination, encoding.

Each stage calls one text operator and works on all that its predecessor kept. Every stage but the last returns the
columns of the documents; the last returns the digests of the encoded texts.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.llm import bpe, decontam, exactdup, langid, neardup
from graticule.llm.common import free_name, stored, table

LEAST_SCORE = 0.3  # a document whose likeliest language gets less is rejected, as is one without a letter


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the network knows. It learns from the rows that it does not hold out."""
    net = langid.fit(docs, ~langid.held_out())
    own = {c: free_name(docs, c) for c in ("lang_pred", "score")}  # columns of the documents that bear these names
    known = langid.predict(docs.withColumnsRenamed(own), net)
    kept = known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).drop("lang_pred", "score")
    return kept.withColumnsRenamed({new: old for old, new in own.items()})


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest identifier."""
    return exactdup.deduplicate(docs, keep_largest=True)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near duplicates, the one with the smallest identifier."""
    return neardup.deduplicate(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded texts."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, path, public_tokenizers.PATTERN, digests_only=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("byte_bpe", encode_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; what each but the last returns is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
