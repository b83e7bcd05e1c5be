"""The registered queries: SQL where there is some, and the pipeline stage by stage against plain code."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from texts import awkward, frame

import __spark_entry__ as contract
import corpus_pipeline
from graticule.llm import crosstoken, decontam, importance, personal, queries
from graticule.llm.common import table
from tools.compare import connect, differences

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_against_sql(spark, name):
    assert not differences(spark, connect(SF_DIR), SF_DIR, name)[1]


def test_all_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.REGISTERED)
    assert numbers == list(range(1, max(numbers) + 1)) and "pipeline" in contract.queries()


def shingles(text):
    words = text.lower().split()
    span = min(5, len(words))
    return {tuple(words[k : k + span]) for k in range(len(words) - span + 1)} if span else set()


def test_pipeline_against_plain_code(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, SF_DIR, "documents")
    kept = stages["language_id"](spark, docs, SF_DIR)
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert rows == {r.doc_id: r.text for r in docs.collect() if any(map(str.isalpha, r.text or ""))}

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = {}
    for i, t in rows.items():
        best[t.translate(lower)] = max(best.get(t.translate(lower), i), i)
    rows = {i: rows[i] for i in best.values()}

    sets, parent = {i: shingles(t) for i, t in rows.items()}, {i: i for i in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(rows)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    rows = {i: t for i, t in rows.items() if root(i) == i}

    items = [decontam.normalised(r.text) for r in table(spark, SF_DIR, "benchmark").collect()]
    searched = decontam.Searcher([(k, t) for k, t in enumerate(items)], decontam.ERROR_SHARE)
    rows = {i: t for i, t in rows.items() if not list(searched.search(decontam.normalised(t)))}

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = []
    for i, t in rows.items():
        ids = np.array(library.encode_ordinary(t), "<u4").tobytes()
        wanted.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(wanted)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_bear_awkward_rows(spark, name):
    docs = frame(spark, awkward(random.Random(2)))
    stage = dict(corpus_pipeline.STAGES)[name]
    assert stage(spark, docs, SF_DIR).columns == docs.columns
    assert stage(spark, docs, SF_DIR).count() > 5
    assert stage(spark, docs.where("false"), SF_DIR).count() == 0


def test_stages_bear_columns_of_their_own_names(spark):
    """Extra columns that bear the names which the stages use themselves."""
    docs = table(spark, SF_DIR, "documents")
    clashing = ["__lang_pred", "__score", "lang_pred", "score", "__dropped", "__found", "__FOUND_", "label", "place"]
    docs = docs.select("*", *[F.lit(c).alias(c) for c in clashing])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, SF_DIR)
        assert found.columns == docs.columns, name
        assert {tuple(r) for r in found.select(*clashing).distinct().collect()} == {tuple(clashing)}, name


def test_new_queries_bear_clashing_columns(spark):
    rows = frame(spark, [(1, "one word a@b.cd"), (2, None), (None, "")])
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    extra = rows.select("*", *[F.lit(1).alias(c) for c in ("n_words", "weight", "rank", "pairs", "links", "n_a", "spans", "n_ip", "place")])
    assert importance.resample(extra, table(spark, SF_DIR, "benchmark")).count() == 3
    assert personal.find(extra).count() == 3
    assert crosstoken.alignment_counts(extra, *paths).count() == 3
