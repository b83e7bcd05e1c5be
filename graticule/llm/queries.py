"""One registered query per operator, over its whole table, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graticule.llm import bpe, crosstoken, decontam, exactdup, htmltext, importance, langid, licences, neardup, personal, repeats, toxicity, warc
from graticule.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(run: Query) -> Query:
    REGISTERED[run.__name__] = run
    return run


@query
def op6_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op8_exact_dedup(spark, sf_dir):
    return exactdup.groups(table(spark, sf_dir, "documents"), keep_largest=True)


ORACLE["op8_exact_dedup"] = """
with rows as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id, cast(count(*) over (partition by t) as bigint) as group_size,
       doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from rows
"""


@query
def op9_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, digests_only=True)


@query
def op10_toxicity(spark, sf_dir):
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_dart_minhash(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark, sf_dir):
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_html_text(spark, sf_dir):
    return htmltext.extract(table(spark, sf_dir, "pages"))


@query
def op2_warc(spark, sf_dir):
    return warc.roundtrip(table(spark, sf_dir, "pages"), least_bytes=0)


ORACLE["op2_warc"] = """
with rows as (select page_id, coalesce(html, '') as p from pages),
hashed as (
  select page_id, cast(strlen(p) as bigint) as payload_bytes, sha1(p) as h, min(page_id) over (partition by p) as first from rows
)
select page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + cast((cast('0x' || substr(h, cast(5 * (i // 4) + 1 as int), 5) as bigint) >> (15 - 5 * (i % 4))) & 31 as int), 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to
from hashed
"""


@query
def op7_licences(spark, sf_dir):
    """Documents lie in a directory for each source, with one for each language below."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licences.licences(table(spark, sf_dir, "documents").withColumn("path", path), file_id="doc_id")


@query
def op3_repeats(spark, sf_dir):
    return repeats.remove(table(spark, sf_dir, "documents"))


@query
def op11_importance_resampling(spark, sf_dir):
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# DuckDB has no crc32: the remainder is built bit by bit, for distinct words only.
ORACLE["op11_importance_resampling"] = r"""
with held as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents
),
wanted as (
  select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark
),
source as (select w, count(*) as n from (select unnest(words) as w from held) group by w),
target as (select w, count(*) as n from (select unnest(words) as w from wanted) group by w),
bytes as (select w, hex(encode(w)) as h from (select w from source union select w from target)),
hashed as (
  select w, xor(4294967295::bigint, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(length(h) // 2), lambda i: cast('0x' || substr(h, cast(2 * i + 1 as int), 2) as bigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), cast(range(8) as bigint[])),
      lambda r, k: case when r & 1 = 1 then xor(r >> 1, 3988292384::bigint) else r >> 1 end))) % 10000 as bucket
  from bytes
),
s as (select bucket, sum(n) as s from source join hashed using (w) group by bucket),
t as (select bucket, sum(n) as t from target join hashed using (w) group by bucket),
gains as (
  select bucket, floor(1000 * ln(cast(coalesce(t, 0) + 1 as double) * cast((select coalesce(sum(s), 0) from s) + 10000 as double)
    / (cast(coalesce(s, 0) + 1 as double) * cast((select coalesce(sum(t), 0) from t) + 10000 as double)))) as gain
  from s full join t using (bucket)
),
weights as (
  select doc_id, count(*) as n, cast(floor(sum(gain) / count(*)) as bigint) as weight
  from (select doc_id, unnest(words) as w from held) join hashed using (w) join gains using (bucket) group by doc_id
),
scores as (
  select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double) / 4294967296::double))) as bigint) as score
  from documents left join weights using (doc_id)
),
ordered as (
  select doc_id, row_number() over (order by score desc, doc_id) as place, 10 * count(*) over () // 100 as most from scores where n_features >= 20
)
select doc_id, cast(n_features as bigint) as n_features, weight, score,
       cast(case when place <= most then place end as bigint) as rank
from scores left join ordered using (doc_id)
"""


@query
def op13_token_alignment(spark, sf_dir):
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return crosstoken.alignment_counts(table(spark, sf_dir, "documents"), *paths)


@query
def op12_personal_data(spark, sf_dir):
    return personal.find(table(spark, sf_dir, "documents"))
