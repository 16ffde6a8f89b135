"""The contract queries of the training-data operators: thin digests of the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, imatch, jaccard, linear, mixing, packing, passages, secrets, warc
from ._common import table, tokenizer_path


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2(secrets.joined(F.col("base")), 256)).drop("base")


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("group_id")


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_neighbours(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(table(spark, sf_dir, "documents"))


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = linear.quality_model(docs, table(spark, sf_dir, "labels"))
    return linear.quality(docs, model, ["doc_id"]).withColumn("keep", F.col("p1") >= KEEP)


#: A document stays in the corpus if grade 1 or better has at least this probability.
KEEP = 0.3


def weighted_sizes(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, the columns ``keep`` and the quality weight: 2 for rated good, 0.5 for rated poor, 1 for unrated."""
    rated = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_q"))
    sized = docs.select("doc_id", "source", mixing.words(F.col("text")).alias("size"), *keep)
    return sized.join(rated, "doc_id", "left").select("doc_id", "source", "size", F.coalesce(F.when(F.col("_q") > 0, 2.0).when(F.col("_q") == 0, 0.5), F.lit(1.0)).alias("weight"), *keep)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = weighted_sizes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rest = F.crc32(F.col("doc_id").cast("string")) % 3
    model = linear.toxicity_model(docs, labels, rest != 1)
    scored = linear.toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(rest == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()}


#: The mixing query as SQL for DuckDB.
MIX_SQL = """
with rated as (select doc_id, max(quality) as q from labels where doc_id is not null group by doc_id),
d as (select t.doc_id, t.source, coalesce(len(regexp_extract_all(t.text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
  case when q > 0 then 2.0 when q = 0 then 0.5 else 1.0 end::double as w,
  (('0x' || substr(md5(coalesce(t.doc_id::varchar, 'null') || ':mix-1'), 1, 13))::bigint::double + 0.5) / pow(2, 52) as u
  from {docs} t left join rated using (doc_id)),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source asc nulls last) - 1) % 3 as r,
  row_number() over (order by source asc nulls last) as rk from d group by source),
c as (select *, case r when 0 then 3.0 when 1 then 1.0 else 2.0 end::double as weight, source_size * 2.0::double as cap from s),
l as (select *, cap / weight as ratio,
  (sum(source_size) over () * 1.5::double - coalesce(sum(cap) over (order by cap / weight, rk rows between unbounded preceding and 1 preceding), 0.0))
   / sum(weight) over (order by cap / weight, rk rows between current row and unbounded following) as level from c),
t as (select source, source_size, least(cap, weight * (max(case when level <= ratio then level end) over ())) as target from l),
e as (select *, least(floor(target / greatest(source_size, 1)), 2) as epochs, target - least(floor(target / greatest(source_size, 1)), 2) * source_size as rest from t),
p as (select d.doc_id, d.size, e.*exclude (source), coalesce(sum(d.size) over (partition by d.source order by -ln(u) / w, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as before
  from d join e on d.source is not distinct from e.source)
select doc_id, size, source_size, target::double as target,
  (size * (epochs + case when rest - before >= size / 2.0 and size > 0 and rest > 0 and epochs < 2 then 1 else 0 end))::bigint as taken from p
"""


def oracle_sql() -> dict[str, str]:
    return {"op7_source_mixing": MIX_SQL.format(docs="documents"), "op9_warc": WARC_SQL}


#: The archive query as SQL for DuckDB.
WARC_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as h from pages),
f as (select h, min(page_id) as first from p where n >= 100 group by h)
select page_id, n::bigint as payload_bytes, h as payload_digest,
  case when n >= 100 and page_id > first then 'revisit' else 'response' end as record_type,
  case when n >= 100 and page_id > first then first end as refers_to
from p left join f using (h)
"""
