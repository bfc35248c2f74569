"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, langid, license_scan, lm_score, media, mixing, near_dedup, substring_dedup, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held = F.coalesce(common.remainder_of_id("doc_id", 5) == 0, F.lit(False))
    got = langid.predict(docs, langid.fit(docs.where(~held)))
    return got.select("doc_id", held.alias("held_out"), "lang_pred", "score", "distance", "rejected")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


OP2_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) q from embeddings
  where vec_id is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
asked as (select distinct vec_id, q from v where vec_id % 50 = 0),
p as (
  select a.vec_id query_id, a.q, b.vec_id, list_dot_product(a.q::double[], b.q::double[])::bigint score
  from asked a join v b on b.vec_id <> a.vec_id and len(a.q) = len(b.q))
select query_id, row_number() over (partition by query_id, q order by score desc, vec_id)::int rank, vec_id, score
from p qualify rank <= 5
"""


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(_table(spark, sf_dir, "documents")).drop("spans")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(_table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(_table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.ToxicityModel:
    return toxicity.fit(docs, _table(spark, sf_dir, "labels").where(~toxicity.held_out()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    got = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return got.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.find(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(_table(spark, sf_dir, "documents"))
    return got.withColumns({c: F.round(c, 6) for c in ("weight", "probability")})


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = media.store_documents(_table(spark, sf_dir, "documents"))
    return media.features(media.read_archives(spark, path))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_exact_topk, op3_license_scan, op4_substring_dedup, op5_bpe, op6_toxicity, op7_near_dedup, op8_mixing, op9_media, op10_lm_score)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_topk": OP2_SQL, "op8_mixing": mixing.oracle()}
