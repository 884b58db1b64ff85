"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import exact_groups
from .lm import lm_scores
from .media import media_features
from .mixing import graded, mixed
from .near_dedup import near_groups
from .packing import packed
from .pii import pii_spans
from .quality import quality_scores
from .sharding import stratified_shards
from .toxicity import toxicity_scores


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(_docs(spark, sf_dir))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_spans(_docs(spark, sf_dir))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_shards(_docs(spark, sf_dir))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_docs(spark, sf_dir))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_docs(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_docs(spark, sf_dir), graded)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_docs(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(_docs(spark, sf_dir), size=2, percent=80)


QUERIES = {
    "op1_media": op1_media,
    "op2_pii": op2_pii,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_lm": op5_lm,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_near_dedup": op10_near_dedup,
}

ORACLE_SQL = {
    "op6_exact_dedup": """
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
             g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
        FROM n JOIN g ON n.t = g.t
    """,
}
