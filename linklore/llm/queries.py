"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chunk_bpe, fixity, language_id, license_rules, minhash_dedup, mixing, multi_index, packing, periodic_runs
from . import quality_rules, resampling, secret_scan, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixity.audit_pages(table(spark, sf_dir, "pages"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op3_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op5_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_rules.recognise(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("text_hash")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.report(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict[str, Query]:
    return {
        "op1_warc_fixity": op1_warc_fixity,
        "op2_source_mixing": op2_source_mixing,
        "op3_multi_index": op3_multi_index,
        "op4_quality_rules": op4_quality_rules,
        "op5_license_rules": op5_license_rules,
        "op6_toxicity": op6_toxicity,
        "op7_packing": op7_packing,
        "op8_minhash_dedup": op8_minhash_dedup,
        "op9_secret_scan": op9_secret_scan,
        "op10_language_id": op10_language_id,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_chunk_bpe": op13_chunk_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_fixity": fixity.AUDIT_SQL, "op5_license_rules": license_rules.recognise_sql(), "op12_importance_resampling": resampling.RESAMPLE_SQL}
