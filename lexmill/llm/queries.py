"""One thin query per operator: production parameters, whole tables, digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sql
from .alignment import align_tokens
from .common import table
from .langid import predict_languages
from .line_dedup import line_dedup
from .mixing import mix
from .nearest import nearest
from .packing import pack
from .pii import base_only, count_kind, private_report, span_list
from .quality_rules import quality_rules
from .registry import query
from .resampling import importance_weights
from .simhash import hex_digits, simhash_groups
from .spelling import spelling_variants
from .substrings import substring_dedup
from .url_filter import filter_urls


@query("op1_quality_rules", sql.QUALITY_RULES)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@query("op3_nearest_neighbours")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


@query("op4_url_filter", sql.URL_FILTER)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


@query("op5_simhash_groups")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"), width=4, max_bits=4)
    return groups.select("doc_id", hex_digits("fp").alias("fingerprint"), "component_id")


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op7_private_terms")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_report(table(spark, sf_dir, "documents"))
    counts = [count_kind(F.col("spans"), k).alias(f"n_{name}") for k, name in enumerate(("email", "ip", "card", "phone"))]
    return found.select(
        "doc_id", *counts, F.sha2(span_list(base_only(F.col("spans"))), 256).alias("base_sha256"),
        span_list(F.col("spans")).alias("spans"),
    )


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


@query("op9_importance_resampling")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_weights(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op10_source_mix", sql.MIXING)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_spelling_variants", sql.SPELLING)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


@query("op12_line_dedup", sql.LINE_DEDUP)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op13_token_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(table(spark, sf_dir, "documents"))
