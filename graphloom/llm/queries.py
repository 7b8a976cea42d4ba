"""The registered queries of the corpus operators: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, language_id, license_scan, lm_scoring, mixing, near_dedup, resampling, secret_scan, sql, token_output, topk_search, toxicity, url_filter, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_index(_table(spark, sf_dir, "documents"), tokenizer_path())


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start_word", "hamming", "similarity")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories are pairs of source and language, owners are sources: the tables name no others."""
    return secret_scan.scan_digest(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), license_scan.template_table(spark))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), size=3, percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"))


def repeated_urls(pages: DataFrame) -> DataFrame:
    """A list for want of one among the tables: the canonical URLs that more than one page has."""
    url = url_filter.canonical(F.col("url"))
    return pages.groupBy(url.alias("c")).agg(F.count("*").alias("n"), F.min("url").alias("url")).where("n > 1 and c is not null").select("url")


def op10_url_filter(spark: SparkSession, sf_dir: str, listed: DataFrame | None = None) -> DataFrame:
    """listed: DataFrame with column url; repeated_urls() by default."""
    pages = _table(spark, sf_dir, "pages")
    found = url_filter.judge(pages, repeated_urls(pages) if listed is None else listed)
    return found.select("page_id", "host", "path", "rule", "verdict", "listed")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_held_out(_table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings"), 4)
    each = rows.select("vec_id", "n", "deviation", "identity_error", "explained", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.get("explained", F.col("i")).alias("explained"), "identity_error")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


def secret_scan_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op6_secret_scan SQL can express."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op9_lm_scoring SQL can express, to six decimals."""
    return op9_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 6).alias("base_score"))


def embedding_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op12_embedding_whitening SQL can express."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"), 1).select("vec_id", "n", "deviation")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_toxicity": op2_toxicity,
    "op3_token_output": op3_token_output,
    "op4_topk_search": op4_topk_search,
    "op5_decontamination": op5_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_license_scan": op7_license_scan,
    "op8_near_dedup": op8_near_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_url_filter": op10_url_filter,
    "op11_language_id": op11_language_id,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_importance_resampling": op13_importance_resampling,
    "secret_scan_base": secret_scan_base,
    "lm_base_scores": lm_base_scores,
    "embedding_deviations": embedding_deviations,
}

SQL: dict[str, str] = {
    "op1_mix_sources": mixing.SQL,
    "op4_topk_search": topk_search.SQL,
    "op8_near_dedup": sql.NEAR_DEDUP,
    "op10_url_filter": sql.URL_FILTER,
    "op11_language_id": language_id.SQL,
    "op13_importance_resampling": resampling.SQL,
    "secret_scan_base": sql.SECRET_BASE,
    "lm_base_scores": sql.LM_BASE,
    "embedding_deviations": sql.DEVIATIONS,
}
