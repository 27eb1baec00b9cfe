"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracles import ORACLE_SQL  # noqa: F401


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _fold(column: str, n: int):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language

    docs = _table(spark, sf_dir, "documents")
    held = _fold("doc_id", 4) == 2
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs, ~held))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score", "runner_up", "ambiguous")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets

    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import passages

    return passages.find(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    docs = _table(spark, sf_dir, "documents")
    held = _fold("doc_id", 5) == 0
    found = toxicity.score(docs, *toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~held))
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", "predicted", "vote", "nearest_id", "nearest_similarity")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    docs = _table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_lm

    found = ngram_lm.score(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_prob", 3).alias("log_prob"), F.round("score", 6).alias("score"), "n_backoff")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer(), with_ids=False)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urls

    return urls.judge(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    found = decontam.find_contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_secret_scan, op3_substring_dedup, op4_toxicity, op5_quality_rules, op6_jaccard_join, op7_lm_scoring, op8_packing, op9_url_filter, op10_decontamination)}
