"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_pipeline import ORACLE_SQL, run
from winnow.llm import conversation_repair, decontaminate, line_dedup, lm_scores, near_dedup, periodic_runs, pieces, pii, quality, rule_ensemble, store, token_counts, training_order, url_filters


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_documents(spark, sf_dir).select("doc_id", "text"), with_text=False).drop("text")


def op2_spaced_seed_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return token_counts.token_counts(docs, _tokenizer("word_bpe_49k.json")).drop("text")


def op4_unigram_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return pieces.round_trip(docs, _tokenizer("piece_bpe_32k.model")).drop("text")


def op5_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = training_order.training_order(_documents(spark, sf_dir), _tokenizer("piece_bpe_32k.model"))
    return out.drop("folder")  # its name is new in each run


def op6_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.deduplicated(_documents(spark, sf_dir).select("doc_id", "text"))


def op7_bloom_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.scores(_documents(spark, sf_dir))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_documents(spark, sf_dir).select("doc_id", "text"))


def op9_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return url_filters.judge_urls(pages, url_filters.rule_table(spark)).drop("url", "html")


def op10_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.repeated_tails(_documents(spark, sf_dir).select("doc_id", "text"))
    return periodic_runs.run_digests(periodic_runs.periodic_runs(docs))


def op12_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = store.saved(rule_ensemble.with_statistics(_documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    scored = rule_ensemble.quality_scores(measured, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    chunks = conversation_repair.repair(conversation_repair.damaged(conversations))
    return conversation_repair.with_lost(conversation_repair.digests(chunks), conversations)


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_quality, op2_spaced_seed_overlaps, op3_prefix_token_counts, op4_unigram_pieces, op5_training_order, op6_fuzzy_line_dedup,
        op7_bloom_lm_scores, op8_personal_data, op9_url_verdicts, op10_tensored_minhash, op11_periodic_runs, op12_rule_ensemble,
        op13_conversation_repair,
    )
} | {"pipeline": run}
ORACLES = {"op1_line_quality": quality.SQL_OP1, "op9_url_verdicts": url_filters.SQL_OP9, "op10_tensored_minhash": near_dedup.SQL_OP10}
if ORACLE_SQL:
    ORACLES["pipeline"] = ORACLE_SQL
