"""One query per operator of the subpackage, as ``query(spark, sf_dir)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialbraid.llm import (
    decontaminate,
    fertility,
    language_id,
    line_dedup,
    ngram_join,
    oracle,
    quality_lm,
    search,
    secrets,
    subword,
    token_counts,
    toxicity,
    turns,
    url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.join_documents(_table(spark, sf_dir, "documents"))
    return joined.select("doc_id", "n_shingles", "component_id")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subword.encode_documents(
        _table(spark, sf_dir, "documents"), ("n_tokens", "ids_sha256", "decoded_sha256")
    )


URL_RULES = [
    url_filter.Rule("allow", "org/"),
    url_filter.Rule("block", "example.org/es/"),
    url_filter.Rule("block", "example.org/en/1"),
    url_filter.Rule("allow", "com/fr/"),
    url_filter.Rule("block", "com/de/"),
]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages that a rule decides are the labelled table for the others."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    ruled = url_filter.with_rule(url_filter.split_urls(pages), URL_RULES)
    labelled = ruled.where("rule IS NOT NULL").selectExpr("host", "path", "rule_verdict AS verdict")
    return url_filter.judge_urls(pages, URL_RULES, url_filter.train(labelled))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return found.selectExpr(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        "sha2(array_join(item_ids, ','), 256) AS items_sha256",
        "contaminated",
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lm.classify_documents(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    ).select("doc_id", "lang", "n_chars", "perplexity", "score", "threshold", "kept")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(_table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        f"sha2({secrets.span_text('base')}, 256) AS base_sha256",
        f"{secrets.span_text('spans')} AS spans",
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = "coalesce(crc32(cast(doc_id AS string)) % 3 = 1, false)"
    learned = docs.where(f"NOT ({held_out})").select("doc_id", "lang", "text")
    found = language_id.predict_language(docs, language_id.training_sample(learned))
    return found.selectExpr("doc_id", f"{held_out} AS held_out", "lang_pred", "score")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge_documents(_table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).selectExpr(
        "doc_id",
        "n_lines",
        "n_deleted",
        "n_deleted_words",
        "emptied",
        "sha2(text, 256) AS text_sha256",
    )


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped (marked absent), emptied, cut, repeated or given to the user, by a checksum."""
    number = "crc32(concat(coalesce(cast(conv_id AS string), ' '), ':', coalesce(cast(turn AS string), ' '))) % 20"
    return conversations.withColumn("damage", F.expr(number)).selectExpr(
        "conv_id",
        "turn",
        "if(damage = 4, 'user', role) AS role",
        "CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(coalesce(text, ' '), '.!?', '') ELSE text END AS text",
        "explode(if(damage = 3, array(false, false), array(damage = 0))) AS absent",
    )


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(damaged(_table(spark, sf_dir, "conversations"))).drop("repaired")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = "coalesce(crc32(cast(doc_id AS string)) % 5 = 0, false)"
    classifier = toxicity.train(docs.where(f"NOT ({held_out})"), _table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, classifier)
    return scored.selectExpr("doc_id", f"{held_out} AS held_out", "score", "predicted")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


LLM_QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_join,
        op2_sentencepiece,
        op3_url_filter,
        op4_decontamination,
        op5_quality_classifier,
        op6_secret_scan,
        op7_token_counts,
        op8_language_id,
        op9_quality_rules,
        op10_line_dedup,
        op11_structure_repair,
        op12_toxicity,
        op13_ranked_search,
    )
}
LLM_ORACLE = {
    "op1_ngram_join": oracle.NGRAM_JOIN,
    "op4_decontamination": oracle.DECONTAMINATION,
    "op11_structure_repair": oracle.STRUCTURE_REPAIR,
    "op13_ranked_search": oracle.RANKED_SEARCH,
}
