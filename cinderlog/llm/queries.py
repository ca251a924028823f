"""The registered queries of the training-data operators: name -> (query, SQL or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from cinderlog.llm import (
    classifier, divergence, language, leaks, lines, oracles, packing, pages, phrases, quality, secrets,
    sets, tokenfile, urls,
)
from cinderlog.llm.common import table
from cinderlog.session import shared_folder


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "token-file")
    tokenfile.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return tokenfile.digest(spark, folder)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sets.jaccard_components(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op3 that SQL can express."""
    return quality.judge(table(spark, sf_dir, "documents"), quality.everything_content()).drop("kept", "content_share")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.train(docs))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return lines.dedup(docs).select("doc_id", "text", "n_deleted")


URL_RULES = [
    "allow com/",
    "block example.com/en/",
    "allow www.example.com/en/",
    "block net/es/",
    "block net/fr/",
]


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classifier.score(docs, classifier.train(docs, table(spark, sf_dir, "labels")))


def op12_phrase_collocation_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


REGISTRY = {
    f.__name__: (f, None)
    for f in (
        op1_token_file,
        op2_ngram_jaccard_join,
        op3_quality_rules,
        op4_secret_scans,
        op5_language_id,
        op6_line_dedup,
        op7_url_filters,
        op8_benchmark_decontamination,
        op9_best_fit_packing,
        op10_html_extraction,
        op11_quality_classifier,
    )
}
REGISTRY["op2_ngram_jaccard_join"] = (op2_ngram_jaccard_join, oracles.JACCARD_COMPONENTS)
REGISTRY["quality_counts"] = (quality_counts, oracles.QUALITY_COUNTS)
REGISTRY["op12_phrase_collocation_mining"] = (op12_phrase_collocation_mining, oracles.PHRASES)
REGISTRY["op13_source_divergence_audit"] = (op13_source_divergence_audit, oracles.SOURCE_DIVERGENCE)
REGISTRY["pipeline"] = (corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)
