"""From raw documents to packed sequences: five stages, each a table of its own.

Every stage reads what the one before it kept. The first four return the columns of
``documents``; the last one returns packed pieces. Between stages the documents are
written to the shared folder and read again, so a lost executor costs one stage.

Rows: null, empty and wordless texts fail the quality rules. Rows without an id are
documents of their own; near copies of other documents among them stay, as no id says
which one they are. Rows of one id stand or fall together in the join; repeated rows stay
repeated. Other columns are carried along to the last stage. An empty table gives
empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cinderlog.llm import leaks, lines, packing, quality, sets
from cinderlog.llm.common import table
from cinderlog.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules and the line labels keep."""
    return quality.kept_rows(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeated runs of lines are cut; texts that lose everything go."""
    found = lines.dedup(docs)
    return found.where("n_deleted = 0 OR text <> ''").select(docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id."""
    return sets.first_of_groups(docs, sets.STAGE)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a test item."""
    return leaks.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]

# labelling, retrieval and tokens cannot be put in SQL; tested against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
