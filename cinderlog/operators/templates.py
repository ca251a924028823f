"""Distinct sentences (templates), their ids, and the way back to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.operators import joins, ordered


def count_templates(
    rows: DataFrame, sentence: str = "sentence", weight: str | None = None
) -> DataFrame:
    """(sentence, n): combined on the map side, so a frequent template is cheap. Rows
    may stand for ``weight`` lines each."""
    n = F.sum(weight) if weight else F.count("*")
    return rows.groupBy(sentence).agg(n.alias("n"))


def templates(
    rows: DataFrame, sentence: str = "sentence", weight: str | None = None
) -> DataFrame:
    """(template_id, sentence, n): id is the rank from 0 in code-point order."""
    counted = count_templates(rows, sentence, weight).withColumn("_one", F.lit(1).cast("long"))
    ranked = ordered.running_totals(counted, sentence, {"_one": "_rank"})
    return ranked.select(
        (F.col("_rank") - 1).alias("template_id"), F.col(sentence).alias("sentence"), "n"
    )


def template_lookup(
    rows: DataFrame, table: DataFrame, sentence: str = "sentence", **options
) -> DataFrame:
    """Add ``template_id`` to every row. ``keep`` names the columns that are asked for; a
    sentence that is not is neither written nor shuffled. ``written`` rows are read as
    they are (``joins.lookup``)."""
    return joins.lookup_inner(
        rows,
        table.select(F.col("sentence").alias(sentence), "template_id"),
        sentence,
        counts=table.select(F.col("sentence").alias(sentence), F.col("n").alias("_n")),
        **options,
    )


def score_rows(
    rows: DataFrame,
    scores: DataFrame,
    key: str = "template_id",
    counts: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Give every row the score of its template. ``counts`` (key, _n) saves a
    pass over the rows; for ``keep`` and ``written`` see ``template_lookup``."""
    return joins.lookup_inner(rows, scores, key, counts=counts, **options)


def only_in_test(
    test: DataFrame, bank: DataFrame, vector: str = "first", bank_vector: str = "first",
    written: bool = False,
) -> DataFrame:
    """Test templates whose first-token vector equals no bank vector."""
    known = bank.select(F.col(bank_vector).alias(vector))
    return joins.lookup_missing(test, known, vector, written)


def rows_of(
    rows: DataFrame,
    table: DataFrame,
    key: str = "template_id",
    counts: DataFrame | None = None,
    **options,
) -> DataFrame:
    """Rows whose template is in the table."""
    return joins.lookup_inner(rows, table.select(key).distinct(), key, counts=counts, **options)
