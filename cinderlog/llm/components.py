"""Connected components by joins: hooking to smaller parents and halving of paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlog.session import materialise

MOST_TURNS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b): the least node each reaches.

    Each turn a node offers its neighbours and their parents its grandparent, and
    everyone takes the least offer; chains shorten by half, so turns grow with the
    logarithm of the longest one. Loops and repeated edges do no harm.
    """
    both = edges.where("a <> b").select("a", "b")
    both = materialise(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("parent")
    )
    parents = materialise(parents, "parents")
    before = None
    for _ in range(MOST_TURNS):
        grand = parents.join(
            parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand")), "parent"
        ).select("node", "parent", "grand")
        offers = (
            both.join(grand.select(F.col("node").alias("b"), "grand"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("grand").alias("offer"))
        )
        known = grand.join(offers, "node")
        best = F.least("grand", "offer")
        taken = known.select("node", best.alias("parent")).unionByName(
            known.select(F.col("parent").alias("node"), best.alias("parent"))
        )
        parents = materialise(taken.groupBy("node").agg(F.min("parent").alias("parent")), "parents")
        now = parents.agg(F.count("*"), F.sum(F.col("parent").cast("decimal(38,0)"))).first()
        if now == before:
            return parents.select("node", F.col("parent").alias("component"))
        before = now
    raise RuntimeError("components did not settle")
