"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Store


def _smallest(both: DataFrame) -> DataFrame:
    """Each row's node ``u`` with the smallest of its neighbours; a hot node is split by the join."""
    least = both.groupBy("u").agg(F.min("v").alias("low"))
    return both.join(least, "u").withColumn("m", F.least("u", "low"))


def components(store: Store, edges: DataFrame, label: str) -> DataFrame:
    """(id, comp) for every id in ``edges`` (columns a, b); comp is the smallest id of its component.

    Every step is a partial aggregate and a join, stored before the next, so no component is ever
    gathered. Ends when a round changes nothing (about the logarithm of the longest path).
    """
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current, before, turn = store.table(f"{label}-0", current), None, 0
    while True:
        turn += 1
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _smallest(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = store.table(f"{label}-{turn}a", large.where("u <> v").distinct())
        near = _smallest(large).select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        current = store.table(f"{label}-{turn}", near.where("u <> v").distinct())
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        store.drop(f"{label}-{turn}a", f"{label}-{turn - 1}")
        if mark == before:
            return current.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(
                current.select(F.col("v").alias("id"), F.col("v").alias("comp")).distinct()
            )
        before = mark
