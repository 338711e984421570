"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexispark.llm.runtime import BROADCAST_ROWS, Stage

MOST_ROUNDS = 60


def components(edges: DataFrame, stage: Stage) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b); the component is its least node.

    Every round points each node's neighbours at the least of them, first at the larger ones, then at the
    smaller ones, and is written out; it ends when the links are stars. Loops and repeated links do no harm;
    rows with a null end are ignored. Links and components stay in tables.
    """
    e = stage.table(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(MOST_ROUNDS):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            stars = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return stage.table(stars.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
        seen, old = now, e
        hint = F.broadcast if now[0] <= BROADCAST_ROWS else lambda df: df  # no more nodes than twice the links just counted
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = stage.table(both.where("v > u").join(hint(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(hint(lowest), "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage.table(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct())
        stage.drop(large, old)
    raise RuntimeError("the components did not settle")
