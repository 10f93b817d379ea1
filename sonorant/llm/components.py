"""Distributed connected components by alternating large-star and small-star rounds.

Every round is a map-side combined minimum per node and an equi-join, so a node with a third of all links is no single
task: the minimum is pre-aggregated and the join is one that adaptive execution may split. Links, components and nodes
stay in tables; the driver only reads one number per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step over links (a > b)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a")
    return small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a > b").distinct()


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): of every node in links (a long, b long), the least node that it reaches.

    Self-links and nulls are dropped, direction and repeats don't matter; no links give no rows. Stops when a round
    changes nothing, which is when every node links to its component's least node alone.
    """
    now = materialize(
        links.where("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b")).distinct(), "links"
    )
    seen = None
    for _ in range(most_rounds):
        now = materialize(_round(now), "links")
        # A star forest is a fixed point; count and checksum tell it apart from any other state of the rounds.
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
