"""Connected components of an edge table, by alternating large-star and small-star rounds.

Each round joins every node to the smallest node in reach, so paths shrink by a constant factor and a
few rounds suffice. Groups are reduced by a minimum, which Spark combines before its shuffle, and each
round is written to the shared folder, so the plan stays short and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlight.llm.common import materialised


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round over edges (a, b), a > b: joins the larger (or smaller) neighbours of each node to its least neighbour."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    least = materialised(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m")))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.where("a != b").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for each node of edges (a, b): label is the smallest node of its component. Nulls and loops are ignored."""
    now = materialised(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        now = materialised(_star(_star(now, True), False))
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state or not seen[0]:
            break
        state = seen
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
