"""Iterative operators over pairs: star clusters, token-linked query blocks, winners and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchlight.operators.pairs import content_tokens
from searchlight.storage import written


def star_clusters(pages: DataFrame, edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """page, primary: the strongest page takes its neighbours, then the strongest one left, and so on.

    pages has page and clicks, edges a and b. In rounds: a page becomes a primary once all its stronger neighbours are
    members; a page is a member once a stronger neighbour is a primary. Each round is a join over edges, and needs no
    global order. Members go to their strongest primary once all are known.
    """
    # A page's strength: clicks, then its name. Compared as one struct, (-clicks, page) ascending.
    strength = pages.select("page", F.struct((-F.coalesce("clicks", F.lit(0)).cast("double")).alias("c"), "page").alias("rank"))
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct()
    links = both.join(strength.select(F.col("page").alias("a"), F.col("rank").alias("rank_a")), "a").join(strength.select(F.col("page").alias("b"), F.col("rank").alias("rank_b")), "b")
    stronger = written(links.where("rank_b < rank_a").select(F.col("a").alias("page"), F.col("b").alias("other"), "rank_b"))
    state = written(strength.select("page", F.lit("open").alias("state")))
    for _ in range(most_rounds):
        seen = stronger.join(state.select(F.col("page").alias("other"), F.col("state").alias("s")), "other")
        verdict = seen.groupBy("page").agg(F.bool_or(F.col("s") == "primary").alias("taken"), F.bool_and(F.col("s") == "member").alias("free"))
        new = F.when(F.col("state") != "open", F.col("state")).when(F.col("taken"), "member").when(F.coalesce("free", F.lit(True)), "primary").otherwise("open")
        state = written(state.join(verdict, "page", "left").select("page", new.alias("state")))
        if state.where("state = 'open'").isEmpty():
            break
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    primary = stronger.join(state.where("state = 'primary'").select(F.col("page").alias("other")), "other").groupBy("page").agg(F.min_by("other", "rank_b").alias("primary"))
    return state.join(primary, "page", "left").select("page", F.when(F.col("state") == "primary", F.col("page")).otherwise(F.col("primary")).alias("primary"))


def query_blocks(queries: DataFrame, least_share: float = 0.4, floor: int = 3, most_rounds: int = 60) -> DataFrame:
    """query, block: queries that share a token are in one block, named by its least query; tokens on too many queries do not link, single queries drop out."""
    tokens = written(queries.select("query").distinct().select("query", F.explode(content_tokens(F.col("query"))).alias("token")))
    n = queries.agg(F.countDistinct("query")).scalar()
    linking = tokens.groupBy("token").agg(F.count("*").alias("df")).where((F.col("df") > 1) & (F.col("df") <= F.greatest(F.lit(floor), F.floor(n * least_share))))
    members = written(tokens.join(linking.select("token"), "token"))
    labels = written(members.select("query").distinct().withColumn("block", F.col("query")))
    for _ in range(most_rounds):
        by_token = members.join(labels, "query").groupBy("token").agg(F.min("block").alias("block"))
        new = written(members.join(by_token, "token").groupBy("query").agg(F.min("block").alias("block")))
        # A label points to a query whose own label may be smaller yet.
        new = written(new.join(new.select(F.col("query").alias("block"), F.col("block").alias("next")), "block", "left").select("query", F.least("block", F.coalesce("next", "block")).alias("block")))
        if new.join(labels, ["query", "block"], "left_anti").isEmpty():
            return new
        labels = new
    raise RuntimeError(f"no end after {most_rounds} rounds")


def cluster_winner(pages: DataFrame, clusters: DataFrame, weights: tuple[float, float, float] = (0.5, 0.3, 0.2)) -> DataFrame:
    """page, primary, score, winner within each cluster, from clicks, trend and position; absent positions count as 100."""
    w = Window.partitionBy("primary")
    position = F.coalesce("avg_position_90d", F.lit(100.0))
    joined = pages.join(clusters, "page")
    clicks = F.col("clicks_window") / F.greatest(F.max("clicks_window").over(w), F.lit(1))
    score = weights[0] * clicks + weights[1] / (1 + F.exp(-F.coalesce("trend_slope", F.lit(0.0)))) + weights[2] * (1 - position / F.greatest(F.max(position).over(w), F.lit(1.0)))
    scored = joined.select("page", "primary", score.alias("score"))
    return scored.withColumn("winner", F.row_number().over(w.orderBy(F.desc("score"), "page")) == 1)
