"""Pages that compete for the same searches: candidate pairs, tests on weekly series, verdicts.

Pairs come from queries that two pages share, never from all pages by all pages. The weekly tests read
only the candidate pages' rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlight.config import OverlapConfig
from searchlight.functions import urls as U
from searchlight.operators import search as S

CFG = OverlapConfig()
# Words that carry no topic.
STOPWORDS = ["the", "a", "an", "of", "for", "to", "in", "on", "and", "or", "is", "are", "with", "my", "your", "best", "top", "free", "online", "near", "me", "how", "what", "why", "when", "where", "who", "can", "do", "does", "vs"]


def content_tokens(query: Column) -> Column:
    """The query's words of two letters or more that carry a topic, each once."""
    words = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(STOPWORDS)))


def shared_query_pairs(universe: DataFrame, cfg: OverlapConfig = CFG) -> DataFrame:
    """a, b, query with both pages' clicks and impressions, a < b; queries on too large a share of pages may be left out."""
    rows = universe
    if cfg.cosine_max_posting_df_fraction < 1:
        pages = universe.agg(F.countDistinct("page")).scalar()
        few = universe.groupBy("query").agg(F.countDistinct("page").alias("df")).where(F.col("df") <= pages * cfg.cosine_max_posting_df_fraction)
        rows = universe.join(few.select("query"), "query", "left_semi")
    a, b = rows.alias("a"), rows.alias("b")
    both = a.join(b, (F.col("a.query") == F.col("b.query")) & (F.col("a.page") < F.col("b.page")))
    return both.select(F.col("a.page").alias("a"), F.col("b.page").alias("b"), F.col("a.query").alias("query"), *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("clicks", "impressions")])


def cosine_pairs(universe: DataFrame, cfg: OverlapConfig = CFG) -> DataFrame:
    """a, b, shared, click_cosine, impression_cosine (both weighted by idf), topic_cosine (impressions alone).

    Norms are over all queries of a page, also those that make no pairs.
    """
    idf = S.query_idf(universe).select("query", "idf")
    weighted = universe.join(idf, "query")
    norms = weighted.groupBy("page").agg(*[F.sqrt(F.sum((F.col(v) * w) ** 2)).alias(n) for n, v, w in (("c", "clicks", F.col("idf")), ("i", "impressions", F.col("idf")), ("t", "impressions", F.lit(1.0)))])
    pairs = shared_query_pairs(universe, cfg).join(idf, "query")
    dots = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum(F.col("clicks_a") * F.col("clicks_b") * F.col("idf") ** 2).alias("dc"), F.sum(F.col("impressions_a") * F.col("impressions_b") * F.col("idf") ** 2).alias("di"), F.sum((F.col("impressions_a") * F.col("impressions_b")).cast("double")).alias("dt"), F.max("idf").alias("best_idf"))
    n = lambda s: norms.select(F.col("page").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in "cit"])
    joined = dots.join(n("a"), "a").join(n("b"), "b")
    cos = lambda d, c: F.coalesce(F.try_divide(F.col(d), F.col(f"{c}_a") * F.col(f"{c}_b")), F.lit(0.0))
    return joined.select("a", "b", "shared", "best_idf", cos("dc", "c").alias("click_cosine"), cos("di", "i").alias("impression_cosine"), cos("dt", "t").alias("topic_cosine"))


def min_topic_idf(cfg: OverlapConfig = CFG) -> Column:
    return F.ln(F.lit(1 / cfg.idf_topic_max_df_fraction))


def shortlist_pairs(universe: DataFrame, cfg: OverlapConfig = CFG) -> DataFrame:
    """a, b, shared, the cosines, accepted, score, reason for pairs without entity data."""
    pairs = cosine_pairs(universe, cfg)
    by_cosine = (F.col("click_cosine") >= cfg.shortlist_min_click_cosine) | (F.col("impression_cosine") >= cfg.shortlist_min_impr_cosine)
    by_topic = F.col("topic_cosine") >= cfg.shortlist_min_topic_profile_sim
    topical = F.col("best_idf") >= min_topic_idf(cfg)
    reason = F.when(~(by_cosine | by_topic), "below every threshold").when(~by_topic & ~topical, "no shared topic query").otherwise("accepted")
    return pairs.withColumn("score", F.greatest("click_cosine", "impression_cosine", "topic_cosine")).withColumn("reason", reason).withColumn("accepted", reason == "accepted").drop("best_idf")


def pairs_per_url_cap(shortlist: DataFrame, cfg: OverlapConfig = CFG) -> DataFrame:
    """Accepted pairs: all strong ones, and of the others those among the best of either page."""
    accepted = shortlist.where("accepted")
    strong = F.col("score") >= cfg.shortlist_min_topic_profile_sim
    ends = accepted.where(~strong).select("a", "b", "score", F.explode(F.array("a", "b")).alias("url"))
    rank = F.row_number().over(Window.partitionBy("url").orderBy(F.desc("score"), "a", "b"))
    kept = ends.withColumn("r", rank).where(F.col("r") <= cfg.shortlist_max_pairs_per_url).select("a", "b").distinct()
    return accepted.where(strong).unionByName(accepted.where(~strong).join(kept, ["a", "b"], "left_semi"))


def unique_click_share(universe: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, share_a, share_b: how much of each page's clicks comes from queries that the other has not; null below ten clicks."""
    totals = universe.groupBy("page").agg(F.sum("clicks").alias("clicks"))
    common = shared_query_pairs(universe).groupBy("a", "b").agg(F.sum("clicks_a").alias("ca"), F.sum("clicks_b").alias("cb"))
    t = lambda s: totals.select(F.col("page").alias(s), F.col("clicks").alias(f"t{s}"))
    joined = pairs.select("a", "b").join(t("a"), "a").join(t("b"), "b").join(common, ["a", "b"], "left")
    share = lambda s: F.when(F.col(f"t{s}") >= 10, (F.col(f"t{s}") - F.coalesce(f"c{s}", F.lit(0))) / F.col(f"t{s}"))
    return joined.select("a", "b", share("a").alias("share_a"), share("b").alias("share_b"))


def url_twins(pages: DataFrame) -> DataFrame:
    """a, b: different URLs whose slugs hold the same words, numbers aside."""
    keyed = pages.select("page").distinct().withColumn("key", F.array_join(F.array_sort(U.slug_tokens(F.col("page"))), " ")).where("key != ''")
    a, b = keyed.alias("a"), keyed.alias("b")
    norm = lambda s: U.norm_url(F.col(f"{s}.page"))
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.page") < F.col("b.page")) & (norm("a") != norm("b"))).select(F.col("a.page").alias("a"), F.col("b.page").alias("b"))


def align_weekly(weekly: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, query, week and both pages' values on the queries they share; counts absent on one side are zero, positions stay null."""
    w = lambda s: weekly.select(F.col("page").alias(s), "query", "week", *[F.col(c).alias(f"{c}_{s}") for c in ("clicks", "impressions", "position")])
    p = pairs.select("a", "b").distinct()
    both = p.join(w("a").select("a", "query").distinct(), "a").join(w("b").select("b", "query").distinct(), ["b", "query"])
    left, right = both.join(w("a"), ["a", "query"]), both.join(w("b"), ["b", "query"])
    joined = left.join(right, ["a", "b", "query", "week"], "full")
    zero = [F.coalesce(f"{c}_{s}", F.lit(0)).alias(f"{c}_{s}") for s in "ab" for c in ("clicks", "impressions")]
    return joined.select("a", "b", "query", "week", *zero, "position_a", "position_b")


def parity_test(aligned: DataFrame, end: Column, cfg: OverlapConfig = CFG) -> DataFrame:
    """Per pair and query, over the recent weeks: the measured values, whether all gates hold, and which do not."""
    recent = aligned.where(F.col("week") >= F.date_sub(end, cfg.recent_window_days))
    wp = lambda s: S.weighted_position(f"position_{s}", f"impressions_{s}")
    rolled = recent.groupBy("a", "b", "query").agg(
        F.count("*").alias("weeks"),
        F.count_if((F.col("impressions_a") > 0) & (F.col("impressions_b") > 0)).alias("weeks_both"),
        *[F.sum(f"{c}_{s}").alias(f"{c}_{s}") for s in "ab" for c in ("clicks", "impressions")],
        wp("a").alias("position_a"),
        wp("b").alias("position_b"),
    )
    parity = lambda c: F.coalesce(F.try_divide(F.least(f"{c}_a", f"{c}_b"), F.greatest(f"{c}_a", f"{c}_b")), F.lit(0.0))
    m = rolled.withColumn("simultaneity", F.col("weeks_both") / F.col("weeks")).withColumn("click_parity", parity("clicks")).withColumn("impression_parity", parity("impressions")).withColumn("position_delta", F.abs(F.col("position_a") - F.col("position_b")))
    worst = F.when(F.col("position_delta").isNotNull(), F.greatest("position_a", "position_b"))
    gates = {
        "clicks_total": F.col("clicks_a") + F.col("clicks_b") >= cfg.ongoing_min_query_total_clicks,
        "clicks_min_side": F.least("clicks_a", "clicks_b") >= cfg.ongoing_min_query_clicks_each_side,
        "click_parity": F.col("click_parity") >= cfg.ongoing_min_click_parity,
        "impr_parity": F.col("impression_parity") >= cfg.ongoing_min_impr_parity,
        "pos_delta": F.coalesce(F.col("position_delta") <= cfg.ongoing_max_position_delta, F.lit(False)),
        "pos_max": F.coalesce(worst <= cfg.ongoing_max_position_abs, F.lit(False)),
        "simultaneity": F.col("simultaneity") >= cfg.ongoing_min_simultaneity_pct,
        "weeks": F.col("weeks") >= cfg.ongoing_min_weeks_observed,
    }
    failed = F.concat_ws(";", *[F.when(~ok, F.lit(name)) for name, ok in gates.items()])
    return m.withColumn("failed", failed).withColumn("qualifies", F.col("failed") == "")


def detect_ongoing(parity: DataFrame, cfg: OverlapConfig = CFG) -> DataFrame:
    """a, b, qualifying, rejected, ongoing and the clicks on qualifying queries."""
    clicks = F.sum(F.when(F.col("qualifies"), F.col("clicks_a") + F.col("clicks_b")).otherwise(0))
    return parity.groupBy("a", "b").agg(F.count_if("qualifies").alias("qualifying"), F.count_if(~F.col("qualifies")).alias("rejected"), clicks.alias("qualifying_clicks")).withColumn("ongoing", F.col("qualifying") >= cfg.ongoing_min_qualifying_queries)


def upper_median(values: Column) -> Column:
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.try_element_at(ordered, F.floor(F.size(ordered) / 2).cast("int") + 1)


def assess_redundant(parity: DataFrame, cfg: OverlapConfig = CFG) -> DataFrame:
    """a, b, shared, weak_side, median_position, weak_click_share, redundant: one page is weaker throughout, and buried or out-clicked."""
    rows = parity.where(~F.col("qualifies") & (F.col("impressions_a") > 0) & (F.col("impressions_b") > 0))
    pa, pb = F.round("position_a", 2), F.round("position_b", 2)
    weak = F.when(F.col("clicks_a") < F.col("clicks_b"), "a").when(F.col("clicks_b") < F.col("clicks_a"), "b").when(F.coalesce(pa, F.lit(999.0)) > F.coalesce(pb, F.lit(999.0)), "a").otherwise("b")
    rolled = rows.withColumn("weak", weak).groupBy("a", "b").agg(F.count("*").alias("shared"), F.count_if(F.col("weak") == "a").alias("na"), F.sum("clicks_a").alias("ca"), F.sum("clicks_b").alias("cb"), F.collect_list(F.when(F.col("weak") == "a", pa)).alias("qa"), F.collect_list(F.when(F.col("weak") == "b", pb)).alias("qb"))
    side = F.when(F.col("na") >= F.col("shared") - F.col("na"), "a").otherwise("b")
    is_a = F.col("weak_side") == "a"
    m = rolled.withColumn("weak_side", side)
    m = m.withColumn("dominance", F.when(is_a, F.col("na")).otherwise(F.col("shared") - F.col("na")) / F.col("shared")).withColumn("median_position", F.when(is_a, upper_median(F.col("qa"))).otherwise(upper_median(F.col("qb")))).withColumn("weak_click_share", F.try_divide(F.when(is_a, F.col("ca")).otherwise(F.col("cb")), F.col("ca") + F.col("cb")))
    beaten = F.coalesce(F.col("median_position") > cfg.redundant_buried_position, F.lit(False)) | F.coalesce(F.col("weak_click_share") < cfg.redundant_max_weak_click_share, F.lit(False))
    verdict = (F.col("shared") >= cfg.redundant_min_shared_queries) & (F.col("dominance") >= cfg.redundant_dominance_frac) & beaten
    return m.select("a", "b", "shared", "weak_side", "dominance", "median_position", "weak_click_share", verdict.alias("redundant"))


def spearman(aligned: DataFrame) -> DataFrame:
    """a, b, query, rho over the aligned weekly clicks; 0 below three weeks or where a side is constant."""
    part = ["a", "b", "query"]
    rank = lambda c: F.rank().over(Window.partitionBy(*part).orderBy(c)) + (F.count("*").over(Window.partitionBy(*part, c)) - 1) / 2
    ranked = aligned.withColumn("ra", rank("clicks_a")).withColumn("rb", rank("clicks_b"))
    rho = F.when((F.count("*") >= 3) & (F.stddev_pop("ra") > 0) & (F.stddev_pop("rb") > 0), F.corr("ra", "rb")).otherwise(0.0)
    return ranked.groupBy(*part).agg(F.count("*").alias("weeks"), F.coalesce(F.nanvl(rho, F.lit(0.0)), F.lit(0.0)).alias("rho"))


def rolling_clicks(aligned: DataFrame, weeks: int = CFG.handoff_smoothing_weeks) -> DataFrame:
    """The aligned rows with trailing means of both pages' clicks."""
    w = Window.partitionBy("a", "b", "query").orderBy("week").rowsBetween(-(weeks - 1), 0)
    return aligned.select("a", "b", "query", "week", F.avg("clicks_a").over(w).alias("mean_a"), F.avg("clicks_b").over(w).alias("mean_b"))


def cluster_edges(pairs: DataFrame, cfg: OverlapConfig = CFG) -> DataFrame:
    """Pairs strong enough to form clusters: two qualifying queries, or one with enough clicks."""
    return pairs.where("ongoing").where((F.col("qualifying") >= 2) | (F.col("qualifying_clicks") >= cfg.cluster_min_clicks_for_single_query_ongoing)).select("a", "b")
