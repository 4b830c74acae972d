"""Search-performance analytics over a matrix of page, query, date, clicks, impressions, position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlight.config import OverlapConfig
from searchlight.functions import urls as U

CFG = OverlapConfig()


def weighted_position(position: str = "position", weight: str = "impressions", where: Column | None = None) -> Column:
    """The impression-weighted mean position of the rows that have both, or null."""
    good = (F.col(weight) > 0) & F.col(position).isNotNull()
    good = good if where is None else good & where
    return F.try_divide(F.sum(F.when(good, F.col(position) * F.col(weight))), F.sum(F.when(good, F.col(weight))))


def search_universe(matrix: DataFrame, brand: list[str] = ()) -> DataFrame:
    """page, query (without brand words), impressions, clicks, position. Position is a mean of means, unweighted."""
    rolled = matrix.groupBy("page", "query").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.avg("position").alias("position"))
    named = rolled.withColumn("query", U.strip_brand(F.col("query"), list(brand))).where("query != ''")
    return named.groupBy("page", "query").agg(F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"), F.avg("position").alias("position"))


def query_idf(universe: DataFrame) -> DataFrame:
    """query, df, idf = ln(pages / df)."""
    pages = universe.agg(F.countDistinct("page")).scalar()
    return universe.groupBy("query").agg(F.countDistinct("page").alias("df")).withColumn("idf", F.ln(pages / F.col("df")))


def top_click_queries(universe: DataFrame, top: int = 10) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("clicks"), "query"))
    return universe.where("clicks > 0").withColumn("rank", rank).where(F.col("rank") <= top).select("page", "query", "clicks", "rank")


def weekly_series(matrix: DataFrame) -> DataFrame:
    """page, query, week (from Monday), clicks, impressions, position."""
    week = F.to_date(F.date_trunc("week", "date"))
    return matrix.groupBy("page", "query", week.alias("week")).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), weighted_position().alias("position"))


def weekly_clicks(matrix: DataFrame, weeks: int = CFG.trend_weeks) -> DataFrame:
    """page, week, clicks, n: each page's last observed weeks, n counting them from the first."""
    per = matrix.groupBy("page", F.to_date(F.date_trunc("week", "date")).alias("week")).agg(F.sum("clicks").cast("double").alias("clicks"))
    back = F.row_number().over(Window.partitionBy("page").orderBy(F.desc("week")))
    kept = per.withColumn("back", back).where(F.col("back") <= weeks)
    return kept.withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("week"))).drop("back")


def mann_kendall(weekly: DataFrame) -> DataFrame:
    """page, n, s, z, direction of a monotone trend in clicks; flat below eight points or |z| < 1.96."""
    # At most trend_weeks points a page, so the pairs of a page are bounded.
    points = weekly.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("n", "clicks"))).alias("p"))
    values = "transform(p, x -> x.clicks)"
    s = F.expr(f"aggregate(transform(sequence(1, size(p)), i -> aggregate(slice({values}, i + 1, size(p)), 0D, (a, v) -> a + sign(v - element_at({values}, i)))), 0D, (a, v) -> a + v)")
    ties = F.expr(f"aggregate(transform(array_distinct({values}), d -> cast(size(filter({values}, v -> v = d)) as double)), 0D, (a, c) -> a + c * (c - 1) * (2 * c + 5))")
    n = F.size("p").cast("double")
    found = points.withColumn("n", F.size("p")).withColumn("s", F.when(F.size("p") > 0, s)).withColumn("var", (n * (n - 1) * (2 * n + 5) - ties) / 18)
    z = F.when((F.col("n") < 8) | (F.col("var") <= 0), 0.0).otherwise(F.signum("s") * F.greatest(F.abs("s") - 1, F.lit(0.0)) / F.sqrt(F.greatest("var", F.lit(1e-300))))
    direction = F.when(F.abs("z") < 1.96, "flat").when(F.col("z") > 0, "up").otherwise("down")
    return found.withColumn("z", z).select("page", "n", "s", "z", direction.alias("direction"))


def trend_label(weekly: DataFrame) -> DataFrame:
    """page, trend: one of six labels from the share of weeks without clicks, the trend and the variation."""
    stats = weekly.groupBy("page").agg(F.sum("clicks").alias("total"), F.avg((F.col("clicks") <= 0).cast("double")).alias("zeros"), (F.stddev_pop("clicks") / F.greatest(F.avg("clicks"), F.lit(1e-9))).alias("cv"))
    label = (
        F.when(F.col("total") == 0, "Hits 0 Clicks")
        .when(F.col("zeros") > 0.4, "Unstable, Fluctuation and Hits 0 Clicks")
        .when((F.col("direction") == "up") & (F.col("cv") < 0.8), "Positive, Growing & Stable Position")
        .when(F.col("direction") == "down", "Negative, Declining")
        .when(F.col("cv") > 1.2, "Random, De-index time and again")
        .otherwise("Stable, Flat")
    )
    return stats.join(mann_kendall(weekly), "page").select("page", label.alias("trend"), F.col("z").alias("trend_slope"))


def page_rollup(matrix: DataFrame, cfg: OverlapConfig = CFG) -> DataFrame:
    """One row a page: clicks, impressions, queries, recent position, first and last click, trend."""
    end = matrix.agg(F.max("date")).scalar()
    recent = F.col("date") >= F.date_sub(end, cfg.recent_window_days)
    rolled = matrix.groupBy("page").agg(
        F.sum("clicks").alias("clicks_window"),
        F.sum("impressions").alias("impressions_window"),
        F.countDistinct("query").alias("queries"),
        weighted_position(where=recent).alias("avg_position_90d"),
        F.min(F.when(F.col("clicks") > 0, F.col("date"))).alias("first_click"),
        F.max(F.when(F.col("clicks") > 0, F.col("date"))).alias("last_click"),
    )
    return rolled.join(trend_label(weekly_clicks(matrix, cfg.trend_weeks)), "page")


def multi_page_queries(matrix: DataFrame, least_pages: int = 2, top: int = 50) -> DataFrame:
    """Queries for which several pages appear, by pages and impressions."""
    page = U.strip_query_fragment(F.col("page"))
    rolled = matrix.groupBy("query").agg(F.countDistinct(page).alias("pages"), F.sum("impressions").alias("impressions"), F.sum("clicks").alias("clicks"))
    return rolled.where(F.col("pages") >= least_pages).orderBy(F.desc("pages"), F.desc("impressions"), "query").limit(top)


def monthly_trend(daily: DataFrame) -> DataFrame:
    """month, days, expected_days, partial, clicks, impressions, ctr, position from rows of single days."""
    month = F.date_format("date", "yyyy-MM")
    weight = F.greatest("impressions", F.lit(1))
    placed = F.col("position") > 0
    rolled = daily.groupBy(month.alias("month")).agg(
        F.countDistinct("date").alias("days"),
        F.max(F.day(F.last_day("date"))).alias("expected_days"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.try_divide(F.sum(F.when(placed, F.col("position") * weight)), F.sum(F.when(placed, weight))).alias("position"),
    )
    return rolled.withColumn("partial", F.col("days") < F.col("expected_days")).withColumn("ctr", F.coalesce(F.try_divide(100 * F.col("clicks"), F.col("impressions")), F.lit(0.0)))


def query_totals(matrix: DataFrame) -> DataFrame:
    """query, clicks, impressions, position over all pages and days."""
    return matrix.groupBy("query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), weighted_position().alias("position"))


def is_brand(query: Column, pattern: str) -> Column:
    return F.coalesce(query.rlike("(?i)" + pattern), F.lit(False))


def brand_split(queries: DataFrame, pattern: str) -> DataFrame:
    """brand, queries, clicks, impressions, ctr, position, click_share for brand and other queries."""
    weight = F.greatest("impressions", F.lit(1))
    placed = F.col("position") > 0
    rolled = queries.groupBy(is_brand(F.col("query"), pattern).alias("brand")).agg(
        F.count("*").alias("queries"),
        F.sum("clicks").alias("clicks"),
        F.sum("impressions").alias("impressions"),
        F.try_divide(F.sum(F.when(placed, F.col("position") * weight)), F.sum(F.when(placed, weight))).alias("position"),
    )
    total = F.sum("clicks").over(Window.partitionBy(F.lit(0)))
    return rolled.withColumn("ctr", F.coalesce(F.try_divide(100 * F.col("clicks"), F.col("impressions")), F.lit(0.0))).withColumn("click_share", F.try_divide(100 * F.col("clicks"), total))


def brand_top_queries(queries: DataFrame, pattern: str, top: int = 25) -> DataFrame:
    """brand, rank, query, clicks, impressions of the queries with the most clicks among brand and among other queries; ties by impressions, then query.

    The rank limit is applied in each task before rows move, so no task ranks all queries of a side.
    """
    rank = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("clicks"), F.desc("impressions"), "query"))
    return queries.withColumn("brand", is_brand(F.col("query"), pattern)).withColumn("rank", rank).where(F.col("rank") <= top).select("brand", "rank", "query", "clicks", "impressions")


def zero_click_queries(queries: DataFrame, pattern: str, least_impressions: int = 500, below_ctr: float = 1.0, top: int = 25) -> DataFrame:
    """Non-brand queries that rank on page one with many impressions and hardly a click."""
    ctr = F.col("clicks") / F.col("impressions") * 100
    found = queries.where(~is_brand(F.col("query"), pattern) & (F.col("position") > 0) & (F.col("position") <= 10) & (F.col("impressions") >= least_impressions) & (ctr < below_ctr))
    return found.select("query", "impressions", ctr.alias("ctr"), "position").orderBy(F.desc("impressions"), "query").limit(top)


def position_bands(queries: DataFrame, pattern: str) -> DataFrame:
    """One row: shares of non-brand impressions by position band, and the median CTR on positions 4 to 10."""
    rows = queries.where(~is_brand(F.col("query"), pattern) & (F.coalesce("position", F.lit(0.0)) != 0))
    p, i = F.col("position"), F.col("impressions")
    bands = {"p1_3": p <= 3, "p4_10": (p > 3) & (p <= 10), "p11_20": (p > 10) & (p <= 20), "p21": p > 20}
    ctr = F.coalesce(F.try_divide(F.col("clicks"), i) * 100, F.lit(0.0))
    return rows.agg(*[F.coalesce(F.try_divide(100 * F.sum(F.when(c, i).otherwise(0)), F.sum(i)), F.lit(0.0)).alias(n) for n, c in bands.items()], F.median(F.when(bands["p4_10"], ctr)).alias("median_ctr_4_10"))


def graduation_score(queries: DataFrame, pattern: str) -> DataFrame:
    """score and stage: how far a site has grown beyond its own name."""
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    split = brand_split(queries, pattern).agg(F.max(F.when(F.col("brand"), F.col("click_share"))).alias("brand_share"), F.max(F.when(~F.col("brand"), F.col("position"))).alias("other_position"))
    one = split.join(F.broadcast(position_bands(queries, pattern)))
    a = clamp((100 - F.coalesce("brand_share", F.when(F.col("other_position").isNotNull(), 0.0).otherwise(100.0))) / 50)
    b = clamp((30 - F.coalesce("other_position", F.lit(30.0))) / 22)
    c = clamp((F.col("p1_3") + F.col("p4_10")) / 40)
    d = clamp(F.coalesce("median_ctr_4_10", F.lit(0.0)) / 3)
    scored = one.select(a.alias("nonbrand_share"), b.alias("nonbrand_position"), c.alias("page1_share"), d.alias("ctr_at_rank"))
    score = 100 * (0.30 * F.col("nonbrand_share") + 0.30 * F.col("nonbrand_position") + 0.25 * F.col("page1_share") + 0.15 * F.col("ctr_at_rank"))
    stage = F.when(F.col("score") >= 70, "graduated").when(F.col("score") >= 45, "emerging").when(F.col("score") >= 25, "suppressed").otherwise("deep suppression")
    return scored.withColumn("score", score).withColumn("stage", stage)


def suppression_modes(months: DataFrame, queries: DataFrame, pattern: str, has_baseline: bool = False) -> DataFrame:
    """One row of four flags, from the first against the last third of whole months, and from the bands and the brand's share."""
    full = months.where("not partial")
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("month"))
    count = F.count("*").over(Window.partitionBy(F.lit(0)))
    placed = full.withColumn("r", rank).withColumn("m", count).withColumn("k", F.greatest(F.lit(1), F.floor(F.col("m") / 3)))
    early, late = F.col("r") <= F.col("k"), F.col("r") > F.col("m") - F.col("k")
    mean = lambda c, w: F.avg(F.when(w, F.col(c)))
    change = lambda c: F.coalesce(F.try_divide(mean(c, late) - mean(c, early), mean(c, early)) * 100, F.lit(0.0))
    moved = placed.agg(F.count("*").alias("months"), change("impressions").alias("impressions_change"), change("clicks").alias("clicks_change"))
    split = brand_split(queries, pattern).agg(F.max(F.when(F.col("brand"), F.col("click_share"))).alias("brand_share"), F.max(F.when(~F.col("brand"), F.col("position"))).alias("other_position"))
    one = moved.join(F.broadcast(split)).join(F.broadcast(position_bands(queries, pattern)))
    long = F.col("months") >= 4
    return one.select(
        (long & (F.col("impressions_change") > 20) & (F.col("clicks_change") < 10) & (F.coalesce("other_position", F.lit(99.0)) > 12)).alias("trust_hold"),
        (long & (F.col("impressions_change") < -25) & F.lit(has_baseline)).alias("core_update"),
        F.coalesce((F.col("p1_3") + F.col("p4_10") >= 25) & (F.col("median_ctr_4_10") < 1.0), F.lit(False)).alias("zero_click"),
        F.coalesce(F.col("brand_share") >= 75, F.lit(False)).alias("brand_only"),
    )


def window_delta(matrix: DataFrame, entity: str, since: Column) -> DataFrame:
    """Per entity: totals of all days, of the days since, and the differences; absent is zero."""
    total = lambda d, s: d.groupBy(entity).agg(F.sum("clicks").alias(f"clicks_{s}"), F.sum("impressions").alias(f"impressions_{s}"), weighted_position().alias(f"position_{s}"))
    both = total(matrix, "long").join(total(matrix.where(F.col("date") >= since), "short"), entity, "full")
    z = lambda c: F.coalesce(c, F.lit(0))
    return both.select(entity, *[z(f"{c}_{s}").alias(f"{c}_{s}") for s in ("long", "short") for c in ("clicks", "impressions", "position")], *[(z(f"{c}_short") - z(f"{c}_long")).alias(f"{c}_delta") for c in ("clicks", "impressions", "position")])


def opportunity_queries(queries: DataFrame) -> DataFrame:
    """Queries with impressions within reach of page one and few clicks."""
    ctr = F.col("clicks") / F.col("impressions")
    return queries.where((F.col("impressions") >= 300) & (F.col("position") <= 20) & (ctr <= 0.02)).select("query", "impressions", "position", ctr.alias("ctr"))


def ctr_position_reading(queries: DataFrame) -> DataFrame:
    """A reading of position and CTR; the first row of the table that applies."""
    ctr = F.coalesce(F.try_divide(F.col("clicks"), F.col("impressions")), F.lit(0.0))
    reading = F.when((F.col("position") <= 3) & (ctr < 0.02), "snippet or intent problem").when((F.col("position") <= 10) & (ctr < 0.01), "page one without clicks").when(F.col("position").between(4, 20), "striking distance").when(F.col("position") > 20, "not competing")
    return queries.select("query", "position", ctr.alias("ctr"), reading.alias("reading"))


def position_tiers(queries: DataFrame) -> DataFrame:
    """One row: how many queries rank within the top 3, 5, 10, 50 and 100."""
    return queries.agg(*[F.count_if(F.col("position") <= t).alias(f"top_{t}") for t in (3, 5, 10, 50, 100)])
