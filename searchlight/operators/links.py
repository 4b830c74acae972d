"""Backlinks, domain risk, keyword pulls and behaviour exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlight.functions import urls as U

# Anchors that say nothing, and patterns of spam domains.
GENERIC_ANCHORS = ["", "click here", "here", "read more", "link", "website", "visit", "this website"]
SPAM = r"(seo|directory|backlink|linklist|bookmark|articledir|guestpost|casino|porn|replica|\.xyz$|\.top$|\.buzz$|\.click$|forum.*profile|/tag/|pastebin|000webhost)"
# Selectors that lead to a conversion, and those that do not.
CONVERSION = r"quote|contact|book|buy|cart|checkout|signup|sign-up|subscribe|call|demo|trial"
NO_CONVERSION = r"nav|menu|footer|header|logo|social|search|breadcrumb"


def anchor_class(anchor: Column, brand: str | None, money: list[str]) -> Column:
    """brand, exact_money, generic, url or other; the first that applies."""
    low = F.lower(F.trim(F.coalesce(anchor, F.lit(""))))
    named = low.rlike("(?i)" + brand) if brand else F.lit(False)
    paid = reduce(lambda a, b: a | b, [low.contains(m.lower()) for m in money], F.lit(False))
    return F.when(named, "brand").when(paid, "exact_money").when(low.isin(GENERIC_ANCHORS), "generic").when(low.rlike(r"^https?://|^www\."), "url").otherwise("other")


def spam_domain(domain: Column, source: Column, score: Column, low_is_spam: bool = True, limit: float = 5) -> Column:
    """Whether a domain looks like spam, by its name or by its score; low_is_spam says which way the score runs."""
    by_score = score <= limit if low_is_spam else score >= 100 - limit
    return F.coalesce(source.rlike("(?i)" + SPAM), F.lit(False)) | F.coalesce(domain.rlike("(?i)" + SPAM), F.lit(False)) | F.coalesce(by_score, F.lit(False))


def anchor_profile(links: DataFrame, brand: str | None, money: list[str]) -> DataFrame:
    """One row over backlinks (source_url, anchor, domain, score): rows, domains, shares of anchor classes, toxic domains and flags."""
    domain = U.norm_domain(F.coalesce("domain", "source_url"))
    rows = links.withColumn("d", domain).withColumn("class", anchor_class(F.col("anchor"), brand, money)).withColumn("spam", spam_domain(F.col("d"), F.col("source_url"), F.col("score")))
    pct = lambda c: F.coalesce(F.try_divide(100 * F.count_if(F.col("class") == c), F.count("*")), F.lit(0.0))
    one = rows.agg(F.count("*").alias("links"), F.countDistinct("d").alias("domains"), pct("exact_money").alias("money_pct"), pct("brand").alias("brand_pct"), F.countDistinct(F.when(F.col("spam"), F.col("d"))).alias("toxic_domains"))
    one = one.withColumn("toxic_pct", F.coalesce(F.try_divide(100 * F.col("toxic_domains"), F.col("domains")), F.lit(0.0)))
    return one.withColumn("over_optimised", F.col("money_pct") >= 15).withColumn("brand_poor", (F.col("brand_pct") < 30) & (F.col("links") > 20)).withColumn("toxic_risk", F.col("toxic_pct") >= 20)


def top_anchors(links: DataFrame, top: int = 20) -> DataFrame:
    """anchor, links, domains of the anchors with the most links; ties by anchor. Links without an anchor count as ''."""
    rolled = links.groupBy(F.coalesce(F.trim("anchor"), F.lit("")).alias("anchor")).agg(F.count("*").alias("links"), F.countDistinct(U.norm_domain(F.coalesce("domain", "source_url"))).alias("domains"))
    return rolled.orderBy(F.desc("links"), "anchor").limit(top)


def toxic_multi_source(flags: DataFrame, disavowed: DataFrame, least_score: float = 60, least_sources: int = 2) -> DataFrame:
    """domain, sources, n_sources, status for domains that several independent sources flag; those already disavowed are marked."""
    bad = flags.where(F.col("score") >= least_score).select(U.norm_domain(F.col("domain")).alias("domain"), "src").distinct()
    rolled = bad.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_set("src")), ",").alias("sources"), F.count("*").alias("n_sources"))
    known = disavowed.select(U.norm_domain(F.col("domain")).alias("domain")).distinct().withColumn("known", F.lit(True))
    status = F.when(F.col("known"), "already disavowed").when(F.col("n_sources") >= least_sources, "disavow").otherwise("review")
    return rolled.join(known, "domain", "left").select("domain", "sources", "n_sources", status.alias("status"))


def disavow_merge(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.select(U.norm_domain(F.col("domain")).alias("domain")).union(new.select(U.norm_domain(F.col("domain")))).distinct()


def link_gap(links: DataFrame, client: str, least_competitors: int = 2) -> DataFrame:
    """Domains that link to several competitors (column site) and not to the client."""
    has = links.where(F.col("site") == client).select("domain").distinct()
    others = links.where(F.col("site") != client).groupBy("domain").agg(F.countDistinct("site").alias("competitors")).where(F.col("competitors") >= least_competitors)
    return others.join(has, "domain", "left_anti")


def referring_profile(links: DataFrame, step: float = 20) -> DataFrame:
    """authority band of domains, with domains and links in it."""
    band = F.floor(F.col("score") / step).cast("int")
    return links.groupBy(band.alias("band")).agg(F.countDistinct("domain").alias("domains"), F.count("*").alias("links"))


def link_velocity(links: DataFrame, domain: str = "domain") -> DataFrame:
    """One row over backlinks (domain, rel, first_seen, lost): links, domains, links a domain, shares of follow links and domains, and per month of the
    span links won and lost. A null rel follows; a null date is neither won nor lost."""
    follow = ~F.lower(F.coalesce("rel", F.lit(""))).rlike(r"\b(nofollow|ugc|sponsored)\b")
    name = U.norm_domain(F.col(domain))
    one = links.agg(F.count("*").alias("links"), F.countDistinct(name).alias("domains"), F.count_if(follow).alias("follow"), F.countDistinct(F.when(follow, name)).alias("follow_domains"), F.count("first_seen").alias("won"), F.count("lost").alias("gone"), F.least(F.min("first_seen"), F.min("lost")).alias("a"), F.greatest(F.max("first_seen"), F.max("lost")).alias("b"))
    months = F.greatest(F.floor(F.datediff("b", "a") / 30.4375) + 1, F.lit(1))
    per = lambda c: F.try_divide(F.col(c), F.coalesce(months, F.lit(1)))
    return one.select("links", "domains", F.try_divide("links", "domains").alias("links_a_domain"), F.try_divide("follow", "links").alias("follow_share"), F.try_divide("follow_domains", "domains").alias("follow_domain_share"), per("won").alias("won_a_month"), per("gone").alias("lost_a_month"))


def rank_band(rank: Column) -> Column:
    """low, medium or high on a scale of 0 to 1000."""
    return F.when(rank < 200, "low").when(rank < 500, "medium").otherwise("high")


def keyword_master(pulls: DataFrame) -> DataFrame:
    """One row a keyword (case aside): the one with the largest volume, first on ties; zero fields come from the next best."""
    w = Window.partitionBy(F.lower("keyword")).orderBy(F.desc("search_volume"), "ordinal").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = [F.coalesce(F.first(F.nullif(c, F.lit(0.0)), ignorenulls=True).over(w), F.lit(0.0)).alias(c) for c in ("kd", "cpc")]
    rank = F.row_number().over(Window.partitionBy(F.lower("keyword")).orderBy(F.desc("search_volume"), "ordinal"))
    return pulls.select("keyword", "search_volume", *filled, "seed", "ordinal", rank.alias("r")).where("r = 1").drop("r")


def keyword_clusters(master: DataFrame) -> DataFrame:
    """seed, keywords, volume, top_keyword."""
    return master.groupBy("seed").agg(F.count("*").alias("keywords"), F.sum("search_volume").alias("volume"), F.max_by("keyword", F.struct("search_volume", -F.col("ordinal"))).alias("top_keyword"))


def doubled_words(keywords: DataFrame) -> DataFrame:
    """keyword, doubled: whether a word stands twice in a row."""
    return keywords.select("keyword", F.col("keyword").rlike(r"(?i)\b(\w+)\s+\1\b").alias("doubled"))


def click_kind(selector: Column) -> Column:
    """non_conversion if anywhere in the selector, else conversion if in its last part, else ambiguous."""
    leaf = F.trim(F.element_at(F.split(selector, ">"), -1))
    return F.when(selector.rlike("(?i)" + NO_CONVERSION), "non_conversion").when(leaf.rlike("(?i)" + CONVERSION), "conversion").otherwise("ambiguous")


def click_summary(clicks: DataFrame) -> DataFrame:
    """Per page: clicks by kind, and the selector that distracts most."""
    rows = clicks.withColumn("kind", click_kind(F.col("selector")))
    part = lambda k: F.sum(F.when(F.col("kind") == k, F.col("clicks")).otherwise(0)).alias(k)
    away = F.when(F.col("kind") == "non_conversion", F.struct("clicks", "selector"))
    return rows.groupBy("page").agg(part("conversion"), part("non_conversion"), part("ambiguous"), F.max(away).getField("selector").alias("top_distractor"))


def largest_band_drop(bands: DataFrame) -> DataFrame:
    """Per page of (page, depth_pct, visitors): the largest fall between neighbouring depths, and the depth nearest to the middle."""
    w = Window.partitionBy("page").orderBy("depth_pct")
    steps = bands.withColumn("next", F.lead("visitors").over(w)).withColumn("next_depth", F.lead("depth_pct").over(w)).withColumn("drop", F.col("visitors") - F.col("next"))
    return steps.groupBy("page").agg(F.max_by(F.struct("depth_pct", "next_depth", "drop"), F.when(F.col("drop").isNotNull(), F.struct("drop", -F.col("depth_pct")))).alias("d"), F.min_by("visitors", F.struct(F.abs(F.col("depth_pct") - 50), "depth_pct")).alias("mid_visitors")).select("page", F.col("d.depth_pct").alias("from_depth"), F.col("d.next_depth").alias("to_depth"), F.col("d.drop").alias("drop"), "mid_visitors")


def top_attention_band(bands: DataFrame) -> DataFrame:
    """Per page: the depth with the largest share of visitors."""
    return bands.groupBy("page").agg(F.max_by("depth_pct", F.struct("visitors", -F.col("depth_pct"))).alias("depth_pct"), F.max("visitors").alias("visitors"))
