"""Routes texts to sections by keywords: the rule with the most keywords contained in the text wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Keywords and section of each rule, in order. Two rules may share a section.
ROUTES = [
    (["traffic down", "ranking down", "clicks down", "decline", "drop", "lost traffic", "lost traffic after migration", "ranking fluctuation", "rankings fluctuating", "homepage ranking", "homepage leaning", "brand query vanished", "brand keyword vanished", "specific hour", "massive deranking", "google-only deranking", "cannibalization"], "decline-diagnosis"),
    (["new site", "new domain", "new project", "what is this business", "entity"], "domain-understanding"),
    (["topical map", "content cluster", "topic map", "keyword map"], "topical-map"),
    (["money page", "service page", "conversion", "cro"], "money-pages"),
    (["location page", "local seo", "gbp", "google business"], "local-gbp"),
    (["eeat", "e-e-a-t", "authorship", "author"], "content-eeat"),
    (["cannibal", "duplicate url", "same keyword two pages"], "decline-diagnosis"),
    (["render", "javascript", "js seo", "raw html", "robots.txt", "robots blocked", "screaming frog", "crawl blocked", "accept-encoding", "cdn", "waf", "dnssec", "load balancer", "googlebot"], "technical-seo"),
    (["log file", "crawl budget", "bot crawl"], "technical-seo"),
    (["backlink", "off page", "toxic link"], "technical-seo"),
    (["affiliate", "review site", "disclosure"], "content-eeat"),
    (["sandbox", "indexed but not ranking", "not graduating"], "decline-diagnosis"),
    (["schema", "structured data", "rich result"], "structured-data"),
    (["aeo", "geo", "ai visibility", "ai citation", "citations", "chatgpt", "claude", "perplexity"], "apps-tools-seo"),
    (["blog", "adsense", "informational", "ecommerce blog", "shop blog", "tiny budget", "small niche ecommerce"], "blog-adsense"),
    (["location page", "city page", "doorway", "same content", "duplicate location"], "service-location-pages"),
    (["product page", "category page", "breadcrumb", "collection page", "cross sell", "cross-selling", "silo", "internal linking", "page depth", "click depth"], "service-location-pages"),
    (["canonical", "google-selected canonical", "selected canonical"], "technical-seo"),
    (["indexed but not showing", "indexed but not served", "not showing in serps", "indexed no impressions"], "technical-seo"),
    (["b2b", "nurture", "funnel", "seo tool", "seo tools", "tool gap", "best value", "seo clients", "client acquisition"], "weekly-reporting"),
    (["wordpress to static", "static html", "migration", "cms migration", "post migration", "wordpress migration", "wix migration"], "technical-seo"),
    (["seo influencer", "seo guru", "guru advice", "viral seo advice", "advice credibility"], "source-rules"),
    (["forecast", "kpi", "projection"], "kpi-forecasting"),
    (["weekly report", "reporting"], "weekly-reporting"),
]
DEFAULT_SECTION = "decision-router"


def route_situations(texts: DataFrame, key: str, text: str, routes: list[tuple[list[str], str]] = ROUTES, skills: dict[str, list[str]] | None = None) -> DataFrame:
    """key, section, score, confidence, alternate, matched (the section's keywords in the text), skills (those named for the section).

    No rule: the default section; a tie for the first place: low confidence. The rules are a list in the plan: a text's scores
    are computed in its row, without a join or shuffle.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    held = lambda words: F.filter(F.array(*map(F.lit, words)), lambda w: low.contains(w))
    scores = F.array(*[F.struct(held(words).alias("words"), F.lit(section).alias("section"), F.lit(i).alias("rule")) for i, (words, section) in enumerate(routes)])
    hits = F.filter(scores, lambda s: F.size(s["words"]) > 0)
    ranked = F.array_sort(F.transform(hits, lambda s: F.struct((-F.size(s["words"])).alias("minus"), s["section"].alias("section"), s["rule"].alias("rule"), s["words"].alias("words"))))
    rows = texts.select(key, ranked.alias("r")).select(key, F.try_element_at("r", F.lit(1)).alias("a"), F.try_element_at("r", F.lit(2)).alias("b"))
    tied = F.coalesce(F.col("a.minus") == F.col("b.minus"), F.lit(False))
    named = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for pair in (skills or {}).items() for x in pair]) if skills else None
    suggested = F.coalesce(F.try_element_at(named, F.col("a.section")), F.array().cast("array<string>")) if skills else F.array().cast("array<string>")
    return rows.select(key, F.coalesce("a.section", F.lit(DEFAULT_SECTION)).alias("section"), F.coalesce(-F.col("a.minus"), F.lit(0)).alias("score"), F.when(F.col("a.section").isNull(), None).when(tied, "low").otherwise("high").alias("confidence"), F.when(tied, F.col("b.section")).alias("alternate"), F.coalesce("a.words", F.array().cast("array<string>")).alias("matched"), suggested.alias("skills"))


def decision_counts(decisions: DataFrame, *by: str) -> DataFrame:
    """How many rows there are by each of the named columns: dimension, value, rows."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).cast("string").alias("value")) for c in by]))
    return decisions.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count("*").alias("rows"))


def latest_task_state(findings: DataFrame, tasks: DataFrame, key: tuple[str, ...] = ("url", "issue")) -> DataFrame:
    """key, state: done, regressed (done before, found again) or open, against a log of tasks (key, status, ts). Open tasks that are not found again have no finding and no row.

    Both have the columns of ``key``, which tell one task from another: where a URL stands for several pages, a page's number belongs to it. Null is a value like any other.
    """
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ts"), "status"))
    last = tasks.withColumn("r", rank).where("r = 1").select(*key, F.lit(False).alias("found"), "status")
    rows = findings.select(*key, F.lit(True).alias("found"), F.lit(None).cast("string").alias("status")).unionByName(last)
    known = rows.groupBy(*key).agg(F.bool_or("found").alias("found"), F.max("status").alias("status"))
    state = F.when(F.col("found") & (F.col("status") == "done"), "regressed").when(F.col("found"), "open").when(F.col("status") == "done", "done")
    return known.select(*key, state.alias("state")).where("state is not null")
