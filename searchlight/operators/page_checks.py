"""Checks over stored pages by column expressions: weight, links, hosts, templates of conversion, tasks."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlight.functions import urls as U
from searchlight.operators.pages import page_text

# Hosts of affiliate networks and their names.
NETWORKS = [("amazon.com", "Amazon"), ("amzn.to", "Amazon"), ("shareasale.com", "ShareASale"), ("awin1.com", "Awin"), ("anrdoezrs.net", "CJ"), ("impact.com", "Impact"), ("rakuten.com", "Rakuten"), ("clickbank.net", "ClickBank")]
# The trackers that are looked for by default.
TRACKERS = ["swap.js", "gtag/js", "fbevents.js"]
# What asks for, or supports, a conversion in a page's text.
CTA = r"\b(get (a )?(free )?(quote|proposal|assessment|audit|consult\w*)|request|book|schedule|contact us|call now|get started|start (now|today)|free trial|talk to|speak (to|with)|claim|sign up)\b"
SPECIFIC_CTA = r"\b(free (quote|assessment|audit|consultation)|request (a )?(proposal|quote|consult)|book (a )?(call|demo|meeting)|schedule (a )?(call|consult))\b"
REVIEW_STAT = r"(\d(?:\.\d)?)\s*/\s*5|\b(\d{1,4})\s*\+?\s*(?:google |local |b2b |verified )*reviews?\b|\b(\d{1,4})\s*\+?\s*(?:five|5)[- ]star\b"
TRUST = r"\b(review\w*|rating\w*|star\w*|testimonial\w*|certified|accredited|award\w*|trusted|clients?|years? (of|in)|guarantee)\b"
IN_TEXT = {
    "guarantee": r"\b(guarantee\w*|money[- ]back|sla|100%\s+satisf)\b",
    "pricing": r"\b(pricing|\$\s?\d+\s*/\s*(mo|month|user)|per (user|month)|our plans?)\b",
    "lead_magnet": r"\b(free (guide|ebook|checklist|template|download|assessment)|download (the|our)|whitepaper)\b",
    "badges": r"\b(clutch|gartner|g2|premier partner|gold partner|certified partner|msp 501|inc\.?\s?5000)\b",
    "testimonials": r"\b(testimonial\w*|what our clients say|client stories|case stud\w+)\b",
}
SERVICE_URL = r"/(services?|it-|managed|support|cloud|security|consulting|voip|network|backup|helpdesk|help-desk)"
PHONE = r"\b\d{3}[.\-)\s]\d{3}[.\-\s]\d{4}\b"
FORM = r"<form\b.*?<(input|textarea)\b|class=\"[^\"]*(elementor-form|wpcf7|gform|elementor-popup)"
STICKY = r"class=\"[^\"]*\b(is-sticky|has-sticky|sticky-(nav|header|bar|top)|mysticky)\b|style=\"[^\"]*position\s*:\s*(fixed|sticky)"
HERO = r"<(header|section)\b[^>]*background-image\s*:\s*url|<(header|section)\b[^>]*>[^§]{0,900}?<img\b"


def _within(html: Column, tag: str) -> Column:
    """Characters inside all elements of a kind."""
    return F.aggregate(F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1)), F.lit(0), lambda a, x: a + F.length(x))


def page_weight(pages: DataFrame, trackers: list[str] = TRACKERS) -> DataFrame:
    """page_id, bytes, inline_css, inline_js, scripts, styles, external_css, external_js, svg, trackers, tags, forms, title_chars, meta_chars, schema_blocks, words.

    trackers counts every place that one of the patterns stands at.
    """
    h = F.col("html")
    count = lambda pattern: F.regexp_count(h, F.lit(pattern))
    title = F.trim(F.regexp_replace(F.regexp_extract(h, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))
    about = F.regexp_extract(F.regexp_extract(h, r"""(?i)(<meta\b[^>]*\bname=["']description["'][^>]*>)""", 1), r"""(?i)\bcontent="([^"]*)\"""", 1)
    hits = sum((count(re.escape(t)) for t in trackers), F.lit(0))
    return pages.select(
        "page_id",
        F.octet_length(h).alias("bytes"),
        _within(h, "style").alias("inline_css"),
        _within(h, "script").alias("inline_js"),
        count(r"(?i)<script\b").alias("scripts"),
        count(r"(?i)<style\b").alias("styles"),
        count(r"""(?i)<link\b[^>]*\brel=["']?[^"'>]*stylesheet""").alias("external_css"),
        count(r"(?i)<script\b[^>]*\bsrc=").alias("external_js"),
        count(r"(?i)<svg\b").alias("svg"),
        hits.alias("trackers"),
        count(r"<[a-zA-Z]").alias("tags"),
        count(r"(?i)<form\b").alias("forms"),
        F.length(title).alias("title_chars"),
        F.length(about).alias("meta_chars"),
        count(r"(?i)application/ld\+json").alias("schema_blocks"),
        F.size(F.filter(F.split(page_text(h), " "), lambda w: w != "")).alias("words"),
    )


def page_weight_flags(weights: DataFrame) -> DataFrame:
    """page_id and what exceeds the guidelines."""
    flags = {"inline css": F.col("inline_css") > 30_000, "many nodes": F.col("tags") > 1400, "trackers": F.col("trackers") > 1, "no form": F.col("forms") == 0, "long title": F.col("title_chars") > 60, "no schema": F.col("schema_blocks") == 0}
    return weights.select("page_id", F.concat_ws(";", *[F.when(c, F.lit(n)) for n, c in flags.items()]).alias("flags"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, host, position, href of every anchor, in page order; values stand in quotes of either kind or in none."""
    tags = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*?\bhref\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)"), F.lit(1))
    hrefs = F.posexplode(F.transform(tags, lambda x: F.regexp_replace(x, r"""^["']|["']$""", "")))
    return pages.select("page_id", U.norm_domain(F.col("url")).alias("host"), hrefs.alias("position", "href"))


def outbound_links(links: DataFrame) -> DataFrame:
    """Links to other hosts: page_id, host, href, target."""
    target = U.norm_domain(F.col("href"))
    return links.where(F.col("href").rlike("(?i)^(https?:)?//")).select("page_id", "host", "href", target.alias("target")).where("target != host")


def link_network(target: Column) -> Column:
    """The affiliate network that a host belongs to, or null."""
    out = F.when(F.lit(False), "")
    for host, name in NETWORKS:
        out = out.when((target == host) | target.endswith("." + host), name)
    return out


def link_targets(links: DataFrame) -> DataFrame:
    """href, pages: how many pages link to an address within their site, and in how many places."""
    inner = links.where(~F.col("href").rlike("(?i)^(https?:)?//"))
    return inner.groupBy("href").agg(F.countDistinct("page_id").alias("pages"), F.count("*").alias("places"))


def conversion_features(pages: DataFrame) -> DataFrame:
    """page_id, host, words, ctas (texts under 40 characters of links and buttons that ask for something), review_stats, trust, and what else the page has."""
    with_text = pages.withColumn("t", page_text(F.col("html")))
    t, h = F.col("t"), F.col("html")
    controls = F.concat(*[F.regexp_extract_all(h, F.lit(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"), F.lit(1)) for tag in ("a", "button")])
    asks = F.filter(F.transform(controls, lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))), lambda c: c.rlike("(?i)" + CTA) & (F.length(c) < 40))
    has = lambda c, pattern: F.coalesce(c.rlike("(?is)" + pattern), F.lit(False))
    return with_text.select(
        "page_id", U.norm_domain(F.col("url")).alias("host"), F.size(F.filter(F.split(t, " "), lambda w: w != "")).alias("words"), asks.alias("ctas"), has(t, SPECIFIC_CTA).alias("specific_cta"),
        F.transform(F.regexp_extract_all(t, F.lit("(?i)" + REVIEW_STAT), F.lit(0)), lambda x: F.trim(x)).alias("review_stats"), F.regexp_count(t, F.lit("(?i)" + TRUST)).alias("trust"), *[has(t, p).alias(n) for n, p in IN_TEXT.items()],
        (h.rlike('(?i)href="tel:') | has(t, PHONE)).alias("phone"), has(F.col("url"), SERVICE_URL).alias("service_page"), has(h, FORM).alias("has_form"), has(h, STICKY).alias("has_sticky"), has(h, HERO).alias("hero"),
    )


def host_profile(features: DataFrame) -> DataFrame:
    """Per host: pages, the eight most frequent calls to action, six review figures, and what any, or what share, of its pages has."""
    rank = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("n"), "c"))
    best = features.select("host", F.explode("ctas").alias("c")).groupBy("host", "c").agg(F.count("*").alias("n")).withColumn("r", rank).where("r <= 8")
    best = best.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "c"))), lambda x: x["c"]).alias("top_ctas"))
    any_ = [F.bool_or(c).alias(n) for n, c in {**{n: n for n in ("specific_cta", *IN_TEXT, "has_form", "has_sticky")}, "phone_present": "phone"}.items()]
    stats = features.select("host", F.explode("review_stats").alias("x")).groupBy("host", "x").agg(F.count("*")).withColumn("r", F.row_number().over(Window.partitionBy("host").orderBy("x"))).where("r <= 6")
    stats = stats.groupBy("host").agg(F.array_sort(F.collect_list("x")).alias("review_counts"))
    rolled = features.groupBy("host").agg(F.count("*").alias("pages"), F.count_if("service_page").alias("service_pages"), F.round(F.count_if("hero") / F.count("*"), 2).alias("hero_frac"), F.floor(F.avg("words")).alias("avg_words"), F.sum("trust").alias("trust_total"), *any_)
    none = F.array().cast("array<string>")
    joined = rolled.join(best, "host", "left").join(stats, "host", "left").withColumn("top_ctas", F.coalesce("top_ctas", none)).withColumn("review_counts", F.coalesce("review_counts", none))
    return joined.withColumn("n_ctas", F.size("top_ctas")).withColumn("review_stats", F.size("review_counts") > 0)


def conversion_findings(profile: DataFrame) -> DataFrame:
    """host, finding: over four different calls to action and no specific one; no review figure."""
    sprawl = F.when((F.col("n_ctas") > 4) & ~F.col("specific_cta"), "many calls to action without a clear one")
    found = F.filter(F.array(sprawl, F.when(~F.col("review_stats"), "no review figure")), lambda x: x.isNotNull())
    return profile.select("host", F.explode(found).alias("finding"))


def priority_weighting(findings: DataFrame, traffic: DataFrame, page: str = "url") -> DataFrame:
    """url, issue, weight: severity (1 to 3) times the page's clicks, positions 11 to 20 first; one row a finding.

    Both have the column ``page``, which tells pages apart: where a URL stands for several, it is their number. Several rows of
    traffic for one page count as one, with all their clicks and the best position.
    """
    severity = F.when(F.col("urgency").startswith("P1"), 3).when(F.col("urgency").startswith("P2"), 2).otherwise(1)
    near = F.coalesce(F.col("position").between(11, 20), F.lit(False))
    per = traffic.groupBy(F.col(page).alias("__page")).agg(F.sum("clicks").alias("clicks"), F.min("position").alias("position"))
    joined = findings.join(per, F.col(page).eqNullSafe(F.col("__page")), "left")
    return joined.select("url", "issue", (severity * F.greatest(F.coalesce("clicks", F.lit(0)), F.lit(1)) * F.when(near, 2).otherwise(1)).cast("bigint").alias("weight"))
