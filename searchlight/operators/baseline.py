"""Baselines and audits over stored reports: referring domains, lab metrics, listings, signals, hosts, links, forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlight.functions import agents as A
from searchlight.operators.links import rank_band
from searchlight.operators.page_checks import NETWORKS, link_network

# The score from which a domain counts as spam; words that a label may have without the URL having them.
SPAM_FROM = 30
LABEL_STOP = "page data clarity home homepage about team pricing contact blog service services the top best".split()
# Roles of form fields by type, name or label, in order.
ROLES = [("email", "(?i)email"), ("phone", r"(?i)\b(tel|phone|mobile|number)\b"), ("message", r"(?i)\b(message|help|comment|detail|issue|need|inquir)\b"), ("name", r"(?i)\b(name|company|business|full[-_ ]?name)\b")]
# Severities in ascending order.
SEVERITIES = ["pass", "info", "warning", "critical"]
LOW_AUTHORITY, MANY_LINKS = 20, 3


def spam_score_lookup(domains: DataFrame, scores: DataFrame) -> DataFrame:
    """domains (domain, rank, spam_score, backlinks) with the score of scores (domain, score) where it has one, the flag and the rank band."""
    found = domains.join(scores.groupBy("domain").agg(F.max("score").alias("score")), "domain", "left")
    score = F.coalesce("score", "spam_score", F.lit(0)).cast("double")
    return found.select("domain", "rank", score.alias("spam_score"), (score >= SPAM_FROM).alias("spam"), "backlinks", rank_band(F.col("rank")).alias("band"))


def backlink_summary(looked_up: DataFrame) -> DataFrame:
    """Per rank band: domains, flagged ones, links."""
    return looked_up.groupBy("band").agg(F.count("*").alias("domains"), F.count_if("spam").alias("flagged"), F.sum("backlinks").alias("backlinks"))


def lab_metrics(reports: DataFrame) -> DataFrame:
    """page, the four category scores (0 to 100) and the lab metrics of reports (page, doc); interaction latency is null where the report has none."""
    v = F.try_parse_json("doc")
    number = lambda path: F.try_variant_get(v, path, "double")
    score = lambda name: F.bround(number(f"$.categories['{name}'].score") * 100).cast("bigint")
    audit = lambda name, places=0: F.bround(number(f"$.audits['{name}'].numericValue"), places)
    return reports.select(
        "page", score("performance").alias("performance"), score("accessibility").alias("accessibility"), score("best-practices").alias("best_practices"), score("seo").alias("seo"),
        audit("largest-contentful-paint").alias("lcp_ms"), audit("cumulative-layout-shift", 3).alias("cls"), audit("total-blocking-time").alias("tbt_ms"), audit("speed-index").alias("speed_index_ms"),
        F.coalesce(audit("interaction-to-next-paint"), audit("experimental-interaction-to-next-paint")).alias("inp_ms"),
    )


def listing_status(listings: DataFrame) -> DataFrame:
    """place, name, claimed, rating, reviews, category of listings (place, doc); the rating stands in an object or beside it."""
    v = F.try_parse_json("doc")
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    first = lambda kind, none, *paths: F.coalesce(*[get(p, kind) for p in paths], F.lit(none))
    return listings.select("place", first("string", "", "$.title", "$.name").alias("name"), first("boolean", False, "$.is_claimed").alias("claimed"), first("double", 0.0, "$.rating.value", "$.rating.rating_value", "$.rating_value").alias("rating"), first("bigint", 0, "$.rating.votes_count", "$.rating.rating_count", "$.rating_count").alias("reviews"), first("string", "", "$.category").alias("category"))


def severity_rank(severity: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), severity), F.lit(1))


def severity_merge(signals: DataFrame, solutions: DataFrame) -> DataFrame:
    """signals (page_id, signal_id, severity, ...) with the severity of their worst solution if that is worse; never milder."""
    base = F.regexp_replace("signal_id", "_missing_alt|_js_gated", "")
    worst = solutions.groupBy("page_id", base.alias("signal_id")).agg(F.max(severity_rank(F.col("severity"))).alias("w"))
    rank = F.greatest(severity_rank(F.col("severity")), F.coalesce("w", F.lit(1)))
    merged = F.when(F.col("w") > severity_rank(F.col("severity")), F.element_at(F.array(*map(F.lit, SEVERITIES)), rank.cast("int"))).otherwise(F.col("severity"))
    return signals.join(worst, ["page_id", "signal_id"], "left").withColumn("severity", merged).drop("w")


def render_scores(signals: DataFrame, access: DataFrame) -> DataFrame:
    """page_id, google_score, ai_bot_score, render_gap_score from signals (page_id, signal_id, severity, matches, raw_chars, rendered_chars) and access (page_id, blocked_bots, llms_txt)."""
    gap = F.max(F.when((F.col("signal_id") == "body_text") & (F.col("rendered_chars") > 0), F.greatest(F.lit(0.0), (F.col("rendered_chars") - F.col("raw_chars")) / F.col("rendered_chars") * 100)))
    rolled = signals.groupBy("page_id").agg(
        F.count_if(F.col("severity") == "critical").alias("critical"),
        F.count_if(F.col("severity") == "warning").alias("warning"),
        F.count_if((F.col("signal_id") == "json_ld") & (F.col("severity") == "pass")).alias("schema"),
        F.count_if(~F.col("matches")).alias("mismatches"),
        F.coalesce(gap, F.lit(0.0)).alias("gap"),
    )
    j = rolled.join(access, "page_id", "left")
    none = lambda c: F.when(c, 10).otherwise(0)
    bounded = lambda c: F.greatest(F.lit(0), c).cast("bigint")
    return j.select("page_id", bounded(100 - 15 * F.col("critical") - 5 * F.col("warning")).alias("google_score"), bounded(100 - 20 * F.coalesce("blocked_bots", F.lit(0)) - none(~F.coalesce(F.col("llms_txt") == "present", F.lit(False))) - none(F.col("schema") == 0)).alias("ai_bot_score"), bounded(100 - F.floor(F.col("gap") * 0.5) - 5 * F.col("mismatches")).alias("render_gap_score"))


def host_scores(profile: DataFrame) -> DataFrame:
    """host, five draft scores of 0 to 10 and their mean, from host profiles."""
    n = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0))
    bounded = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(10)).cast("int")
    cta = 5 + 2 * n("specific_cta") + n("phone_present") - F.when(F.col("n_ctas") > 6, 2).otherwise(0)
    trust = 2 + 2 * n("review_stats") + 2 * n("testimonials") + 2 * n("guarantee") + n("badges") + F.least(F.lit(1), F.floor(F.col("trust_total") / 40))
    page = 3 + 2 * n("has_form") + 2 * n("pricing") + F.least(F.lit(3), F.floor(F.col("avg_words") / 700))
    uiux = 4 + F.when(F.col("hero_frac") >= 0.5, 2).otherwise(0) + n("has_sticky")
    coverage = 2 + F.least(F.lit(6), 2 * n("service_pages")) + F.when(F.col("pages") > 1, 1).otherwise(0)
    scored = profile.select("host", bounded(uiux).alias("ui_ux"), bounded(coverage).alias("coverage"), bounded(page).alias("page"), bounded(cta).alias("cta"), bounded(trust).alias("trust"))
    return scored.withColumn("overall", F.round((F.col("ui_ux") + F.col("coverage") + F.col("page") + F.col("cta") + F.col("trust")) / 5, 1))


def duplicate_ratings(ratings: DataFrame, by: str = "page") -> DataFrame:
    """Per page (or site): entities with a rating, distinct (value, count) pairs, and CRITICAL where three or more share one, OK where they vary."""
    rolled = ratings.where("rating_value is not null").groupBy(by).agg(F.count("*").alias("entities"), F.countDistinct(F.struct("rating_value", "review_count")).alias("signatures"))
    return rolled.withColumn("verdict", F.when((F.col("entities") >= 3) & (F.col("signatures") == 1), "CRITICAL").when(F.col("entities") >= 3, "OK"))


def attribution_reconcile(clicks: DataFrame, sessions: DataFrame, most_gap: float = 0.2) -> DataFrame:
    """page, clicks, sessions, gap, gap_share, off: outbound clicks on the site against sessions that the dashboard has."""
    both = clicks.groupBy("page").agg(F.sum("clicks").alias("clicks")).join(sessions.groupBy("page").agg(F.sum("sessions").alias("sessions")), "page", "full")
    both = both.select("page", F.coalesce("clicks", F.lit(0)).alias("clicks"), F.coalesce("sessions", F.lit(0)).alias("sessions")).withColumn("gap", F.col("clicks") - F.col("sessions"))
    share = F.try_divide(F.abs("gap"), F.greatest("clicks", "sessions"))
    return both.withColumn("gap_share", share).withColumn("off", F.coalesce(share > most_gap, F.lit(False)))


def label_url_mismatch(label: Column, url: Column) -> Column:
    """The words of a label (over three letters, not stop words) that its URL lacks, comma-joined; null if there are none."""
    words = F.filter(F.split(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) > 3) & ~w.isin(LABEL_STOP))
    return F.nullif(F.array_join(F.filter(words, lambda w: ~F.contains(F.lower(F.coalesce(url, F.lit(""))), w)), ","), F.lit(""))


def form_role(tag: Column, kind: Column, name: Column, label: Column) -> Column:
    """What a form field asks for: message, email, phone, name or other."""
    kind = F.lower(F.coalesce(kind, F.lit("")))
    text = F.concat_ws(" ", kind, F.coalesce(name, F.lit("")), F.coalesce(label, F.lit("")))
    return A.first_of([(F.lower(tag) == "textarea", "message"), (kind == "email", "email"), (kind == "tel", "phone"), *[(text.rlike(pattern), role) for role, pattern in ROLES]], "other")


def form_quality(fields: DataFrame) -> DataFrame:
    """Per page its primary form (the one with most fields, of equal ones the first): fields, required, roles, findings of fields (page, form, tag, kind, name, label, required, max_length)."""
    typed = fields.withColumn("role", form_role(F.col("tag"), F.col("kind"), F.col("name"), F.col("label")))
    rolled = typed.groupBy("page", "form").agg(F.count("*").alias("fields"), F.count_if("required").alias("required"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"), F.count_if(F.coalesce(F.col("label"), F.lit("")) == "").alias("unlabelled"), F.count_if((F.col("role") == "phone") & (F.coalesce("kind", F.lit("")) != "tel")).alias("phone_as_text"))
    first = rolled.groupBy("page").agg(F.max_by(F.struct("form", "fields", "required", "roles", "unlabelled", "phone_as_text"), F.struct("fields", -F.col("form"))).alias("f"))
    found = F.concat_ws(";", F.when(F.col("f.fields") > 7, "many fields"), F.when(F.col("f.unlabelled") > 0, "fields without labels"), F.when(F.col("f.phone_as_text") > 0, "phone as text"), F.when(F.col("f.required") == 0, "nothing required"))
    return first.select("page", "f.form", "f.fields", "f.required", "f.roles", found.alias("findings"))


def link_verdicts(links: DataFrame, sunset: list[str]) -> DataFrame:
    """links (page, href, rel, status, final_url) with network and verdict; links to no network and no sunset host stay out."""
    host = F.regexp_replace(F.lower(F.regexp_extract("href", r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")
    old, network = host.isin(sunset), link_network(host)
    rel = F.split(F.lower(F.coalesce("rel", F.lit(""))), r"\s+")
    away = F.col("status").between(300, 399) & F.coalesce(F.col("final_url").rlike(r"(?i)/(login|signin|ap/signin)|^[a-z]+://[^/]+/?$"), F.lit(False))
    verdict = F.when(F.col("status") >= 400, "Dead-fix").when(old, "Re-point").when(away, "Dead-fix").when(~F.array_contains(rel, "sponsored") & ~F.array_contains(rel, "nofollow"), "Add-rel").when(F.col("status") != 200, "Review-manually").otherwise("OK")
    return links.where(network.isNotNull() | old).select("*", network.alias("network"), verdict.alias("verdict"))


def outbound_equity(links: DataFrame) -> DataFrame:
    """page, host, links, untagged, followed, finding: monetised links without sponsored, or many followed links to a host of low authority."""
    host = F.regexp_replace(F.lower(F.regexp_extract("href", r"^[a-zA-Z]+://([^/:?#]+)", 1)), r"^www\.", "")
    rel = F.split(F.lower(F.coalesce("rel", F.lit(""))), r"\s+")
    has = lambda r: F.array_contains(rel, r)
    money = link_network(host).isNotNull()
    rolled = links.groupBy("page", host.alias("host")).agg(F.count("*").alias("links"), F.count_if(money & ~has("sponsored")).alias("untagged"), F.count_if(~money & ~has("nofollow") & ~has("sponsored") & ~has("ugc")).alias("followed"), F.max("authority").alias("authority"))
    finding = F.when(F.col("untagged") > 0, "add sponsored").when((F.col("followed") >= MANY_LINKS) & (F.col("authority") < LOW_AUTHORITY), "equity leak")
    return rolled.withColumn("finding", finding).where("finding is not null").select("page", "host", "links", "untagged", "followed", "finding")


def disclosure_position(pages: DataFrame, marker: str = r"(?i)affiliate (links?|commissions?)|we may earn|paid partnership") -> DataFrame:
    """page_id, disclosure: before or after the first monetised link, missing, or not needed."""
    h = F.coalesce("html", F.lit(""))
    at = lambda pattern: F.when(h.rlike(pattern), F.length(F.element_at(F.split(h, pattern, 2), 1)))
    link = at(r"""(?i)href=["'][^"']*(""" + "|".join(host.replace(".", r"\.") for host, _ in NETWORKS) + ")")
    note = at(marker)
    return pages.select("page_id", F.when(link.isNull(), "not needed").when(note.isNull(), "missing").when(note < link, "before").otherwise("after").alias("disclosure"))


def review_schema_check(pages: DataFrame, review_url: str = r"(?i)/reviews?/|-review/?$") -> DataFrame:
    """url, finding for pages (url, types array, has_score): review pages without Review or Product, an AggregateRating on another page, a score on another page."""
    review, has = F.col("url").rlike(review_url), lambda t: F.coalesce(F.array_contains("types", t), F.lit(False))
    finding = F.when(review & ~has("Review") & ~has("Product"), "review page without schema").when(~review & has("AggregateRating"), "rating on another page").when(~review & F.coalesce("has_score", F.lit(False)), "score on another page")
    return pages.select("url", finding.alias("finding")).where("finding is not null")


def canonical_status(fetched: DataFrame) -> DataFrame:
    """url, status, target, verdict of stored fetches (url, status, location, canonical): where a URL's signals go."""
    plain = lambda c: F.rtrim(F.regexp_replace(F.lower(c), "^https?://(www\\.)?", ""), F.lit("/"))
    own = plain(F.col("canonical")) == plain(F.col("url"))
    verdict = F.when(F.col("status").isNull() | (F.col("status") >= 400), "error").when(F.col("status") >= 300, "redirected").when(F.coalesce("canonical", F.lit("")) == "", "no canonical").when(own, "own canonical").otherwise("consolidated")
    return fetched.select("url", "status", F.when(F.col("status").between(300, 399), F.col("location")).otherwise(F.nullif("canonical", F.lit(""))).alias("target"), verdict.alias("verdict"))


def log_sources(parsed: DataFrame, roles: DataFrame) -> DataFrame:
    """role, files, rows, unique_urls, main from parsed requests (file, role, url, ok) and ``primary_roles``; URLs count once a role."""
    rolled = parsed.groupBy("role").agg(F.countDistinct("file").alias("files"), F.count_if("ok").alias("rows"), F.countDistinct(F.when(F.col("ok"), F.col("url"))).alias("unique_urls"))
    return rolled.join(F.broadcast(roles.select("role", "main")), "role", "left")
