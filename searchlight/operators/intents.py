"""Search intent of pages, search surfaces, hand-offs from one page to another, and what they lose."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlight.config import OverlapConfig
from searchlight.operators.pairs import upper_median
from searchlight.operators.search import weighted_position

CFG = OverlapConfig()
# Intents by URL pattern, in the order in which they are tried, and by query words, in the order of ties.
URL_PATTERNS = [
    ("transactional", r"/(shop|store|product|products|buy|checkout|cart|pricing|plans|order)(/|$)"),
    ("news", r"/(news|press|press-release)/"),
    ("informational", r"/(blog|guide|guides|tutorial|tutorials|docs?|documentation|learn|resources?|knowledge-base|kb|wiki|glossary|how-to)(/|$)"),
    ("informational", r"/(what-is|how-to)-"),
    ("commercial", r"/(best|top|review|reviews|compare|comparison|vs|versus)[-/]"),
    ("commercial", r"-(vs|versus|review|comparison)-"),
    ("navigational", r"/(about|contact|team|careers?|jobs?|privacy|terms|tos|legal|login|signin|signup|register)(/|$)"),
    ("informational", r"/20\d{2}/\d{1,2}/\d{1,2}/[a-z0-9]"),
]
TOKENS = {
    "transactional": ["buy", "price", "pricing", "cost", "cheap", "discount", "deal", "coupon", "shop", "order", "subscribe", "signup", "plans", "trial", "demo"],
    "informational": ["how", "what", "why", "when", "where", "who", "guide", "tutorial", "explained", "definition", "meaning", "examples", "tips", "steps", "learn", "introduction", "beginners"],
    "commercial": ["best", "top", "review", "reviews", "vs", "versus", "comparison", "alternative", "alternatives", "rating", "ratings"],
    "news": ["news", "today", "latest", "breaking", "update", "updates", "announcement", "announces"],
}
# Surfaces that look like plain results.
WEB_LIKE = ["", "AMP_BLUE_LINK", "AMP_TOP_STORIES", "PAGE_EXPERIENCE"]


def path_of(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), "[?#].*$", ""))


def rule_intent(rows: DataFrame) -> DataFrame:
    """page, intent, confidence over (page, query): the URL decides, else a vote of the page's queries, else unknown."""
    words = F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    votes = [F.count_if(F.arrays_overlap(words, F.array(*map(F.lit, v)))).alias(k) for k, v in TOKENS.items()]
    rolled = rows.select("page", "query").distinct().groupBy("page").agg(F.count_if(F.size(words) > 0).alias("n"), *votes)
    path = path_of(F.col("page"))
    by_url = F.when(path.isin("", "/"), "navigational")
    for intent, pattern in URL_PATTERNS:
        by_url = by_url.when(path.rlike("(?i)" + pattern), intent)
    most = F.greatest(*TOKENS)
    top = F.when(F.lit(False), "")
    for k in TOKENS:
        top = top.when(F.col(k) == most, k)
    share = F.coalesce(F.try_divide(most, F.col("n")), F.lit(0.0))
    rolled = rolled.withColumn("u", by_url).withColumn("t", top).withColumn("share", share)
    return rolled.select("page", F.coalesce("u", F.when(F.col("share") >= 0.2, F.col("t")), F.lit("unknown")).alias("intent"), F.when(F.col("u").isNotNull() | (F.col("share") >= 0.4), "high").when(F.col("share") >= 0.2, "med").otherwise("none").alias("confidence"))


def intents_compatible(a: Column, b: Column) -> Column:
    """Whether pages of two intents can compete; unknown goes with all, informational with news and commercial."""
    unknown = F.coalesce(a, F.lit("unknown")).isin("unknown", "") | F.coalesce(b, F.lit("unknown")).isin("unknown", "")
    pair = F.array_sort(F.array(a, b))
    mixed = (pair == F.array(F.lit("informational"), F.lit("news"))) | (pair == F.array(F.lit("commercial"), F.lit("informational")))
    return unknown | F.coalesce(a == b, F.lit(False)) | F.coalesce(mixed, F.lit(False))


def appearance_share(appearance: DataFrame, totals: DataFrame) -> DataFrame:
    """page, total, web_share, non_web_share, top_surface. appearance: page, surface, impressions; plain results are the rest of a page's total."""
    rows = appearance.groupBy("page", F.coalesce("surface", F.lit("")).alias("surface")).agg(F.sum("impressions").alias("i"))
    rolled = rows.groupBy("page").agg(F.sum("i").alias("enriched"), F.sum(F.when(F.col("surface").isin(WEB_LIKE), F.col("i")).otherwise(0)).alias("like"), F.sum(F.when(F.col("surface") == "", F.col("i")).otherwise(0)).alias("blank"), F.max(F.when(F.col("surface") != "", F.struct("i", "surface"))).alias("top"))
    joined = rolled.join(totals.select("page", F.col("impressions").alias("t")), "page", "left")
    m = joined.withColumn("total", F.greatest(F.coalesce("t", "enriched"), "enriched", F.lit(1)))
    plain = F.col("total") - F.col("enriched")
    top = F.when(F.col("top").isNull() | (plain + F.col("blank") >= F.col("top.i")), "WEB").otherwise(F.col("top.surface"))
    return m.select("page", "total", ((plain + F.col("like")) / F.col("total")).alias("web_share"), ((F.col("enriched") - F.col("like")) / F.col("total")).alias("non_web_share"), top.alias("top_surface"))


def surface_filter(pairs: DataFrame, shares: DataFrame, cfg: OverlapConfig = CFG) -> DataFrame:
    """a, b, delta, same_surface: pages on different surfaces do not compete; a page without data counts as plain."""
    s = lambda x: shares.select(F.col("page").alias(x), F.col("non_web_share").alias(f"n{x}"))
    joined = pairs.select("a", "b").join(s("a"), "a", "left").join(s("b"), "b", "left").fillna(0.0, ["na", "nb"])
    delta = F.abs(F.col("na") - F.col("nb"))
    limit = cfg.serp_non_web_appearance_dominance
    different = ((F.col("na") >= limit) != (F.col("nb") >= limit)) & (delta >= cfg.serp_attribution_min_delta)
    return joined.select("a", "b", delta.alias("delta"), (~different).alias("same_surface"))


def _ranks(x: np.ndarray) -> np.ndarray:
    below = (x[:, None] > x[None, :]).sum(1)
    return below + ((x[:, None] == x[None, :]).sum(1) + 1) / 2


def _smooth(x: np.ndarray, width: int) -> np.ndarray:
    total = np.cumsum(np.concatenate([[0.0], x]))
    end = np.arange(1, len(x) + 1)
    begin = np.maximum(end - width, 0)
    return (total[end] - total[begin]) / (end - begin)


def crossover(clicks_a: np.ndarray, clicks_b: np.ndarray, cfg: OverlapConfig = CFG, least: float = 5) -> tuple[int | None, str]:
    """The week (by number) at which b takes over from a for good, or why there is none."""
    n, width, quiet = len(clicks_a), cfg.handoff_smoothing_weeks, cfg.handoff_post_silence_weeks
    if n < 8:
        return None, "few weeks"
    a, b = _smooth(clicks_a, width), _smooth(clicks_b, width)
    peak = int(a.argmax())
    if a[peak] < least:
        return None, "low peak"
    if n - peak < quiet:
        return None, "late peak"
    later = peak + int(b[peak:].argmax())
    if b[later] < least:
        return None, "low later peak"
    over = [i for i in range(peak, later + 1) if b[i] >= a[i] and b[i] >= least / 2]
    if not over:
        return None, "no crossover"
    at = over[0]
    after = clicks_a[at + 1 : at + 1 + quiet]
    if len(after) < quiet:
        return None, "few weeks after"
    if _smooth(after, width).mean() > 0.2 * a[peak]:
        return None, "not silent"
    if ((clicks_a[peak : at + 1] > 0) & (clicks_b[peak : at + 1] > 0)).sum() < cfg.handoff_min_coexistence_weeks:
        return None, "no coexistence"
    x, y = _ranks(clicks_a[peak : later + 1]), _ranks(clicks_b[peak : later + 1])
    r = float(np.corrcoef(x, y)[0, 1]) if len(x) >= 4 and x.std() > 0 and y.std() > 0 else 0.0
    return (at, "handoff") if r <= cfg.handoff_min_anticorrelation else (None, "no anticorrelation")


def handoff_queries(aligned: DataFrame, cfg: OverlapConfig = CFG) -> DataFrame:
    """a, b, query, direction, week, reason over aligned weekly rows, in both directions. A query's weeks are one short array."""

    def run(batches):
        for batch in batches:
            out = {k: [] for k in ("a", "b", "query", "direction", "week", "reason")}
            for row in batch.to_pylist():
                ca, cb = (np.array([w[k] for w in row["w"]], float) for k in ("clicks_a", "clicks_b"))
                for direction, x, y in (("a_to_b", ca, cb), ("b_to_a", cb, ca)):
                    at, reason = crossover(x, y, cfg)
                    for k, v in (("a", row["a"]), ("b", row["b"]), ("query", row["query"]), ("direction", direction), ("week", None if at is None else row["w"][at]["week"]), ("reason", reason)):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.date32() if k == "week" else pa.string()) for k, v in out.items()], list(out))

    weeks = aligned.groupBy("a", "b", "query").agg(F.array_sort(F.collect_list(F.struct("week", "clicks_a", "clicks_b"))).alias("w"))
    return weeks.mapInArrow(run, "a string, b string, query string, direction string, week date, reason string")


def detect_handoff(queries: DataFrame) -> DataFrame:
    """a, b, direction, queries, handoff_date: the direction with more queries, a to b on a tie; the date is their upper median."""
    rolled = queries.where("week is not null").groupBy("a", "b", "direction").agg(F.count("*").alias("queries"), upper_median(F.collect_list("week")).alias("handoff_date"))
    best = rolled.groupBy("a", "b").agg(F.max_by(F.struct("direction", "queries", "handoff_date"), F.struct("queries", (F.col("direction") == "a_to_b").alias("first"))).alias("x"))
    return best.select("a", "b", "x.direction", "x.queries", "x.handoff_date")


def leakage(weekly: DataFrame, handoffs: DataFrame, end: Column, cfg: OverlapConfig = CFG) -> DataFrame:
    """Per hand-off (loser, winner, handoff_date): clicks before and after, lost, retained and new queries, severity.

    Before is the loser's window from 180 to 30 days ahead of the hand-off, after the winner's from 30 days past it.
    """
    d = F.col("handoff_date")
    window = lambda side, lo, hi: handoffs.join(weekly.withColumnRenamed("page", side), side).where((F.col("week") >= lo) & (F.col("week") <= hi)).groupBy("loser", "winner", "query").agg(F.sum("clicks").alias("clicks"), weighted_position().alias("position"))
    before = window("loser", F.date_sub(d, 180), F.date_sub(d, 30)).select("loser", "winner", "query", F.col("clicks").alias("pre"), F.col("position").alias("pre_position"))
    after = window("winner", F.date_add(d, 30), end).select("loser", "winner", "query", F.col("clicks").alias("post"), F.col("position").alias("post_position"))
    both = before.join(after, ["loser", "winner", "query"], "full").fillna(0, ["pre", "post"])
    rolled = both.groupBy("loser", "winner").agg(
        F.sum("pre").alias("clicks_pre"),
        F.sum("post").alias("clicks_post"),
        F.count_if((F.col("pre") > 0) & (F.col("post") <= 0)).alias("lost"),
        F.count_if((F.col("pre") > 0) & (F.col("post") > 0)).alias("retained"),
        F.count_if((F.col("pre") <= 0) & (F.col("post") > 0)).alias("new"),
        F.count_if((F.col("pre") > 0) & (F.col("post") > 0) & (F.col("post_position") > F.col("pre_position") + 2)).alias("regressions"),
    )
    change = F.coalesce(F.try_divide(F.col("clicks_post") - F.col("clicks_pre"), F.col("clicks_pre")), F.lit(0.0))
    return rolled.withColumn("change", change).withColumn("severity", F.when(change <= -cfg.leakage_critical_pct, "critical").when(change <= -cfg.leakage_warning_pct, "warning").otherwise("none"))


def redirect_plan(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """loser, winner, staged: a newer page that grows while the winner does not is not redirected at once."""
    p = lambda s: pages.select(F.col("page").alias(s), F.col("trend").alias(f"t_{s}"), F.col("first_click").alias(f"f_{s}"))
    joined = moves.select("loser", "winner").join(p("loser"), "loser", "left").join(p("winner"), "winner", "left")
    rising = F.col("t_loser").contains("Positive") & ~F.coalesce(F.col("t_winner"), F.lit("")).contains("Positive") & (F.col("f_loser") > F.col("f_winner"))
    return joined.select("loser", "winner", F.coalesce(rising, F.lit(False)).alias("staged"))
