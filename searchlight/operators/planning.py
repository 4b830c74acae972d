"""Keyword planning: what a keyword asks for, which pages a topic deserves, and which rows are noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlight.functions import agents as A

# Anchors in order, their patterns, categories and titles ({V} is the value's name).
ANCHORS = [
    ("install_cost", r"install.*cost|cost.*install", "Cost", "How Much Does {V} Installation Cost?"),
    ("replace_cost", r"replac.*cost|cost.*replac", "Cost", "{V} Replacement Cost"),
    ("repair_cost", r"repair.*cost|cost.*repair", "Cost", "How Much Does {V} Repair Cost?"),
    ("cost", r"\bcost\b|\bprice\b|how much|\bcheap\b", "Cost", "How Much Does {V} Cost?"),
    ("leak", r"\bleak|leaking|dripping", "Problem", "Why Is My {V} Leaking?"),
    ("not_working", r"not working|won.?t (start|turn)|stopped", "Trouble", "{V} Not Working: Causes & Fixes"),
    ("noise", r"\b(noise|loud|rattl\w*|bang\w*|hum(ming|s)?|rumbl\w*|squeal\w*|grind\w*|vibrat\w*)\b", "Problem", "{V} Making Noise: Causes & Fixes"),
    ("frozen", r"frozen|freezing|freeze up|ice[ds]? up", "Trouble", "{V} Freezing Up: What to Do"),
    ("symptoms", r"symptom|\bsigns\b|failing|gone bad|\btest\b", "Symptoms", "Signs of a Bad {V} (and How to Test)"),
    ("unclog", r"unclog|\bclog|blocked|unblock", "Fix", "How to Unclog a {V}"),
    ("clean", r"\bclean(ing)?\b", "Maint", "How to Clean a {V}"),
    ("maintain", r"mainten\w*|tune.?up|\bservice\b", "Maint", "{V} Maintenance Guide"),
    ("install", r"\binstall\w*|\bmount\b", "Install", "How to Install a {V}"),
    ("replace", r"\breplac\w*|\bswap\b", "Install", "When & How to Replace a {V}"),
    ("repair", r"\brepair\b|\bfix(ing|ed)?\b|troubleshoot", "Fix", "How to Fix a {V}"),
    ("sizing", r"\bsizes?\b|dimension|capacity|how many", "Types", "{V} Sizes & Sizing Guide"),
    ("comparison", r"\bvs\b|versus|difference between", "Types", "{V} vs Alternatives: Which Is Better?"),
    ("types", r"\btypes?\b|\bkinds?\b", "Types", "Types of {V}"),
    ("best", r"\bbest\b|top \d|\brated\b|reviews?", "Buying", "The Best {V}s (Buying Guide)"),
    ("efficiency", r"efficien\w*|\bseer\b|energy|\bsave\b", "Buying", "Most Efficient {V}s: Are They Worth It?"),
    ("prevent", r"prevent|avoid|winteriz\w*", "Maint", "How to Prevent {V} Problems"),
    ("cause", r"\bcause[sd]?\b|\breason\b|\bwhy\b", "Problem", "What Causes {V} Problems?"),
    ("damage", r"insurance|warranty|does .* cover|worth it", "Problem", "Is {V} Damage Covered? Costs & Consequences"),
    ("how_works", r"how (does|do) .* work", "General", "How Does a {V} Work?"),
    ("code", r"\bcode\b|regulation|\bpermit\b", "General", "{V} Codes & Requirements"),
    ("career", r"licens\w*|certif\w*|apprentice|salary", "General", "{V}: Licensing, Training & Career"),
]
GENERAL = ("general", "General", "{V}: Complete Guide")
BRANDS = ("brands", "Buying", "Best {V} Brands Compared")
# The anchors that a type of value may have only, or may never have; other types may have all.
ONLY = {
    "SERVICE": {"cost", "install_cost", "replace_cost", "repair_cost", "maintain", "best", "efficiency", "career", "code", "general", "damage", "cause", "how_works"},
    "CERT": {"career", "cost", "code"},
    "STANDARD": {"code"},
}
NEVER = {
    "COMPONENT": {"unclog"},
    "FIXTURE": {"unclog"},
    "MATERIAL": {"unclog", "cause", "symptoms"},
    "PROBLEM": {"install", "best"},
    "EMERGENCY": {"install", "best"},
    "TOOL": {"install"},
    "METHOD": {"repair", "symptoms"},
    "ROLE": {"install", "repair", "repair_cost"},
}
BRAND_TYPES = ("FIXTURE", "COMPONENT", "MATERIAL", "TOOL", "DRAIN")
GENERIC_ANCHORS = ["click here", "here", "read more", "learn more", "this article", "website", "more", "link", "visit"]


def keyword_anchor(keywords: DataFrame, brands: tuple[str, ...] = ()) -> DataFrame:
    """keywords (keyword, value) with anchor, category and title; the first pattern that matches decides."""
    rows = [(F.lower("keyword").rlike(pattern), (name, category, title)) for name, pattern, category, title in ANCHORS]
    if brands:
        rows.append((F.lower("keyword").rlike(r"\b(" + "|".join(map(_quoted, brands)) + r")\b"), BRANDS))
    pick = lambda i: A.first_of([(c, v[i]) for c, v in rows], GENERAL[i])
    return keywords.select("*", pick(0).alias("anchor"), pick(1).alias("category"), F.replace(pick(2), F.lit("{V}"), F.col("value")).alias("title"))


def _quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in word.lower())


def forbidden(spark) -> DataFrame:
    """(value_type, anchor) that do not go together, at most a few hundred rows made by rule."""
    names = {name for name, *_ in ANCHORS} | {GENERAL[0], BRANDS[0]}
    types = {*ONLY, *NEVER, "DRAIN", "SYSTEM", "SPACE"}
    rows = {(t, a) for t, only in ONLY.items() for a in names - only} | {(t, a) for t, never in NEVER.items() for a in never}
    rows |= {(t, "unclog") for t in types - {"DRAIN"}} | {(t, "brands") for t in types - set(BRAND_TYPES)}
    return spark.createDataFrame(sorted(rows), "value_type string, anchor string")


def value_type_gate(anchored: DataFrame) -> DataFrame:
    """The rows of anchored (value_type, anchor) whose type may have their anchor."""
    return anchored.join(F.broadcast(forbidden(anchored.sparkSession)), ["value_type", "anchor"], "left_anti")


def noise_flags(anchored: DataFrame, foreign: list[str]) -> DataFrame:
    """anchored (value, value_type, anchor, title, keyword) with reason: a doubled word, another product's term, a type that may not have the anchor, or null.

    Rows stay; what is to be reviewed is where reason is not null.
    """
    both = F.concat_ws("\n", F.lower("title"), F.lower("keyword"))
    doubled = F.col("title").rlike(r"(?i)\b(\w+)\s+\1\b") | F.col("keyword").rlike(r"(?i)\b(\w+)\s+\1\b")
    term = F.try_element_at(F.filter(F.array(*map(F.lit, foreign)), lambda t: ~F.contains(F.lower("value"), t) & F.contains(both, t)), F.lit(1))
    mismatch = (F.col("value_type") == "SERVICE") & ~F.col("anchor").isin(sorted(ONLY["SERVICE"]))
    return anchored.withColumn("reason", F.when(doubled, "doubled word").when(term.isNotNull(), F.concat(F.lit("foreign term: "), term)).when(mismatch, "anchor does not fit a service"))


def qdp_decision(candidates: DataFrame) -> DataFrame:
    """candidates (volume, different_entity, low_similarity, pattern, serp_verdict) with score, decision and undecided.

    A null volume counts as not passed and leaves the row undecided. The search results decide borderline rows.
    """
    passed = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int")
    score = passed("volume") + passed("different_entity") + passed("low_similarity") + passed("pattern")
    serp = F.when(F.col("score").between(2, 3), F.col("serp_verdict"))
    variant = (passed("different_entity") == 0) & (passed("low_similarity") == 0)
    decision = F.when(variant, "variant").when(serp == "dedicated", "page").when(serp == "parent", "heading").when(F.col("score") >= 3, "page").when(F.col("score") == 2, "heading").otherwise("dropped")
    return candidates.withColumn("score", score).withColumn("decision", decision).withColumn("undecided", F.col("volume").isNull())


def page_plan_counts(decided: DataFrame) -> DataFrame:
    """Per entity, attribute and value: blog and landing pages planned, both, and rows under review (reason)."""
    key = ["entity", "attribute", "value"]
    blog = F.lower("page_type").startswith("blog")
    planned = decided.where("decision = 'page' and reason is null").groupBy(*key).agg(F.count_if(blog).alias("blog"), F.count_if(~blog).alias("landing"))
    noise = decided.where("reason is not null").groupBy(*key).agg(F.count("*").alias("noise"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return planned.join(noise, key, "full").select(*key, none("blog"), none("landing"), (F.coalesce("blog", F.lit(0)) + F.coalesce("landing", F.lit(0))).alias("total"), none("noise"))


def anchor_class5(anchor: Column, brand: list[str], targets: list[str]) -> Column:
    """naked-URL, branded, exact-match, generic or partial-match; generic also where no target word is in the anchor."""
    a = F.trim(F.lower(F.coalesce(anchor, F.lit(""))))
    words = sorted({w for t in targets for w in t.lower().split() if len(w) > 3})
    return (
        F.when(a.rlike(r"^(https?://|www\.)|^[a-z0-9-]+(\.[a-z0-9-]+)+(/\S*)?$"), "naked-URL")
        .when(a.rlike(r"\b(" + "|".join(map(_quoted, brand)) + r")\b"), "branded")
        .when(a.isin([t.lower() for t in targets]), "exact-match")
        .when(a.isin(GENERIC_ANCHORS) | (a == ""), "generic")
        .when(a.rlike(r"\b(" + "|".join(map(_quoted, words)) + r")\b"), "partial-match")
        .otherwise("generic")
    )


def brand_leakage(pages: DataFrame, brand: Column, worst_position: float = 1.5, most_ctr: float = 0.01) -> DataFrame:
    """page, query, clicks, impressions, position of brand queries that an inner page shows first and nobody clicks."""
    rolled = pages.where(brand).groupBy("page", "query").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), (F.sum(F.col("position") * F.col("impressions")) / F.sum("impressions")).alias("position"))
    inner = F.rtrim(A.url_path(F.col("page")), F.lit("/")) != ""
    return rolled.where(inner & (F.col("position") <= worst_position) & (F.col("clicks") <= most_ctr * F.col("impressions")))


