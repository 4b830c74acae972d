"""The verdict on each pair of competing pages, the evidence for it and the plan that follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlight.config import OverlapConfig
from searchlight.operators import intents as I
from searchlight.operators import pairs as P
from searchlight.operators import search as S
from searchlight.storage import written

CFG = OverlapConfig()
# The order of an action plan's statuses.
PRIORITY = {"duplicate": 1, "ongoing cannibal": 2, "affected_handoff (loser)": 3, "redundant duplicate": 4, "differentiate : keep both": 5, "overlap watch": 6, "cluster winner": 7, "affected_handoff (winner)": 7, "standalone": 8, "standalone (0 clicks)": 9}


def _yes(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def peer_gate(pairs: DataFrame, pages: DataFrame) -> DataFrame:
    """The pairs (a, b) whose pages may compete: one peer group that is resolved, or a hub that covers the other's section.

    pages has page, peer_group, is_hub, section, covers.
    """
    side = lambda s: pages.select(F.col("page").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("peer_group", "is_hub", "section", "covers")])
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    hub = lambda x, y: _yes(f"is_hub_{x}") & _yes(F.array_contains(f"covers_{x}", F.col(f"section_{y}")))
    same = F.col("peer_group_a").eqNullSafe(F.col("peer_group_b"))
    peer = F.when(same, ~F.coalesce("peer_group_a", F.lit("")).startswith("unresolved")).otherwise(hub("a", "b") | hub("b", "a"))
    return joined.where(peer).select(*pairs.columns)


def assess_duplicate(twin: Column, topic: Column, content: Column, cfg: OverlapConfig = CFG) -> Column:
    """Whether two pages are one page twice: content nearly alike, or twin URLs on one topic that content does not tell apart."""
    apart = F.coalesce(content < cfg.dup_twin_content_min, F.lit(False))
    return F.coalesce(content >= cfg.dup_content_min, F.lit(False)) | (F.coalesce(twin, F.lit(False)) & F.coalesce(topic >= cfg.dup_twin_topic_min, F.lit(False)) & ~apart)


def shared_queries(weekly: DataFrame, universe: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, shared: how many queries both pages have in the weekly series, or where they have none, in the universe."""
    p = pairs.select("a", "b").distinct()

    def common(rows: DataFrame, name: str) -> DataFrame:
        own = rows.select("page", "query").distinct()
        return p.join(own.withColumnRenamed("page", "a"), "a").join(own.withColumnRenamed("page", "b"), ["b", "query"]).groupBy("a", "b").agg(F.count("*").alias(name))

    return p.join(common(weekly, "w"), ["a", "b"], "left").join(common(universe, "u"), ["a", "b"], "left").select("a", "b", F.coalesce("w", "u", F.lit(0)).alias("shared"))


def apply_topics(matrix: DataFrame, topics: DataFrame) -> DataFrame:
    """The search universe with queries renamed to their topics (topics: query, topic); unnamed topics, those of one query and unknown queries change nothing."""
    rows = topics.select(F.lower(F.trim("query")).alias("query"), F.lower(F.trim("topic")).alias("topic")).where("topic != '' and query != ''").distinct()
    many = rows.groupBy("topic").agg(F.count("*").alias("n")).where("n > 1").select("topic")
    named = rows.join(many, "topic").groupBy("query").agg(F.max("topic").alias("topic"))
    return S.search_universe(matrix.join(named, "query", "left").withColumn("query", F.coalesce("topic", "query")).drop("topic"))


def max_urls_cap(pages: DataFrame, most: int) -> DataFrame:
    """page, impressions, kept: the pages with the most impressions are kept, the others listed."""
    top = pages.orderBy(F.desc("impressions"), "page").limit(most).select("page", F.lit(True).alias("kept"))
    return pages.join(top, "page", "left").select("page", "impressions", _yes("kept").alias("kept"))


def pair_evidence(universe: DataFrame, matrix: DataFrame, cfg: OverlapConfig = CFG) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The shortlist, and for its pairs the parity of each query and the hand-offs of each query.

    All three are written, as verdicts read them several times: a plan that held each of them as often would outgrow the driver.
    universe and matrix are read several times as well, so they should be tables or written.
    """
    short = written(P.pairs_per_url_cap(P.shortlist_pairs(universe, cfg), cfg))
    aligned = P.align_weekly(written(S.weekly_series(matrix)), short)
    return short, written(P.parity_test(aligned, matrix.agg(F.max("date")).scalar(), cfg)), written(I.handoff_queries(aligned, cfg))


def pair_verdicts(universe: DataFrame, matrix: DataFrame, cfg: OverlapConfig = CFG, *, evidence: tuple[DataFrame, DataFrame, DataFrame] | None = None, intents: DataFrame | None = None, shares: DataFrame | None = None, content: DataFrame | None = None) -> DataFrame:
    """a, b, the evidence and the verdict. In this order: intent, duplicate, surface, hand-off, ongoing, guarded duplicate, redundant, overlap to watch.

    A page that earns most of its clicks on searches the other lacks is not merged but told apart. intents (page, intent), shares
    (page, non_web_share) and content (a, b, content_sim) are optional; what is absent decides nothing. evidence is what ``pair_evidence`` gave, if it is there.
    """
    short, parity, handoffs = evidence or pair_evidence(universe, matrix, cfg)
    key = ["a", "b"]
    joined = short.drop("shared").join(shared_queries(matrix, universe, short), key)
    joined = joined.join(P.detect_ongoing(parity, cfg), key, "left").join(P.assess_redundant(parity, cfg).select(*key, "redundant", F.col("weak_side").alias("redundant_side")), key, "left")
    joined = joined.join(P.unique_click_share(universe, short), key, "left").join(P.url_twins(matrix).withColumn("twin", F.lit(True)), key, "left")
    joined = joined.join(I.detect_handoff(handoffs).select(*key, "direction", "handoff_date"), key, "left")
    joined = joined.join(I.surface_filter(short, shares, cfg).select(*key, "same_surface"), key, "left") if shares is not None else joined.withColumn("same_surface", F.lit(True))
    joined = joined.join(content.select(*key, "content_sim"), key, "left") if content is not None else joined.withColumn("content_sim", F.lit(None).cast("double"))
    if intents is not None:
        for s in "ab":
            joined = joined.join(intents.select(F.col("page").alias(s), F.col("intent").alias(f"intent_{s}")), s, "left")
        compatible = I.intents_compatible(F.col("intent_a"), F.col("intent_b"))
    else:
        compatible = F.lit(True)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    distinct = F.greatest(zero("share_a"), zero("share_b")) >= cfg.distinct_page_unique_share
    duplicate = assess_duplicate(F.col("twin"), F.col("topic_cosine"), F.col("content_sim"), cfg)
    ongoing, redundant, handoff = _yes("ongoing"), _yes("redundant"), F.col("direction").isNotNull()
    watch = (F.col("shared") >= cfg.overlap_watch_min_shared) & ((F.col("topic_cosine") >= cfg.overlap_watch_topic_min) | _yes(F.col("content_sim") >= cfg.overlap_watch_content_min))
    verdict = (
        F.when(~compatible, "not_cannibal")
        .when(duplicate & ~distinct, "duplicate")
        .when(~F.coalesce("same_surface", F.lit(True)) & (ongoing | handoff), "not_cannibal")
        .when(handoff, "affected_handoff")
        .when(ongoing, F.when(distinct, "differentiate").otherwise("ongoing"))
        .when(duplicate, "differentiate")
        .when(redundant, F.when(distinct, "differentiate").otherwise("redundant_duplicate"))
        .when(watch, "overlap_watch")
        .otherwise("not_cannibal")
    )
    own = F.when(zero("share_a") >= zero("share_b"), F.col("a")).otherwise(F.col("b"))
    rows = joined.withColumn("verdict", verdict)
    loser = F.when(F.col("verdict") == "affected_handoff", F.when(F.col("direction") == "a_to_b", F.col("a")).otherwise(F.col("b")))
    return rows.select(*key, "shared", "score", "topic_cosine", F.coalesce("qualifying", F.lit(0)).alias("qualifying"), F.coalesce("qualifying_clicks", F.lit(0)).alias("qualifying_clicks"), ongoing.alias("ongoing"), redundant.alias("redundant"), "redundant_side", "direction", "handoff_date", loser.alias("loser"), F.when(F.col("verdict") == "differentiate", own).alias("distinct_page"), "verdict")


def evidence_rows(verdicts: DataFrame, parity: DataFrame, handoffs: DataFrame) -> DataFrame:
    """a, b, verdict, query, kind: each query that stands for a verdict, by live parity or by a hand-off in the verdict's direction."""
    found = verdicts.where("verdict != 'not_cannibal'").select("a", "b", "verdict", "direction")
    live = found.join(parity.where("qualifies"), ["a", "b"]).select("a", "b", "verdict", "query", F.lit("ongoing").alias("kind"))
    moved = found.join(handoffs.where("week is not null"), ["a", "b", "direction"]).select("a", "b", "verdict", "query", F.lit("handoff").alias("kind"))
    return live.unionByName(moved)


def action_plan(pages: DataFrame, verdicts: DataFrame, winners: DataFrame) -> DataFrame:
    """page, status, target, verdict, clicks_window, priority: one row a page, by the first stage that handles it.

    Stages: clusters (winners: page, primary, winner), where a member follows its verdict with the winner or else with
    the primary; then redundant, distinct and watched pages in the order of their pairs' scores; then the rest.
    """
    key = F.array_sort(F.array("x", "y"))
    v = verdicts.select(F.array_sort(F.array("a", "b")).alias("pair"), "verdict", "loser")
    sizes = winners.groupBy("primary").agg(F.count("*").alias("n"), F.max(F.when(F.col("winner"), F.col("page"))).alias("best")).where("n > 1")
    clustered = winners.join(sizes, "primary")
    first = clustered.where("winner").select("page", F.lit(1).alias("stage"), F.lit(0.0).alias("rank"), F.lit("cluster winner").alias("status"), F.col("page").alias("target"), F.lit("cluster_winner").alias("verdict"))
    members = clustered.where("not winner")
    with_best = members.select("page", "best", F.lit(0.0).alias("rank"), F.col("page").alias("x"), F.col("best").alias("y"))
    with_primary = members.where("page != primary").select("page", "best", F.lit(1.0).alias("rank"), F.col("page").alias("x"), F.col("primary").alias("y"))
    known = with_best.unionByName(with_primary).withColumn("pair", key).join(v, "pair")
    handed = F.col("verdict") == "affected_handoff"
    status = F.when(handed, F.when(F.col("loser") == F.col("page"), "affected_handoff (loser)").otherwise("affected_handoff (winner)")).when(F.col("verdict") == "duplicate", "duplicate").otherwise("ongoing cannibal")
    other = F.element_at(F.array_except("pair", F.array("loser")), 1)
    target = F.when(handed, F.when(F.col("loser") == F.col("page"), other).otherwise(F.col("page"))).otherwise(F.col("best"))
    second = known.select("page", F.lit(2).alias("stage"), "rank", status.alias("status"), target.alias("target"), "verdict")
    clicks = pages.select("page", "clicks_window")
    flat = verdicts.where("verdict in ('redundant_duplicate', 'differentiate', 'overlap_watch')").join(clicks.withColumnsRenamed({"page": "a", "clicks_window": "ca"}), "a", "left").join(clicks.withColumnsRenamed({"page": "b", "clicks_window": "cb"}), "b", "left")
    weak = F.when(F.col("verdict") == "redundant_duplicate", F.when(F.col("redundant_side") == "a", F.col("a")).otherwise(F.col("b"))).when(F.col("verdict") == "differentiate", F.col("distinct_page")).otherwise(F.when(F.coalesce("ca", F.lit(0)) <= F.coalesce("cb", F.lit(0)), F.col("a")).otherwise(F.col("b")))
    flat = flat.withColumn("page", weak).withColumn("other", F.when(F.col("page") == F.col("a"), F.col("b")).otherwise(F.col("a")))
    names = F.when(F.col("verdict") == "redundant_duplicate", "redundant duplicate").when(F.col("verdict") == "differentiate", "differentiate : keep both").otherwise("overlap watch")
    third = flat.select("page", F.lit(3).alias("stage"), (-F.col("score")).alias("rank"), names.alias("status"), F.when(F.col("verdict") != "differentiate", F.col("other")).alias("target"), "verdict")
    fourth = pages.select("page", F.lit(4).alias("stage"), F.lit(0.0).alias("rank"), F.when(F.col("clicks_window") > 0, "standalone").otherwise("standalone (0 clicks)").alias("status"), F.lit(None).cast("string").alias("target"), F.lit("standalone").alias("verdict"))
    rows = first.unionByName(second).unionByName(third).unionByName(fourth)
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("page").orderBy("stage", "rank", "status", "target"))).where("r = 1").drop("r", "stage", "rank")
    priority = F.when(F.lit(False), 0)
    for name, n in PRIORITY.items():
        priority = priority.when(F.col("status") == name, n)
    return best.join(clicks, "page").select("page", "status", "target", "verdict", "clicks_window", priority.alias("priority")).orderBy("priority", F.desc("clicks_window"), "page")


def plan_summary(plan: DataFrame) -> DataFrame:
    """One row: pages, actionable pages (priority 6 or better), clicks at stake, their share of all clicks, clusters, pages without clicks."""
    act = F.col("priority") <= 6
    at_stake = F.sum(F.when(act, F.col("clicks_window")).otherwise(0))
    return plan.agg(F.count("*").alias("pages"), F.count_if(act).alias("actionable"), at_stake.alias("clicks_at_stake"), F.coalesce(F.try_divide(at_stake, F.sum("clicks_window")), F.lit(0.0)).alias("share"), F.count_if(F.col("status") == "cluster winner").alias("clusters"), F.count_if(F.col("clicks_window") == 0).alias("without_clicks"))
