"""Queries over verdicts, hand-offs, clusters and plans of competing pages, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlight import fixtures
from searchlight.catalog import pairs as CP
from searchlight.catalog import search as CS
from searchlight.operators import clusters as C
from searchlight.operators import intents as I
from searchlight.operators import pairs as P
from searchlight.operators import search as S
from searchlight.operators import verdicts as V
from searchlight.storage import written

_DENSE = fixtures.cte("fx_dense")
_TAIL = CP.PARITY.removeprefix(_DENSE + ", ")
_COS = CP._cos("fx_dense").removeprefix(CP._uni("fx_dense") + ", ")
_MEANS = lambda x: f"list_transform(range(1, len({x}) + 1), lambda i: list_avg({x}[greatest(i - 3, 1):i]))"
_RANKS = lambda x: f"list_transform({x}, lambda v: len(list_filter({x}, lambda u: u < v)) + (len(list_filter({x}, lambda u: u = v)) + 1) / 2)"
_DOT = lambda x, y: f"list_sum(list_transform(list_zip({x}, {y}), lambda z: z[1] * z[2]))"
#: Hand-offs over aligned weeks (al): each query in both directions, step by step over lists of weeks.
HAND = f"""h0 AS (SELECT a, b, query, list(clicks_a ORDER BY week) AS ca, list(clicks_b ORDER BY week) AS cb, list(week ORDER BY week) AS w FROM al GROUP BY 1, 2, 3),
h1 AS (SELECT a, b, query, 'a_to_b' AS direction, ca AS x, cb AS y, w FROM h0 UNION ALL SELECT a, b, query, 'b_to_a', cb, ca, w FROM h0),
h2 AS (SELECT *, len(x) AS n, {_MEANS('x')} AS sx, {_MEANS('y')} AS sy FROM h1), h3 AS (SELECT *, list_position(sx, list_max(sx)) AS pk FROM h2),
h4 AS (SELECT *, pk - 1 + list_position(sy[pk:], list_max(sy[pk:])) AS lt FROM h3),
h5 AS (SELECT *, list_filter(range(pk, lt + 1), lambda i: sy[i] >= sx[i] AND sy[i] >= 2.5)[1] AS cr FROM h4),
h6 AS (SELECT *, x[cr + 1:cr + 6] AS af, {_RANKS('x[pk:lt]')} AS rx, {_RANKS('y[pk:lt]')} AS ry, CAST(lt - pk + 1 AS DOUBLE) AS m FROM h5),
h7 AS (SELECT *, {_DOT('rx', 'ry')} - list_sum(rx) * list_sum(ry) / m AS xy, {_DOT('rx', 'rx')} - list_sum(rx) ** 2 / m AS xx, {_DOT('ry', 'ry')} - list_sum(ry) ** 2 / m AS yy FROM h6),
h8 AS (SELECT a, b, query, direction, w[cr] AS wk, CASE WHEN n < 8 THEN 'few weeks' WHEN sx[pk] < 5 THEN 'low peak' WHEN n - pk + 1 < 6 THEN 'late peak' WHEN sy[lt] < 5 THEN 'low later peak' WHEN cr IS NULL THEN 'no crossover' WHEN len(af) < 6 THEN 'few weeks after'
  WHEN list_avg({_MEANS('af')}) > 0.2 * sx[pk] THEN 'not silent' WHEN len(list_filter(range(pk, cr + 1), lambda i: x[i] > 0 AND y[i] > 0)) < 3 THEN 'no coexistence' WHEN m >= 4 AND xx > 1e-9 AND yy > 1e-9 AND xy / sqrt(xx * yy) <= -0.3 THEN 'handoff' ELSE 'no anticorrelation' END AS reason FROM h7),
ho AS (SELECT a, b, query, direction, CASE WHEN reason = 'handoff' THEN wk END AS week, reason FROM h8),
hd AS (SELECT a, b, direction, count(*) AS queries, list_sort(list(week))[count(*) // 2 + 1] AS handoff_date FROM ho WHERE week IS NOT NULL GROUP BY 1, 2, 3),
dh AS (SELECT a, b, direction, queries, handoff_date FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY queries DESC, direction) AS r FROM hd) x WHERE r = 1)"""
_TWIN = "SELECT x.page AS a, y.page AS b FROM kk x JOIN kk y ON x.key = y.key AND x.page < y.page WHERE x.key <> ''"
_KEY = f"array_to_string(list_sort(list_transform(list_filter(regexp_split_to_array(lower({CP._SLUG}), '[-_]+'), lambda t: t <> '' AND NOT regexp_matches(t, '^\\d+$')), lambda t: CASE WHEN length(t) > 3 AND ends_with(t, 's') THEN left(t, length(t) - 1) ELSE t END)), ' ')"
_INTENT = "CASE WHEN contains(page, 'large') THEN 'navigational' WHEN contains(page, 'economy') THEN 'unknown' ELSE 'commercial' END"
_SHARE = "CASE WHEN contains(page, 'small') THEN 0.9 ELSE 0.1 END"
_CONTENT = "((length(a) * 7 + length(b) * 3) % 11) / 10.0"
VERDICT = f"""{CS.WK}, {_TAIL}, {_COS}, {HAND}, kk AS (SELECT DISTINCT page, {_KEY} AS key FROM fx_dense), tw AS ({_TWIN}),
ut AS (SELECT page, sum(clicks) AS c FROM uni GROUP BY page), uc AS (SELECT a, b, sum(clicks_a) AS ca, sum(clicks_b) AS cb, count(*) AS n FROM sp GROUP BY 1, 2),
nq AS (SELECT a, b, count(*) AS n FROM bq GROUP BY 1, 2),
v0 AS (SELECT pc.a, pc.b, pc.score, pc.topic_cosine, coalesce(nq.n, uc.n, 0) AS shared, coalesce(CASE WHEN x.c >= 10 THEN (x.c - coalesce(uc.ca, 0)) / x.c END, 0) AS sa, coalesce(CASE WHEN y.c >= 10 THEN (y.c - coalesce(uc.cb, 0)) / y.c END, 0) AS sb, coalesce(og.qualifying, 0) AS qualifying, coalesce(og.qualifying_clicks, 0) AS qualifying_clicks, coalesce(og.ongoing, false) AS ongoing, coalesce(rd.redundant, false) AS redundant, rd.weak_side AS redundant_side, dh.direction, dh.handoff_date, tw.a IS NOT NULL AS twin, {_CONTENT.replace('length(a)', 'length(pc.a)').replace('length(b)', 'length(pc.b)')} AS cs
  FROM pc LEFT JOIN nq USING (a, b) LEFT JOIN uc USING (a, b) JOIN ut x ON x.page = pc.a JOIN ut y ON y.page = pc.b LEFT JOIN og USING (a, b) LEFT JOIN rd USING (a, b) LEFT JOIN dh USING (a, b) LEFT JOIN tw USING (a, b)),
v1 AS (SELECT *, greatest(sa, sb) >= 0.6 AS own, cs >= 0.94 OR (twin AND topic_cosine >= 0.88 AND cs >= 0.5) AS dup, {_INTENT.replace('page', 'a')} AS ia, {_INTENT.replace('page', 'b')} AS ib, NOT (({_SHARE.replace('page', 'a')} >= 0.4) <> ({_SHARE.replace('page', 'b')} >= 0.4)) AS same FROM v0),
v2 AS (SELECT *, CASE WHEN NOT (ia = 'unknown' OR ib = 'unknown' OR ia = ib) THEN 'not_cannibal' WHEN dup AND NOT own THEN 'duplicate' WHEN NOT same AND (ongoing OR direction IS NOT NULL) THEN 'not_cannibal' WHEN direction IS NOT NULL THEN 'affected_handoff' WHEN ongoing THEN CASE WHEN own THEN 'differentiate' ELSE 'ongoing' END WHEN dup THEN 'differentiate' WHEN redundant THEN CASE WHEN own THEN 'differentiate' ELSE 'redundant_duplicate' END WHEN shared >= 2 AND (topic_cosine >= 0.8 OR cs >= 0.78) THEN 'overlap_watch' ELSE 'not_cannibal' END AS verdict FROM v1),
vd AS (SELECT a, b, shared, score, topic_cosine, qualifying, qualifying_clicks, ongoing, redundant, redundant_side, direction, handoff_date, CASE WHEN verdict = 'affected_handoff' THEN CASE WHEN direction = 'a_to_b' THEN a ELSE b END END AS loser, CASE WHEN verdict = 'differentiate' THEN CASE WHEN sa >= sb THEN a ELSE b END END AS distinct_page, verdict FROM v2)"""
_PAGES = CS.ORACLE_SQL["page_rollup"].removeprefix(f"WITH {CS.WK} ")


def _stars_sql(edges: str, pages: str) -> str:
    """CTEs: sr (page, primary) by walking the pages from the strongest on; each takes its neighbours that nobody has."""
    held = "list_transform(held, lambda h: h.page)"
    return f"""se AS (SELECT a, b FROM ({edges}) e UNION SELECT b, a FROM ({edges}) e),
so AS (SELECT page, row_number() OVER (ORDER BY clicks DESC, page) AS i, coalesce((SELECT list(se.b) FROM se WHERE se.a = p.page), []) AS near FROM ({pages}) p),
sw(i, held) AS (SELECT 0::BIGINT, []::STRUCT(page VARCHAR, first VARCHAR)[] UNION ALL SELECT so.i, CASE WHEN list_contains({held}, so.page) THEN held ELSE list_concat(held, list_transform(list_filter(list_concat([so.page], so.near), lambda q: NOT list_contains({held}, q)), lambda q: {{'page': q, 'first': so.page}})) END FROM sw JOIN so ON so.i = sw.i + 1),
sr AS (SELECT h.page AS page, h.first AS "primary" FROM (SELECT unnest(held) AS h FROM sw WHERE i = (SELECT count(*) FROM so)) u)"""


_SEARCH_EDGES = "SELECT a, b FROM sl WHERE reason = 'accepted' AND score >= 0.75"
_CLUSTER_EDGES = "SELECT a, b FROM og WHERE ongoing AND (qualifying >= 2 OR qualifying_clicks >= 50)"
_W = "OVER (PARTITION BY \"primary\")"
WINNERS = f"""{VERDICT}, pg AS ({_PAGES}), {_stars_sql(_CLUSTER_EDGES, 'SELECT page, clicks_window AS clicks FROM pg')},
wn AS (SELECT page, "primary", 0.5 * clicks_window / greatest(max(clicks_window) {_W}, 1) + 0.3 / (1 + exp(-coalesce(trend_slope, 0))) + 0.2 * (1 - coalesce(avg_position_90d, 100) / greatest(max(coalesce(avg_position_90d, 100)) {_W}, 1)) AS score FROM sr JOIN pg USING (page)),
wi AS (SELECT page, "primary", score, row_number() OVER (PARTITION BY "primary" ORDER BY score DESC, page) = 1 AS winner FROM wn)"""
PLAN = f"""{WINNERS}, sz AS (SELECT "primary", max(page) FILTER (winner) AS best FROM wi GROUP BY 1 HAVING count(*) > 1), cl AS (SELECT wi.page, wi."primary", best, winner FROM wi JOIN sz USING ("primary")),
vp AS (SELECT list_sort([a, b]) AS pair, verdict, loser FROM vd),
kn AS (SELECT page, best, 0.0 AS rank, list_sort([page, best]) AS pair FROM cl WHERE NOT winner UNION ALL SELECT page, best, 1.0, list_sort([page, "primary"]) FROM cl WHERE NOT winner AND page <> "primary"),
fl AS (SELECT vd.*, CASE verdict WHEN 'redundant_duplicate' THEN CASE WHEN redundant_side = 'a' THEN a ELSE b END WHEN 'differentiate' THEN distinct_page ELSE CASE WHEN coalesce(x.clicks_window, 0) <= coalesce(y.clicks_window, 0) THEN a ELSE b END END AS page FROM vd LEFT JOIN pg x ON x.page = a LEFT JOIN pg y ON y.page = b WHERE verdict IN ('redundant_duplicate', 'differentiate', 'overlap_watch')),
al4 AS (SELECT page, 1 AS stage, 0.0 AS rank, 'cluster winner' AS status, page AS target, 'cluster_winner' AS verdict FROM cl WHERE winner
 UNION ALL SELECT page, 2, rank, CASE WHEN verdict = 'affected_handoff' THEN CASE WHEN loser = page THEN 'affected_handoff (loser)' ELSE 'affected_handoff (winner)' END WHEN verdict = 'duplicate' THEN 'duplicate' ELSE 'ongoing cannibal' END, CASE WHEN verdict = 'affected_handoff' THEN CASE WHEN loser = page THEN list_filter(kn.pair, lambda q: q <> loser)[1] ELSE page END ELSE best END, verdict FROM kn JOIN vp USING (pair)
 UNION ALL SELECT page, 3, -score, CASE verdict WHEN 'redundant_duplicate' THEN 'redundant duplicate' WHEN 'differentiate' THEN 'differentiate : keep both' ELSE 'overlap watch' END, CASE WHEN verdict <> 'differentiate' THEN CASE WHEN page = a THEN b ELSE a END END, verdict FROM fl
 UNION ALL SELECT page, 4, 0, CASE WHEN clicks_window > 0 THEN 'standalone' ELSE 'standalone (0 clicks)' END, NULL, 'standalone' FROM pg),
pl AS (SELECT page, status, target, verdict, clicks_window, CASE status {' '.join(f"WHEN '{k}' THEN {n}" for k, n in V.PRIORITY.items())} END AS priority FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY stage, rank, status, target NULLS FIRST) AS r FROM al4) z JOIN pg USING (page) WHERE r = 1)"""


def _dense(s, d):
    """The matrix, made from the tables once and written, and its universe."""
    m = written(fixtures.view(s, d, "fx_dense"))
    return m, written(S.search_universe(m))


def _verdicts(m, u, evidence=None):
    pages = m.select("page").distinct()
    content = m.select("page").distinct().withColumnRenamed("page", "a").crossJoin(m.select("page").distinct().withColumnRenamed("page", "b")).where("a < b")  # a few pages
    return V.pair_verdicts(u, m, evidence=evidence, intents=pages.select("page", F.expr(_INTENT).alias("intent")), shares=pages.select("page", F.expr(_SHARE).cast("double").alias("non_web_share")), content=content.select("a", "b", F.expr(_CONTENT).cast("double").alias("content_sim")))


def _evidence(s, d):
    m, u = _dense(s, d)
    evidence = V.pair_evidence(u, m)
    return V.evidence_rows(written(_verdicts(m, u, evidence)), *evidence[1:])


def _handoffs(s, d):
    return I.handoff_queries(CP._aligned(s, d))


def _winners(m, u):
    pages = written(S.page_rollup(m))
    aligned = P.align_weekly(S.weekly_series(m), written(CP._all_pairs(u)))
    edges = P.cluster_edges(P.detect_ongoing(P.parity_test(aligned, m.agg(F.max("date")).scalar())))
    return pages, C.cluster_winner(pages, C.star_clusters(pages.select("page", F.col("clicks_window").alias("clicks")), edges))


def _plan(s, d):
    m, u = _dense(s, d)
    pages, winners = _winners(m, u)
    return V.action_plan(pages, written(_verdicts(m, u)), written(winners))


def _stars(s, d):
    m = fixtures.view(s, d, "fx_search")
    edges = P.shortlist_pairs(S.search_universe(m)).where("accepted and score >= 0.75").select("a", "b")
    return C.star_clusters(m.groupBy("page").agg(F.sum("clicks").alias("clicks")), edges)


_META = "SELECT DISTINCT page, CASE length(page) % 4 WHEN 0 THEN 'unresolved-1' WHEN 1 THEN 'g1' WHEN 2 THEN 'g2' ELSE 'g3' END AS peer_group, length(page) % 3 = 0 AS is_hub, concat('s', cast(length(page) % 5 AS string)) AS section"


def _peers(s, d):
    m = fixtures.view(s, d, "fx_search")
    meta = m.selectExpr(_META.removeprefix("SELECT DISTINCT ").split(", CASE")[0], "CASE length(page) % 4 WHEN 0 THEN 'unresolved-1' WHEN 1 THEN 'g1' WHEN 2 THEN 'g2' ELSE 'g3' END AS peer_group", "length(page) % 3 = 0 AS is_hub", "concat('s', cast(length(page) % 5 AS string)) AS section", "CASE WHEN length(page) % 3 = 0 THEN array('s1', 's3') END AS covers").distinct()
    return V.peer_gate(CP._all_pairs(S.search_universe(m)), meta)


def _duplicates(s, d):
    pairs = P.cosine_pairs(CP._universe(s, d))
    content = F.when(F.col("shared") % 4 == 0, None).when(F.col("shared") % 4 == 1, 0.95).when(F.col("shared") % 4 == 2, 0.6).otherwise(0.2)
    return pairs.select("a", "b", V.assess_duplicate(F.length("a") % 2 == 0, F.col("topic_cosine") + 0.5, content).alias("duplicate"))


def _shared(s, d):
    m = fixtures.view(s, d, "fx_search")
    u = S.search_universe(m)
    return V.shared_queries(S.weekly_series(m.where("length(query) % 3 = 0")), u, CP._all_pairs(u))


def _topics(s, d):
    m = fixtures.view(s, d, "fx_search")
    topics = m.select("query").distinct().select(F.concat(F.lit(" "), F.upper("query")).alias("query"), F.when(F.length("query") % 3 == 0, "").when(F.length("query") % 3 == 1, F.concat(F.lit("Topic "), F.substring("query", 1, 2))).otherwise(F.concat(F.lit("only "), "query")).alias("topic"))
    return V.apply_topics(m, topics).select("page", "query", "impressions", "clicks")


_TOKENS = f"list_distinct(list_filter(regexp_extract_all(lower(keyword), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({CP._STOP})))"
BLOCKS = f"""{fixtures.cte('fx_keywords')}, kq AS (SELECT DISTINCT lower(keyword) AS query, unnest({_TOKENS}) AS token FROM fx_keywords),
kt AS (SELECT token FROM kq GROUP BY 1 HAVING count(*) > 1 AND count(*) <= greatest(3, floor((SELECT count(DISTINCT lower(keyword)) FROM fx_keywords) * 0.4))), km AS (SELECT query, token FROM kq SEMI JOIN kt USING (token)),
kr(query, other) AS (SELECT DISTINCT query, query FROM km UNION SELECT kr.query, y.query FROM kr JOIN km x ON x.query = kr.other JOIN km y USING (token))"""
ALL = {
    "handoff_detect": (_handoffs, f"WITH {_DENSE}, {_TAIL}, {HAND} SELECT * FROM ho"),
    "detect_handoff": (lambda s, d: I.detect_handoff(_handoffs(s, d)), f"WITH {_DENSE}, {_TAIL}, {HAND} SELECT * FROM dh"),
    "pair_verdict": (lambda s, d: _verdicts(*_dense(s, d)), f"WITH {VERDICT} SELECT * FROM vd"),
    "evidence_rows": (_evidence, f"WITH {VERDICT} SELECT a, b, verdict, query, 'ongoing' AS kind FROM vd JOIN pt USING (a, b) WHERE verdict <> 'not_cannibal' AND failed = '' UNION ALL SELECT a, b, verdict, query, 'handoff' FROM vd JOIN ho USING (a, b, direction) WHERE verdict <> 'not_cannibal' AND week IS NOT NULL"),
    "star_clusters": (_stars, f"WITH RECURSIVE {CP._cos('fx_search')}, {_stars_sql(_SEARCH_EDGES, 'SELECT page, sum(clicks) AS clicks FROM fx_search GROUP BY page')} SELECT * FROM sr"),
    "cluster_winner": (lambda s, d: _winners(*_dense(s, d))[1], f"WITH RECURSIVE {WINNERS} SELECT * FROM wi"),
    "action_plan": (_plan, f"WITH RECURSIVE {PLAN} SELECT * FROM pl"),
    "plan_summary": (lambda s, d: V.plan_summary(_plan(s, d)), f"WITH RECURSIVE {PLAN} SELECT count(*) AS pages, count(*) FILTER (priority <= 6) AS actionable, CAST(coalesce(sum(clicks_window) FILTER (priority <= 6), 0) AS BIGINT) AS clicks_at_stake, coalesce(coalesce(sum(clicks_window) FILTER (priority <= 6), 0) / nullif(sum(clicks_window), 0), 0) AS share, count(*) FILTER (status = 'cluster winner') AS clusters, count(*) FILTER (clicks_window = 0) AS without_clicks FROM pl"),
    "query_blocks": (lambda s, d: C.query_blocks(fixtures.view(s, d, "fx_keywords").select(F.lower("keyword").alias("query"))), f"WITH RECURSIVE {BLOCKS} SELECT query, min(other) AS block FROM kr GROUP BY 1"),
    "peer_gate": (_peers, f"WITH {CP._cos('fx_search')}, pm AS (SELECT DISTINCT page, CASE length(page) % 4 WHEN 0 THEN 'unresolved-1' WHEN 1 THEN 'g1' WHEN 2 THEN 'g2' ELSE 'g3' END AS g, length(page) % 3 = 0 AS hub, 's' || (length(page) % 5) AS section FROM fx_search) SELECT a, b FROM (SELECT DISTINCT a, b FROM sp) p JOIN pm x ON x.page = a JOIN pm y ON y.page = b WHERE CASE WHEN x.g = y.g THEN x.g <> 'unresolved-1' ELSE (x.hub AND y.section IN ('s1', 's3')) OR (y.hub AND x.section IN ('s1', 's3')) END"),
    "assess_duplicate": (_duplicates, f"WITH {CP._cos('fx_search')} SELECT a, b, coalesce(c >= 0.94, false) OR (length(a) % 2 = 0 AND topic_cosine + 0.5 >= 0.88 AND coalesce(c >= 0.5, true)) AS duplicate FROM (SELECT *, CASE shared % 4 WHEN 0 THEN NULL WHEN 1 THEN 0.95 WHEN 2 THEN 0.6 ELSE 0.2 END AS c FROM cs) x"),
    "shared_queries": (_shared, f"WITH {CP._cos('fx_search')} SELECT a, b, CASE WHEN count(*) FILTER (length(query) % 3 = 0) > 0 THEN count(*) FILTER (length(query) % 3 = 0) ELSE count(*) END AS shared FROM sp GROUP BY 1, 2"),
    "apply_topics": (_topics, f"WITH {fixtures.cte('fx_search')}, tq AS (SELECT DISTINCT lower(query) AS query, CASE length(query) % 3 WHEN 0 THEN '' WHEN 1 THEN 'topic ' || lower(query[1:2]) ELSE 'only ' || lower(query) END AS topic FROM fx_search), tm AS (SELECT topic FROM tq WHERE trim(topic) <> '' GROUP BY 1 HAVING count(*) > 1) SELECT page, coalesce(trim(t.topic), f.query) AS query, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks FROM fx_search f LEFT JOIN (SELECT query, topic FROM tq SEMI JOIN tm USING (topic)) t ON t.query = f.query GROUP BY 1, 2"),
    "max_urls_cap": (lambda s, d: V.max_urls_cap(fixtures.view(s, d, "fx_search").groupBy("page").agg(F.sum("impressions").alias("impressions")), 20), f"WITH {fixtures.cte('fx_search')} SELECT page, CAST(sum(impressions) AS BIGINT) AS impressions, row_number() OVER (ORDER BY sum(impressions) DESC, page) <= 20 AS kept FROM fx_search GROUP BY page"),
}
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items()}
