"""Queries over competing pages, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlight import fixtures
from searchlight.operators import pairs as P
from searchlight.operators import search as S

M, D = fixtures.cte("fx_search"), fixtures.cte("fx_dense")


def _uni(view: str) -> str:
    return f"{fixtures.cte(view)}, uni AS (SELECT page, query, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks FROM {view} GROUP BY 1, 2)"


def _cos(view: str) -> str:
    return f"""{_uni(view)}, idf AS (SELECT query, ln((SELECT count(DISTINCT page) FROM uni) / count(DISTINCT page)) AS idf FROM uni GROUP BY query),
sp AS (SELECT a.page AS a, b.page AS b, a.query, a.clicks AS clicks_a, a.impressions AS impressions_a, b.clicks AS clicks_b, b.impressions AS impressions_b FROM uni a JOIN uni b ON a.query = b.query AND a.page < b.page),
nm AS (SELECT page, sqrt(sum((clicks * idf) ** 2)) AS c, sqrt(sum((impressions * idf) ** 2)) AS i, sqrt(sum(impressions::DOUBLE ** 2)) AS t FROM uni JOIN idf USING (query) GROUP BY page),
dt AS (SELECT a, b, count(*) AS shared, sum(clicks_a * clicks_b * idf ** 2) AS dc, sum(impressions_a * impressions_b * idf ** 2) AS di, sum(CAST(impressions_a * impressions_b AS DOUBLE)) AS dd, max(idf) AS best_idf FROM sp JOIN idf USING (query) GROUP BY 1, 2),
cs AS (SELECT dt.a, dt.b, shared, best_idf, coalesce(dc / nullif(x.c * y.c, 0), 0) AS click_cosine, coalesce(di / nullif(x.i * y.i, 0), 0) AS impression_cosine, coalesce(dd / nullif(x.t * y.t, 0), 0) AS topic_cosine FROM dt JOIN nm x ON x.page = dt.a JOIN nm y ON y.page = dt.b),
sl AS (SELECT a, b, shared, click_cosine, impression_cosine, topic_cosine, greatest(click_cosine, impression_cosine, topic_cosine) AS score, CASE WHEN click_cosine < 0.3 AND impression_cosine < 0.4 AND topic_cosine < 0.85 THEN 'below every threshold' WHEN topic_cosine < 0.85 AND best_idf < ln(1 / 0.3) THEN 'no shared topic query' ELSE 'accepted' END AS reason FROM cs),
pc AS (SELECT * FROM sl WHERE reason = 'accepted' AND score >= 0.85 UNION ALL SELECT sl.* FROM sl SEMI JOIN (SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY url ORDER BY score DESC, a, b) AS r FROM (SELECT a, b, score, unnest([a, b]) AS url FROM sl WHERE reason = 'accepted' AND score < 0.85) u) v WHERE r <= 12) k USING (a, b) WHERE reason = 'accepted' AND score < 0.85)"""


WP = lambda s: f"sum(position_{s} * impressions_{s}) FILTER (impressions_{s} > 0 AND position_{s} IS NOT NULL) / nullif(sum(impressions_{s}) FILTER (impressions_{s} > 0 AND position_{s} IS NOT NULL), 0)"
PAIRS = "pr AS (SELECT DISTINCT a.page AS a, b.page AS b FROM uni a JOIN uni b ON a.page < b.page)"
ALIGN = f"""{_uni('fx_dense')}, {PAIRS},
ws AS (SELECT page, query, CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, sum(position * impressions) FILTER (impressions > 0) / nullif(sum(impressions) FILTER (impressions > 0), 0) AS position FROM fx_dense GROUP BY 1, 2, 3),
bq AS (SELECT a, b, x.query FROM pr JOIN (SELECT DISTINCT page, query FROM ws) x ON x.page = a JOIN (SELECT DISTINCT page, query FROM ws) y ON y.page = b AND y.query = x.query),
la AS (SELECT a, b, query, week, clicks, impressions, position FROM bq JOIN ws USING (query) WHERE ws.page = a), lb AS (SELECT a, b, query, week, clicks, impressions, position FROM bq JOIN ws USING (query) WHERE ws.page = b),
al AS (SELECT a, b, query, week, coalesce(la.clicks, 0) AS clicks_a, coalesce(la.impressions, 0) AS impressions_a, coalesce(lb.clicks, 0) AS clicks_b, coalesce(lb.impressions, 0) AS impressions_b, la.position AS position_a, lb.position AS position_b FROM la FULL JOIN lb USING (a, b, query, week))"""
PARITY = f"""{ALIGN}, p0 AS (SELECT a, b, query, count(*) AS weeks, count(*) FILTER (impressions_a > 0 AND impressions_b > 0) AS weeks_both, CAST(sum(clicks_a) AS BIGINT) AS clicks_a, CAST(sum(impressions_a) AS BIGINT) AS impressions_a, CAST(sum(clicks_b) AS BIGINT) AS clicks_b, CAST(sum(impressions_b) AS BIGINT) AS impressions_b, {WP('a')} AS position_a, {WP('b')} AS position_b FROM al WHERE week >= (SELECT max(date) - 90 FROM fx_dense) GROUP BY 1, 2, 3),
p1 AS (SELECT *, weeks_both / weeks AS simultaneity, coalesce(least(clicks_a, clicks_b) / nullif(greatest(clicks_a, clicks_b), 0), 0) AS click_parity, coalesce(least(impressions_a, impressions_b) / nullif(greatest(impressions_a, impressions_b), 0), 0) AS impression_parity, abs(position_a - position_b) AS position_delta FROM p0),
pt AS (SELECT *, concat_ws(';', CASE WHEN clicks_a + clicks_b < 15 THEN 'clicks_total' END, CASE WHEN least(clicks_a, clicks_b) < 3 THEN 'clicks_min_side' END, CASE WHEN click_parity < 0.4 THEN 'click_parity' END, CASE WHEN impression_parity < 0.4 THEN 'impr_parity' END, CASE WHEN position_delta IS NULL OR position_delta > 5 THEN 'pos_delta' END, CASE WHEN position_delta IS NULL OR greatest(position_a, position_b) > 10 THEN 'pos_max' END, CASE WHEN simultaneity < 0.5 THEN 'simultaneity' END, CASE WHEN weeks < 8 THEN 'weeks' END) AS failed FROM p1),
og AS (SELECT a, b, count(*) FILTER (failed = '') AS qualifying, count(*) FILTER (failed <> '') AS rejected, CAST(coalesce(sum(clicks_a + clicks_b) FILTER (failed = ''), 0) AS BIGINT) AS qualifying_clicks, count(*) FILTER (failed = '') >= 1 AS ongoing FROM pt GROUP BY 1, 2),
r0 AS (SELECT *, CASE WHEN clicks_a < clicks_b THEN 'a' WHEN clicks_b < clicks_a THEN 'b' WHEN coalesce(round(position_a, 2), 999) > coalesce(round(position_b, 2), 999) THEN 'a' ELSE 'b' END AS weak FROM pt WHERE failed <> '' AND impressions_a > 0 AND impressions_b > 0),
r1 AS (SELECT a, b, count(*) AS shared, CASE WHEN count(*) FILTER (weak = 'a') >= count(*) FILTER (weak = 'b') THEN 'a' ELSE 'b' END AS weak_side, greatest(count(*) FILTER (weak = 'a'), count(*) FILTER (weak = 'b')) / count(*) AS dominance, sum(clicks_a) AS ca, sum(clicks_b) AS cb, list_sort(list(round(position_a, 2)) FILTER (weak = 'a' AND position_a IS NOT NULL)) AS qa, list_sort(list(round(position_b, 2)) FILTER (weak = 'b' AND position_b IS NOT NULL)) AS qb FROM r0 GROUP BY 1, 2),
r2 AS (SELECT a, b, shared, weak_side, dominance, CASE WHEN weak_side = 'a' THEN qa[len(qa) // 2 + 1] ELSE qb[len(qb) // 2 + 1] END AS median_position, CASE WHEN weak_side = 'a' THEN ca ELSE cb END / nullif(ca + cb, 0) AS weak_click_share FROM r1),
rd AS (SELECT *, shared >= 3 AND dominance >= 0.7 AND (coalesce(median_position > 15, false) OR coalesce(weak_click_share < 0.25, false)) AS redundant FROM r2)"""


def _universe(s, d, view="fx_search"):
    return S.search_universe(fixtures.view(s, d, view))


def _all_pairs(universe):
    """Every pair of the few pages of fx_dense that share a query."""
    return P.shared_query_pairs(universe).select("a", "b").distinct()


def _aligned(s, d):
    m = fixtures.view(s, d, "fx_dense")
    return P.align_weekly(S.weekly_series(m), _all_pairs(S.search_universe(m)))


def _parity(s, d):
    return P.parity_test(_aligned(s, d), fixtures.view(s, d, "fx_dense").agg(F.max("date")).scalar())


_u = lambda f, view="fx_search": lambda s, d: f(_universe(s, d, view))
_STOP = ", ".join(f"'{w}'" for w in P.STOPWORDS)
_SLUG = "regexp_extract(trim(regexp_replace(page, '^[a-z]+://[^/]*', ''), '/'), '[^/]*$')"
ALL = {
    "content_tokens": (lambda s, d: fixtures.view(s, d, "fx_search").select("query").distinct().select("query", F.array_join(P.content_tokens(F.concat(F.lit("the best of "), "query")), " ").alias("tokens")), f"WITH {M} SELECT DISTINCT query, array_to_string(list_filter(regexp_extract_all('the best of ' || lower(query), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP})), ' ') AS tokens FROM fx_search"),
    "shared_query_pairs": (_u(lambda u: P.shared_query_pairs(u).groupBy("a", "b").agg(F.count("*").alias("queries"), F.sum("clicks_a").alias("clicks_a"), F.sum("clicks_b").alias("clicks_b"))), f"WITH {_cos('fx_search')} SELECT a, b, count(*) AS queries, CAST(sum(clicks_a) AS BIGINT) AS clicks_a, CAST(sum(clicks_b) AS BIGINT) AS clicks_b FROM sp GROUP BY 1, 2"),
    "cosine_pairs": (_u(lambda u: P.cosine_pairs(u).drop("best_idf")), f"WITH {_cos('fx_search')} SELECT a, b, shared, click_cosine, impression_cosine, topic_cosine FROM cs"),
    "shortlist_pairs": (_u(P.shortlist_pairs), f"WITH {_cos('fx_search')} SELECT *, reason = 'accepted' AS accepted FROM sl"),
    "pairs_per_url_cap": (_u(lambda u: P.pairs_per_url_cap(P.shortlist_pairs(u)).select("a", "b")), f"WITH {_cos('fx_search')} SELECT a, b FROM pc"),
    "unique_click_share": (_u(lambda u: P.unique_click_share(u, P.shared_query_pairs(u).select("a", "b").distinct())), f"WITH {_cos('fx_search')}, t AS (SELECT page, sum(clicks) AS c FROM uni GROUP BY page) SELECT a, b, CASE WHEN x.c >= 10 THEN (x.c - ca) / x.c END AS share_a, CASE WHEN y.c >= 10 THEN (y.c - cb) / y.c END AS share_b FROM (SELECT a, b, sum(clicks_a) AS ca, sum(clicks_b) AS cb FROM sp GROUP BY 1, 2) s JOIN t x ON x.page = a JOIN t y ON y.page = b"),
    "url_twins": (lambda s, d: P.url_twins(fixtures.view(s, d, "fx_search")).agg(F.count("*").alias("pairs"), F.min("a").alias("first_a"), F.max("b").alias("last_b")), f"WITH {M}, k AS (SELECT DISTINCT page, array_to_string(list_sort(list_transform(list_filter(regexp_split_to_array(lower({_SLUG}), '[-_]+'), lambda t: t <> '' AND NOT regexp_matches(t, '^\\d+$')), lambda t: CASE WHEN length(t) > 3 AND ends_with(t, 's') THEN left(t, length(t) - 1) ELSE t END)), ' ') AS key FROM fx_search) SELECT count(*) AS pairs, min(a.page) AS first_a, max(b.page) AS last_b FROM k a JOIN k b ON a.key = b.key AND a.page < b.page WHERE a.key <> ''"),
    "align_weekly": (lambda s, d: _aligned(s, d), f"WITH {ALIGN} SELECT * FROM al"),
    "parity_test": (_parity, f"WITH {PARITY} SELECT *, failed = '' AS qualifies FROM pt"),
    "detect_ongoing": (lambda s, d: P.detect_ongoing(_parity(s, d)), f"WITH {PARITY} SELECT * FROM og"),
    "assess_redundant": (lambda s, d: P.assess_redundant(_parity(s, d)), f"WITH {PARITY} SELECT * FROM rd"),
    "spearman": (lambda s, d: P.spearman(_aligned(s, d)), f"WITH {ALIGN}, rk AS (SELECT a, b, query, rank() OVER (PARTITION BY a, b, query ORDER BY clicks_a) + (count(*) OVER (PARTITION BY a, b, query, clicks_a) - 1) / 2 AS ra, rank() OVER (PARTITION BY a, b, query ORDER BY clicks_b) + (count(*) OVER (PARTITION BY a, b, query, clicks_b) - 1) / 2 AS rb FROM al) SELECT a, b, query, count(*) AS weeks, CASE WHEN count(*) >= 3 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN corr(ra, rb) ELSE 0 END AS rho FROM rk GROUP BY 1, 2, 3"),
    "rolling_clicks": (lambda s, d: P.rolling_clicks(_aligned(s, d)), f"WITH {ALIGN} SELECT a, b, query, week, avg(clicks_a) OVER w AS mean_a, avg(clicks_b) OVER w AS mean_b FROM al WINDOW w AS (PARTITION BY a, b, query ORDER BY week ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)"),
    "cluster_edges": (lambda s, d: P.cluster_edges(P.detect_ongoing(_parity(s, d))), f"WITH {PARITY} SELECT a, b FROM og WHERE ongoing AND (qualifying >= 2 OR qualifying_clicks >= 50)"),
}
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
