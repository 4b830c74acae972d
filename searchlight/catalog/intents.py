"""Queries over intents, surfaces and hand-offs, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlight import fixtures
from searchlight.catalog import pairs as CP
from searchlight.catalog import search as CS
from searchlight.operators import intents as I
from searchlight.operators import search as S
from searchlight.operators import weblog as W
from searchlight.catalog import weblog as CW

D, M = fixtures.cte("fx_dense"), fixtures.cte("fx_search")
_q = CW._q
_words = lambda names: "[" + ", ".join(map(_q, names)) + "]"


def _intents(s, d):
    rows = fixtures.view(s, d, "fx_search").select(F.replace("page", F.lit("shop.example.com"), F.when(F.length("page") % 3 == 0, F.lit("x.example/blog")).otherwise(F.lit("x.example/c"))).alias("page"), F.concat_ws(" ", "query", F.when(F.length("query") % 2 == 0, "price")).alias("query"))
    return I.rule_intent(rows)


_PATH = "lower(regexp_replace(regexp_replace(page, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*', ''), '[?#].*$', ''))"
_URL = f"CASE WHEN {_PATH} IN ('', '/') THEN 'navigational' " + " ".join(f"WHEN regexp_matches({_PATH}, {_q(p)}, 'i') THEN '{i}'" for i, p in I.URL_PATTERNS) + " END"
INTENT = f"""{M}, ir AS (SELECT DISTINCT replace(page, 'shop.example.com', CASE WHEN length(page) % 3 = 0 THEN 'x.example/blog' ELSE 'x.example/c' END) AS page, query || CASE WHEN length(query) % 2 = 0 THEN ' price' ELSE '' END AS query FROM fx_search),
iv AS (SELECT page, count(*) AS n, {', '.join(f"count(*) FILTER (list_has_any(regexp_extract_all(lower(query), '[a-z0-9]+'), {_words(v)})) AS {k}" for k, v in I.TOKENS.items())} FROM ir GROUP BY page),
iu AS (SELECT page, {_URL} AS u, greatest({', '.join(I.TOKENS)}) / n AS share, CASE greatest({', '.join(I.TOKENS)}) {' '.join(f"WHEN {k} THEN '{k}'" for k in I.TOKENS)} END AS t FROM iv),
it AS (SELECT page, coalesce(u, CASE WHEN share >= 0.2 THEN t END, 'unknown') AS intent, CASE WHEN u IS NOT NULL OR share >= 0.4 THEN 'high' WHEN share >= 0.2 THEN 'med' ELSE 'none' END AS confidence FROM iu)"""


def _compatible(s, d):
    i = _intents(s, d).select("intent").distinct().unionByName(s.sql("SELECT explode(array('news', 'commercial', 'navigational', 'informational')) AS intent")).distinct()
    return i.alias("x").join(i.alias("y"), F.col("x.intent") <= F.col("y.intent")).select(F.col("x.intent").alias("a"), F.col("y.intent").alias("b"), I.intents_compatible(F.col("x.intent"), F.col("y.intent")).alias("compatible"))


def _shares(s, d):
    m = fixtures.view(s, d, "fx_dense")
    surface = F.when(F.length("query") % 4 == 0, "VIDEO").when(F.length("query") % 4 == 1, "AMP_BLUE_LINK").otherwise("RICH")
    some = m.where((F.length("page") + F.length("query")) % 3 == 0)
    return I.appearance_share(some.select("page", surface.alias("surface"), "impressions"), m.groupBy("page").agg(F.sum("impressions").alias("impressions")))


SHARES = f"""{D}, ap AS (SELECT page, CASE WHEN length(query) % 4 = 0 THEN 'VIDEO' WHEN length(query) % 4 = 1 THEN 'AMP_BLUE_LINK' ELSE 'RICH' END AS surface, sum(impressions) AS i FROM fx_dense WHERE (length(page) + length(query)) % 3 = 0 GROUP BY 1, 2),
ash AS (SELECT page, CAST(max(t) AS BIGINT) AS total, (max(t) - sum(i) + coalesce(sum(i) FILTER (surface = 'AMP_BLUE_LINK'), 0)) / max(t) AS web_share, coalesce(sum(i) FILTER (surface <> 'AMP_BLUE_LINK'), 0) / max(t) AS non_web_share, CASE WHEN max(t) - sum(i) >= max(i) THEN 'WEB' ELSE arg_max(surface, i) END AS top_surface FROM ap JOIN (SELECT page, sum(impressions) AS t FROM fx_dense GROUP BY page) z USING (page) GROUP BY page)"""


def _moves(s, d):
    return s.sql("SELECT 'https://shop.example.com/economy/' AS loser, 'https://shop.example.com/small/' AS winner, date'2024-02-26' AS handoff_date UNION ALL SELECT 'https://shop.example.com/large/', 'https://shop.example.com/medium/', date'2024-02-26'")


def _leakage(s, d):
    m = fixtures.view(s, d, "fx_dense")
    return I.leakage(S.weekly_series(m), _moves(s, d), m.agg(F.max("date")).scalar())


_MOVES = "(VALUES ('https://shop.example.com/economy/', 'https://shop.example.com/small/'), ('https://shop.example.com/large/', 'https://shop.example.com/medium/')) mv(loser, winner)"
_WIN = lambda side, lo, hi: f"SELECT loser, winner, query, sum(clicks) AS clicks, sum(position * impressions) FILTER (impressions > 0) / sum(impressions) FILTER (impressions > 0) AS position FROM {_MOVES} JOIN ws ON ws.page = mv.{side} WHERE week >= {lo} AND week <= {hi} GROUP BY 1, 2, 3"
LEAK = f"""{D}, ws AS (SELECT page, query, CAST(date_trunc('week', date) AS DATE) AS week, sum(clicks) AS clicks, sum(impressions) AS impressions, sum(position * impressions) FILTER (impressions > 0) / nullif(sum(impressions) FILTER (impressions > 0), 0) AS position FROM fx_dense GROUP BY 1, 2, 3),
be AS ({_WIN('loser', "DATE '2024-02-26' - 180", "DATE '2024-02-26' - 30")}), af AS ({_WIN('winner', "DATE '2024-02-26' + 30", '(SELECT max(date) FROM fx_dense)')}),
bo AS (SELECT loser, winner, query, coalesce(be.clicks, 0) AS pre, coalesce(af.clicks, 0) AS post, be.position AS pp, af.position AS qp FROM be FULL JOIN af USING (loser, winner, query)),
lk AS (SELECT loser, winner, CAST(sum(pre) AS BIGINT) AS clicks_pre, CAST(sum(post) AS BIGINT) AS clicks_post, count(*) FILTER (pre > 0 AND post <= 0) AS lost, count(*) FILTER (pre > 0 AND post > 0) AS retained, count(*) FILTER (pre <= 0 AND post > 0) AS new, count(*) FILTER (pre > 0 AND post > 0 AND qp > pp + 2) AS regressions, coalesce((sum(post) - sum(pre)) / nullif(sum(pre), 0), 0) AS change FROM bo GROUP BY 1, 2)"""


def _crossref_search(s, d):
    pages = fixtures.view(s, d, "fx_sitemap").select(F.col("loc").alias("url"), F.length("loc").cast("bigint").alias("impressions"))
    return W.crossref_search(CW._classified(s, d), pages)


ALL = {
    "rule_intent": (_intents, f"WITH {INTENT} SELECT * FROM it"),
    "intents_compatible": (_compatible, f"WITH {INTENT}, x AS (SELECT intent FROM it UNION SELECT unnest(['news', 'commercial', 'navigational', 'informational'])) SELECT a.intent AS a, b.intent AS b, a.intent = 'unknown' OR b.intent = 'unknown' OR a.intent = b.intent OR (a.intent, b.intent) IN (('informational', 'news'), ('commercial', 'informational')) AS compatible FROM x a JOIN x b ON a.intent <= b.intent"),
    "appearance_share": (_shares, f"WITH {SHARES} SELECT * FROM ash"),
    "surface_filter": (lambda s, d: I.surface_filter(CP._all_pairs(S.search_universe(fixtures.view(s, d, "fx_dense"))), _shares(s, d)), f"WITH {SHARES}, pr AS (SELECT DISTINCT a.page AS a, b.page AS b FROM fx_dense a JOIN (SELECT DISTINCT page, query FROM fx_dense) b ON a.query = b.query AND a.page < b.page) SELECT a, b, abs(coalesce(x.non_web_share, 0) - coalesce(y.non_web_share, 0)) AS delta, NOT ((coalesce(x.non_web_share, 0) >= 0.4) <> (coalesce(y.non_web_share, 0) >= 0.4) AND abs(coalesce(x.non_web_share, 0) - coalesce(y.non_web_share, 0)) >= 0.3) AS same_surface FROM pr LEFT JOIN ash x ON x.page = a LEFT JOIN ash y ON y.page = b"),
    "leakage": (_leakage, f"WITH {LEAK} SELECT *, CASE WHEN change <= -0.25 THEN 'critical' WHEN change <= -0.1 THEN 'warning' ELSE 'none' END AS severity FROM lk"),
    "redirect_plan": (lambda s, d: I.redirect_plan(S.page_rollup(fixtures.view(s, d, "fx_dense")), _moves(s, d)), f"WITH {CS.WK}, fc AS (SELECT page, min(date) FILTER (clicks > 0) AS f FROM fx_dense GROUP BY page) SELECT loser, winner, contains(l.trend, 'Positive') AND NOT contains(w.trend, 'Positive') AND x.f > y.f AS staged FROM {_MOVES} JOIN tl l ON l.page = loser JOIN tl w ON w.page = winner JOIN fc x ON x.page = loser JOIN fc y ON y.page = winner"),
    "crossref_search": (_crossref_search, CW._W(f"{CW.CLASSIFIED}, {fixtures.cte('fx_sitemap')}", "SELECT loc AS url, CAST(length(loc) AS BIGINT) AS impressions FROM fx_sitemap WHERE regexp_replace(regexp_replace(loc, '^https?://[^/]*', ''), '/+$', '') NOT IN (SELECT regexp_replace(split_part(url, '?', 1), '/+$', '') FROM r)")),
    "matrix_union": (lambda s, d: fixtures.view(s, d, "fx_dense").unionByName(fixtures.view(s, d, "fx_search")).groupBy("page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")), f"WITH {D}, {M} SELECT page, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM (SELECT page, clicks, impressions FROM fx_dense UNION ALL SELECT page, clicks, impressions FROM fx_search) x GROUP BY page"),
}
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
