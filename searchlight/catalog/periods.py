"""Queries over periods, links, keywords and behaviour, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlight import fixtures
from searchlight.operators import links as L
from searchlight.operators import periods as P
from searchlight.operators import search as S

CUT = "2024-02-26"
PER = f"{fixtures.cte('fx_search')}, pr AS (SELECT CASE WHEN date < DATE '{CUT}' THEN 'baseline' ELSE 'current' END AS period, page || ' ' || query AS key, date, clicks, impressions, position FROM fx_search)"
KEYS = f"""{PER}, k0 AS (SELECT lower(key) AS key, CAST(sum(clicks) FILTER (period = 'baseline') AS BIGINT) AS clicks_a, CAST(sum(impressions) FILTER (period = 'baseline') AS BIGINT) AS impressions_a, CAST(sum(clicks) FILTER (period = 'current') AS BIGINT) AS clicks_b, CAST(sum(impressions) FILTER (period = 'current') AS BIGINT) AS impressions_b,
 sum(position * impressions) FILTER (period = 'baseline') / sum(impressions) FILTER (period = 'baseline') AS position_a, sum(position * impressions) FILTER (period = 'current') / sum(impressions) FILTER (period = 'current') AS position_b FROM pr GROUP BY 1),
ks AS (SELECT *, CASE WHEN clicks_a IS NULL THEN 'new' WHEN clicks_b IS NULL THEN 'lost' ELSE 'retained' END AS cohort FROM k0)"""
DAY = f"{PER}, dy AS (SELECT period, date, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM pr GROUP BY 1, 2)"


def _rows(s, d):
    m = fixtures.view(s, d, "fx_search")
    return m.select(F.when(F.col("date") < F.lit(CUT).cast("date"), "baseline").otherwise("current").alias("period"), F.concat_ws(" ", "page", "query").alias("key"), "date", "clicks", "impressions", "position")


def _keys(s, d):
    return P.by_period(_rows(s, d))


def _daily(s, d):
    return _rows(s, d).groupBy("period", "date").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"))


def _links(s, d):
    """Backlinks from the toxic export: each source's row is a link to a site of the source's name."""
    t = fixtures.view(s, d, "fx_toxic")
    anchor = F.element_at(F.array(*map(F.lit, ["Acme", "buy anvils", "click here", "https://a.example", "great read", "acme shop"])), (F.col("score") % 6 + 1).cast("int"))
    return t.select(F.concat(F.lit("https://"), "domain", F.lit("/x")).alias("source_url"), anchor.alias("anchor"), "domain", F.col("score").cast("double").alias("score"), F.col("src").alias("site"))


LK = f"{fixtures.cte('fx_toxic')}, lk AS (SELECT 'https://' || domain || '/x' AS source_url, (['Acme', 'buy anvils', 'click here', 'https://a.example', 'great read', 'acme shop'])[score % 6 + 1] AS anchor, domain, CAST(score AS DOUBLE) AS score, src AS site, regexp_replace(domain, '^www\\.', '') AS d FROM fx_toxic)"
_CLASS = "CASE WHEN regexp_matches(anchor, 'acme', 'i') THEN 'brand' WHEN contains(lower(anchor), 'anvil') THEN 'exact_money' WHEN lower(anchor) IN ('', 'click here', 'here', 'read more', 'link', 'website', 'visit', 'this website') THEN 'generic' WHEN regexp_matches(anchor, '^https?://|^www\\.') THEN 'url' ELSE 'other' END"
_SPAM = f"(regexp_matches(source_url, '{L.SPAM}', 'i') OR regexp_matches(d, '{L.SPAM}', 'i') OR score <= 5)"
_KIND = f"CASE WHEN regexp_matches(selector, '{L.NO_CONVERSION}', 'i') THEN 'non_conversion' WHEN regexp_matches(string_split(selector, '>')[-1], '{L.CONVERSION}', 'i') THEN 'conversion' ELSE 'ambiguous' END"
TOX = f"{fixtures.cte('fx_toxic')}, tb AS (SELECT DISTINCT regexp_replace(domain, '^www\\.', '') AS domain, src FROM fx_toxic WHERE score >= 60), dv AS (SELECT DISTINCT regexp_replace(domain, '^www\\.', '') AS domain FROM fx_toxic WHERE score > 97)"
KW = f"{fixtures.cte('fx_keywords')}, km AS (SELECT keyword, search_volume, coalesce(kd, 0) AS kd, coalesce(cpc, 0) AS cpc, seed, ordinal FROM (SELECT keyword, search_volume, seed, ordinal, first_value(nullif(kd, 0) IGNORE NULLS) OVER w AS kd, first_value(nullif(cpc, 0) IGNORE NULLS) OVER w AS cpc, row_number() OVER (PARTITION BY lower(keyword) ORDER BY search_volume DESC, ordinal) AS r FROM fx_keywords WINDOW w AS (PARTITION BY lower(keyword) ORDER BY search_volume DESC, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) x WHERE r = 1)"


def _disavowed(s, d):
    return fixtures.view(s, d, "fx_toxic").where("score > 97").select("domain")


def _toxic(s, d):
    return L.toxic_multi_source(fixtures.view(s, d, "fx_toxic"), _disavowed(s, d))


_k = lambda f: lambda s, d: f(_keys(s, d))
_v = lambda view, f: lambda s, d: f(fixtures.view(s, d, view))
_seg = lambda s, d: fixtures.view(s, d, "fx_segment").withColumn("position", F.lit(1.0))
SEGC = f"""{fixtures.cte('fx_segment')}, c0 AS (SELECT lower(key) AS key, sum(clicks) FILTER (period = 'baseline') AS a, sum(clicks) FILTER (period = 'current') AS b FROM fx_segment GROUP BY 1),
c1 AS (SELECT CASE WHEN row_number() OVER (ORDER BY a DESC NULLS LAST, key) <= @top AND a IS NOT NULL THEN key ELSE 'OTHER' END AS bucket, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM c0), c2 AS (SELECT bucket, sum(a) AS a, sum(b) AS b FROM c1 GROUP BY 1),
c3 AS (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb, count(*) OVER () AS k, (a + b) / sum(a + b) OVER () AS f FROM c2),
c4 AS (SELECT k, ta + tb AS n, greatest(abs(a - f * ta) - CASE WHEN k = 2 THEN least(0.5, abs(a - f * ta)) ELSE 0 END, 0) ** 2 / (f * ta) + greatest(abs(b - f * tb) - CASE WHEN k = 2 THEN least(0.5, abs(b - f * tb)) ELSE 0 END, 0) ** 2 / (f * tb) AS x FROM c3),
c5 AS (SELECT sum(x) AS chi2, max(k) - 1 AS dof, CAST(max(n) AS BIGINT) AS n FROM c4)"""
_EFFECT = "SELECT *, sqrt(chi2 / n) AS cramers_v, CASE WHEN sqrt(chi2 / n) < 0.1 THEN 'negligible' WHEN sqrt(chi2 / n) < 0.3 THEN 'weak' ELSE 'meaningful' END AS reading FROM c5"
_WPK = lambda s, c: f"sum(position_{s} * impressions_{s}) FILTER ({c}) / sum(impressions_{s}) FILTER ({c})"
_CLEAN = "regexp_replace(domain, '^www\\.', '')"
#: A break in level and slope leaves two lines, each fitted on its own side; the engine's regression aggregates give their residuals.
BREAKS = f"""WITH {fixtures.cte('fx_dense')}, y AS (SELECT page AS series, date, sum(impressions)::DOUBLE AS m, (row_number() OVER (PARTITION BY page ORDER BY date) - 1)::DOUBLE AS k, count(*) OVER (PARTITION BY page) AS n, ln(greatest(sum(impressions), 1)) AS v FROM fx_dense GROUP BY page, date),
s AS (SELECT *, regr_syy(v, k) OVER whole AS yy, regr_sxy(v, k) OVER whole AS xy, regr_sxx(v, k) OVER whole AS xx, regr_syy(v, k) OVER a AS yy_a, regr_sxy(v, k) OVER a AS xy_a, regr_sxx(v, k) OVER a AS xx_a, regr_syy(v, k) OVER c AS yy_c, regr_sxy(v, k) OVER c AS xy_c, regr_sxx(v, k) OVER c AS xx_c,
  avg(m) OVER a AS before, avg(m) OVER c AS after FROM y WHERE n >= 20 WINDOW whole AS (PARTITION BY series), a AS (PARTITION BY series ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c AS (PARTITION BY series ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f AS (SELECT series, date AS break_date, k, before, after, yy_a - xy_a ** 2 / xx_a + yy_c - xy_c ** 2 / xx_c AS rest, yy - xy ** 2 / xx AS plain, n FROM s WHERE k >= floor(n * 0.15) AND k < n - floor(n * 0.15)),
b AS (SELECT *, (plain - rest) / 2 / (rest / (n - 4)) AS sup_f, row_number() OVER (PARTITION BY series ORDER BY (plain - rest) / 2 / (rest / (n - 4)) DESC, k) AS r FROM f)"""
#: With an interaction, each period has a line of its own: coefficients are those of the first and the differences to it.
AT_RANK = f"""WITH {PER}, x AS (SELECT period, ln(clicks / impressions) AS y, position::DOUBLE AS p, impressions::DOUBLE AS w FROM pr WHERE clicks > 0 AND position > 0 AND impressions >= 5),
s AS (SELECT period, sum(w) AS s0, sum(w * p) AS s1, sum(w * p * p) AS s2, sum(w * y) AS t0, sum(w * p * y) AS t1 FROM x GROUP BY 1), l AS (SELECT *, s0 * s2 - s1 * s1 AS d, (s2 * t0 - s1 * t1) / d AS a, (s0 * t1 - s1 * t0) / d AS b FROM s),
m AS (SELECT period, sum((w * (y - a - b * p)) ** 2) AS m0, sum((w * (y - a - b * p)) ** 2 * p) AS m1, sum((w * (y - a - b * p)) ** 2 * p * p) AS m2, count(*) AS n FROM x JOIN l USING (period) GROUP BY 1),
v AS (SELECT period, a, b, (s2 * s2 * m0 - 2 * s2 * s1 * m1 + s1 * s1 * m2) / d ** 2 AS va, (s1 * s1 * m0 - 2 * s0 * s1 * m1 + s0 * s0 * m2) / d ** 2 AS vb, sum(n) OVER () AS n FROM l JOIN m USING (period)),
z AS (SELECT A.a AS a0, A.b AS b0, B.a - A.a AS a1, B.b - A.b AS b1, A.va AS va0, A.vb AS vb0, A.va + B.va AS va1, A.vb + B.vb AS vb1, A.n / (A.n - 4) AS f FROM v A JOIN v B ON A.period = 'baseline' AND B.period = 'current')
SELECT 'intercept' AS term, a0 AS coefficient, sqrt(va0 * f) AS standard_error FROM z UNION ALL SELECT 'position', b0, sqrt(vb0 * f) FROM z UNION ALL SELECT 'period', a1, sqrt(va1 * f) FROM z UNION ALL SELECT 'position:period', b1, sqrt(vb1 * f) FROM z"""
#: Backlinks by order: when each was first seen, and of some when it was lost.
SEEN = """SELECT concat('S', cast(o_custkey % 30 AS string), '.example') AS domain, o_orderkey % 4 AS k, CASE o_orderkey % 4 WHEN 0 THEN 'noopener' WHEN 2 THEN 'NoFollow' WHEN 3 THEN 'ugc sponsored' END AS rel,
  CASE WHEN o_orderkey % 9 > 0 THEN cast(o_orderdate AS date) END AS first_seen, CASE WHEN o_orderkey % 5 = 0 THEN cast(o_orderdate AS date) END AS lost FROM {orders}"""
_series = lambda s, d: fixtures.view(s, d, "fx_dense").groupBy("page", "date").agg(F.sum("impressions").alias("impressions"))
ALL = {
    "cohort_join": (_k(lambda k: k), f"WITH {KEYS} SELECT * FROM ks"),
    "headline_per_day": (lambda s, d: P.headline_per_day(_daily(s, d)), f"WITH {DAY} SELECT period, CAST(greatest(date_diff('day', min(date), max(date)), 1) AS INT) AS days, sum(clicks) / greatest(date_diff('day', min(date), max(date)), 1) AS clicks_per_day, sum(impressions) / greatest(date_diff('day', min(date), max(date)), 1) AS impressions_per_day, sum(clicks) / sum(impressions) AS ctr FROM dy GROUP BY period"),
    "shift_share": (_k(lambda k: P.shift_share(k, 56, 56)), f"WITH {KEYS}, o AS (SELECT count(*) FILTER (cohort = 'retained') AS retained, count(*) FILTER (cohort = 'lost') AS lost, count(*) FILTER (cohort = 'new') AS new, coalesce(sum(clicks_a) FILTER (cohort = 'lost'), 0) / 56 AS lost_clicks, coalesce(sum(clicks_b) FILTER (cohort = 'new'), 0) / 56 AS new_clicks, (sum(clicks_b) FILTER (cohort = 'retained') - sum(clicks_a) FILTER (cohort = 'retained')) / 56 AS retained_change FROM ks) SELECT *, -lost_clicks / (retained_change + new_clicks - lost_clicks) AS share_lost, retained_change / (retained_change + new_clicks - lost_clicks) AS share_retained, new_clicks / (retained_change + new_clicks - lost_clicks) AS share_new FROM o"),
    "position_decomposition": (_k(P.position_decomposition), f"WITH {KEYS}, o AS (SELECT {_WPK('a', 'true')} AS a_all, {_WPK('a', "cohort = 'retained'")} AS a_retained, {_WPK('b', "cohort = 'retained'")} AS b_retained, {_WPK('b', 'true')} AS b_all FROM ks), q AS (SELECT *, (a_retained - a_all) + (b_all - b_retained) AS compositional, b_retained - a_retained AS real FROM o) SELECT *, (compositional > 0) <> (real > 0) AND abs(compositional) > 0.05 AND abs(real) > 0.05 AS signs_disagree FROM q"),
    "categorical_effect": (lambda s, d: P.categorical_effect(_seg(s, d)), f"WITH {SEGC.replace('@top', '15')} {_EFFECT}"),
    "categorical_effect_two": (lambda s, d: P.categorical_effect(_seg(s, d), top=1), f"WITH {SEGC.replace('@top', '1')} {_EFFECT}"),
    "categorical_effect_p": (lambda s, d: P.with_p(P.categorical_effect(_seg(s, d))), f"WITH {SEGC.replace('@top', '15')} SELECT *, CASE WHEN dof = 4 THEN exp(-chi2 / 2) * (1 + chi2 / 2) END AS p FROM ({_EFFECT}) e"),
    "counterfactual": (lambda s, d: P.counterfactual(_daily(s, d)), f"WITH {DAY}, o AS (SELECT regr_slope(clicks, impressions) FILTER (period = 'baseline') AS slope, regr_intercept(clicks, impressions) FILTER (period = 'baseline') AS intercept, regr_r2(clicks, impressions) FILTER (period = 'baseline') AS r2, avg(impressions) FILTER (period = 'current') AS mi, avg(clicks) FILTER (period = 'current') AS actual, regr_slope(ln(clicks), ln(impressions)) FILTER (period = 'baseline' AND clicks > 0 AND impressions > 0) AS elasticity FROM dy) SELECT slope, intercept, r2, actual, elasticity, intercept + slope * mi AS predicted, actual / (intercept + slope * mi) - 1 AS deviation FROM o"),
    "ctr_at_rank": (lambda s, d: P.ctr_at_rank(_rows(s, d)).select("term", "coefficient", "standard_error"), AT_RANK),
    "changepoint": (lambda s, d: P.changepoint(_series(s, d), "page"), f"{BREAKS} SELECT series, break_date, sup_f, before, after FROM b WHERE r = 1"),
    "changepoint_rows": (lambda s, d: P.around_break(_series(s, d), P.changepoint(_series(s, d), "page"), "page"), f"{BREAKS} SELECT y.series, (y.k - b.k)::INT AS \"offset\", y.date, y.m::BIGINT AS impressions FROM y JOIN b ON y.series = b.series AND b.r = 1 WHERE y.k - b.k BETWEEN -5 AND 4"),
    "lost_retained_new": (_k(lambda k: P.lost_retained_new(k, "lost")), f"WITH {KEYS} SELECT key, clicks_a AS clicks FROM ks WHERE cohort = 'lost'"),
    "daily_union": (lambda s, d: P.daily_union([_daily(s, d).where("period = 'current'"), _daily(s, d)]), f"WITH {DAY} SELECT * FROM dy"),
    "anchor_class": (lambda s, d: _links(s, d).groupBy(L.anchor_class(F.col("anchor"), "acme", ["anvil"]).alias("class")).agg(F.count("*").alias("links")), f"WITH {LK} SELECT {_CLASS} AS class, count(*) AS links FROM lk GROUP BY 1"),
    "spam_domain": (lambda s, d: _links(s, d).select("domain", "site", L.spam_domain(F.col("domain"), F.col("source_url"), F.col("score")).alias("spam")), f"WITH {LK} SELECT domain, site, {_SPAM} AS spam FROM lk"),
    "anchor_profile": (lambda s, d: L.anchor_profile(_links(s, d), "acme", ["anvil"]), f"WITH {LK}, o AS (SELECT count(*) AS links, count(DISTINCT d) AS domains, 100.0 * count(*) FILTER ({_CLASS} = 'exact_money') / count(*) AS money_pct, 100.0 * count(*) FILTER ({_CLASS} = 'brand') / count(*) AS brand_pct, count(DISTINCT d) FILTER ({_SPAM}) AS toxic_domains FROM lk) SELECT *, 100.0 * toxic_domains / domains AS toxic_pct, money_pct >= 15 AS over_optimised, brand_pct < 30 AND links > 20 AS brand_poor, 100.0 * toxic_domains / domains >= 20 AS toxic_risk FROM o"),
    "top_anchors": (lambda s, d: L.top_anchors(_links(s, d), 4), f"WITH {LK} SELECT anchor, count(*) AS links, count(DISTINCT d) AS domains FROM lk GROUP BY 1 ORDER BY links DESC, anchor LIMIT 4"),
    "link_velocity": (lambda s, d: L.link_velocity(fixtures.made(s, SEEN, {"orders": s.read.parquet(f"{d}/orders.parquet")})), f"""WITH x AS ({SEEN.replace('{orders}', 'orders')}), o AS (SELECT count(*) AS links, count(DISTINCT lower(domain)) AS domains, count(*) FILTER (k < 2) AS follow, count(DISTINCT lower(domain)) FILTER (k < 2) AS fd, count(first_seen) AS won, count(lost) AS gone,
  greatest(floor(date_diff('day', least(min(first_seen), min(lost)), greatest(max(first_seen), max(lost))) / 30.4375) + 1, 1) AS m FROM x) SELECT links, domains, links / domains AS links_a_domain, follow / links AS follow_share, fd / domains AS follow_domain_share, won / m AS won_a_month, gone / m AS lost_a_month FROM o"""),
    "toxic_multi_source": (_toxic, f"WITH {TOX} SELECT domain, string_agg(src, ',' ORDER BY src) AS sources, count(*) AS n_sources, CASE WHEN domain IN (SELECT domain FROM dv) THEN 'already disavowed' WHEN count(*) >= 2 THEN 'disavow' ELSE 'review' END AS status FROM tb GROUP BY domain"),
    "disavow_merge": (lambda s, d: L.disavow_merge(_disavowed(s, d), _toxic(s, d).where("status = 'disavow'")), f"WITH {TOX} SELECT domain FROM dv UNION SELECT domain FROM tb GROUP BY domain HAVING count(*) >= 2"),
    "link_gap": (lambda s, d: L.link_gap(_links(s, d).where("score >= 50"), "ahrefs"), f"WITH {LK} SELECT domain, count(DISTINCT site) AS competitors FROM lk WHERE score >= 50 AND site <> 'ahrefs' AND domain NOT IN (SELECT domain FROM lk WHERE score >= 50 AND site = 'ahrefs') GROUP BY domain HAVING count(DISTINCT site) >= 2"),
    "referring_profile": (lambda s, d: L.referring_profile(_links(s, d)), f"WITH {LK} SELECT CAST(floor(score / 20) AS INT) AS band, count(DISTINCT domain) AS domains, count(*) AS links FROM lk GROUP BY 1"),
    "keyword_master": (_v("fx_keywords", L.keyword_master), f"WITH {KW} SELECT * FROM km"),
    "keyword_clusters": (_v("fx_keywords", lambda k: L.keyword_clusters(L.keyword_master(k))), f"WITH {KW} SELECT seed, count(*) AS keywords, sum(search_volume) AS volume, arg_max(keyword, search_volume * 1e9 - ordinal) AS top_keyword FROM km GROUP BY seed"),
    "doubled_words": (lambda s, d: L.doubled_words(s.read.parquet(f"{d}/part.parquet").select(F.concat_ws(" ", "p_name", F.element_at(F.split("p_name", " "), (F.col("p_partkey") % 2 + 1).cast("int"))).alias("keyword")).distinct()), "SELECT DISTINCT p_name || ' ' || string_split(p_name, ' ')[p_partkey % 2 + 1] AS keyword, p_partkey % 2 = 1 OR string_split(p_name, ' ')[1] = string_split(p_name, ' ')[2] AS doubled FROM part"),
    "click_kind": (_v("fx_clicks", lambda c: c.select("page", "selector", L.click_kind(F.col("selector")).alias("kind"))), f"WITH {fixtures.cte('fx_clicks')} SELECT page, selector, {_KIND} AS kind FROM fx_clicks"),
    "click_summary": (_v("fx_clicks", L.click_summary), f"WITH {fixtures.cte('fx_clicks')}, c AS (SELECT *, {_KIND} AS kind FROM fx_clicks) SELECT page, CAST(coalesce(sum(clicks) FILTER (kind = 'conversion'), 0) AS BIGINT) AS conversion, CAST(coalesce(sum(clicks) FILTER (kind = 'non_conversion'), 0) AS BIGINT) AS non_conversion, CAST(coalesce(sum(clicks) FILTER (kind = 'ambiguous'), 0) AS BIGINT) AS ambiguous, max(struct_pack(c := clicks, s := selector)) FILTER (kind = 'non_conversion').s AS top_distractor FROM c GROUP BY page".replace("max(struct_pack(c := clicks, s := selector)) FILTER (kind = 'non_conversion').s", "(max(struct_pack(c := clicks, s := selector)) FILTER (kind = 'non_conversion')).s")),
    "largest_band_drop": (_v("fx_scroll", L.largest_band_drop), f"WITH {fixtures.cte('fx_scroll')}, n AS (SELECT *, lead(visitors) OVER w AS nv, lead(depth_pct) OVER w AS nd FROM fx_scroll WINDOW w AS (PARTITION BY page ORDER BY depth_pct)), b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY visitors - nv DESC, depth_pct) AS r FROM n WHERE nv IS NOT NULL) SELECT b.page, depth_pct AS from_depth, nd AS to_depth, visitors - nv AS drop, (SELECT arg_min(visitors, abs(depth_pct - 50)) FROM fx_scroll f WHERE f.page = b.page) AS mid_visitors FROM b WHERE r = 1"),
    "top_attention_band": (_v("fx_scroll", L.top_attention_band), f"WITH {fixtures.cte('fx_scroll')} SELECT page, arg_max(depth_pct, visitors * 1000 - depth_pct) AS depth_pct, max(visitors) AS visitors FROM fx_scroll GROUP BY page"),
}
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
