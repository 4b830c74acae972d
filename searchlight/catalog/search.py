"""Queries over search performance, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlight import fixtures
from searchlight.functions import urls as U
from searchlight.operators import search as S

BRAND = "small|ring"
M = fixtures.cte("fx_search")
D = fixtures.cte("fx_dense")
WP = "sum(position * impressions) FILTER (impressions > 0 AND position IS NOT NULL) / nullif(sum(impressions) FILTER (impressions > 0 AND position IS NOT NULL), 0)"
STRIP = "trim(regexp_replace(regexp_replace(lower(trim(query)), '\\bsmall\\b', ' ', 'g'), '\\s+', ' ', 'g'))"
UNI = f"""{M}, pq AS (SELECT page, query, sum(impressions) AS impressions, sum(clicks) AS clicks, avg(position) AS position FROM fx_search GROUP BY 1, 2),
uni AS (SELECT page, {STRIP} AS query, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks, avg(position) AS position FROM pq WHERE {STRIP} <> '' GROUP BY page, {STRIP})"""
QT = f"{M}, qt AS (SELECT query, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, {WP} AS position FROM fx_search GROUP BY query)"
WK = f"""{D}, w0 AS (SELECT page, CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(clicks) AS DOUBLE) AS clicks FROM fx_dense GROUP BY 1, 2),
w1 AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY week DESC) AS back FROM w0),
wk AS (SELECT page, week, clicks, row_number() OVER (PARTITION BY page ORDER BY week) AS n FROM w1 WHERE back <= 26),
mk0 AS (SELECT a.page, sum(sign(b.clicks - a.clicks)) AS s FROM wk a JOIN wk b ON a.page = b.page AND a.n < b.n GROUP BY a.page),
mk1 AS (SELECT page, count(*) AS n FROM wk GROUP BY page), mk2 AS (SELECT page, sum(c * (c - 1) * (2 * c + 5)) AS t FROM (SELECT page, clicks, count(*) AS c FROM wk GROUP BY 1, 2) x GROUP BY page),
mk3 AS (SELECT mk1.page, mk1.n, coalesce(s, 0) AS s, (mk1.n * (mk1.n - 1) * (2 * mk1.n + 5) - t) / 18 AS var FROM mk1 LEFT JOIN mk0 USING (page) JOIN mk2 USING (page)),
mk AS (SELECT page, CAST(n AS INT) AS n, CAST(s AS DOUBLE) AS s, CASE WHEN n < 8 OR var <= 0 THEN 0.0 ELSE sign(s) * greatest(abs(s) - 1, 0) / sqrt(var) END AS z FROM mk3),
tl AS (SELECT page, z AS trend_slope, CASE WHEN total = 0 THEN 'Hits 0 Clicks' WHEN zeros > 0.4 THEN 'Unstable, Fluctuation and Hits 0 Clicks' WHEN z >= 1.96 AND cv < 0.8 THEN 'Positive, Growing & Stable Position' WHEN z <= -1.96 THEN 'Negative, Declining' WHEN cv > 1.2 THEN 'Random, De-index time and again' ELSE 'Stable, Flat' END AS trend
  FROM (SELECT page, sum(clicks) AS total, avg(CASE WHEN clicks <= 0 THEN 1.0 ELSE 0.0 END) AS zeros, stddev_pop(clicks) / greatest(avg(clicks), 1e-9) AS cv FROM wk GROUP BY page) x JOIN mk USING (page))"""
_BS = "regexp_matches(query, 'small|ring', 'i')"
BSPLIT = f"""{QT}, bs AS (SELECT {_BS} AS brand, count(*) AS queries, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, sum(position * greatest(impressions, 1)) FILTER (position > 0) / sum(greatest(impressions, 1)) FILTER (position > 0) AS position FROM qt GROUP BY 1),
bs2 AS (SELECT *, 100.0 * clicks / impressions AS ctr, 100.0 * clicks / sum(clicks) OVER () AS click_share FROM bs),
pb AS (SELECT 100.0 * coalesce(sum(impressions) FILTER (position <= 3), 0) / sum(impressions) AS p1_3, 100.0 * coalesce(sum(impressions) FILTER (position > 3 AND position <= 10), 0) / sum(impressions) AS p4_10, 100.0 * coalesce(sum(impressions) FILTER (position > 10 AND position <= 20), 0) / sum(impressions) AS p11_20, 100.0 * coalesce(sum(impressions) FILTER (position > 20), 0) / sum(impressions) AS p21, median(clicks / impressions * 100) FILTER (position > 3 AND position <= 10) AS median_ctr_4_10 FROM qt WHERE NOT {_BS})"""
MON = f"{M}, mo AS (SELECT strftime(date, '%Y-%m') AS month, count(DISTINCT date) AS days, day(last_day(any_value(date))) AS expected_days, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, sum(position * greatest(impressions, 1)) FILTER (position > 0) / sum(greatest(impressions, 1)) FILTER (position > 0) AS position FROM fx_search GROUP BY 1)"

_m = lambda f: lambda s, d: f(fixtures.view(s, d, "fx_search"))
_d = lambda f: lambda s, d: f(fixtures.view(s, d, "fx_dense"))
_q = lambda f: lambda s, d: f(S.query_totals(fixtures.view(s, d, "fx_search")))
_pages = lambda f: lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", f(F.col("url")))
_w = lambda f: _d(lambda m: f(S.weekly_clicks(m)))


def _modes(s, d):
    m = fixtures.view(s, d, "fx_search")
    return S.suppression_modes(S.monthly_trend(m), S.query_totals(m), BRAND)


_TRACK = "|".join(U.TRACKING_PREFIXES)
_BARE = "regexp_replace(url, '#.*$', '')"
_KEEP = f"array_to_string(list_filter(string_split(regexp_extract({_BARE}, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^({_TRACK})', 'i')), '&')"
_SEG = "list_filter(regexp_split_to_array(lower(regexp_extract(trim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '/'), '[^/]*$')), '[-_]+'), lambda t: t <> '')"
_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#:].*$', ''), '^www\\.', '')"
_CORE = f"split_part({_HOST}, '.', 1)"
_SLUG = "trim(regexp_replace(lower(regexp_extract(rtrim(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', ''), '/'), '[^/]*$')), '[^a-z0-9]+', '-', 'g'), '-')"
_SUFFIX = "CASE " + " ".join(f"WHEN ends_with(core, '{x}') THEN '{x}'" for x in U.BRAND_SUFFIXES) + " END"

ALL = {
    "strip_query_fragment": (_pages(lambda u: U.strip_query_fragment(u).alias("out")), "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS out FROM pages"),
    "norm_url": (_pages(lambda u: U.norm_url(u).alias("out")), "SELECT page_id, rtrim(url, '/') AS out FROM pages"),
    "canonical_url": (_pages(lambda u: U.canonical_url(F.concat(u, F.lit("&utm_source=x&keep=1"))).alias("out")), f"SELECT page_id, regexp_replace({_BARE}, '\\?.*$', '') || CASE WHEN {_KEEP} <> '' THEN '?' || {_KEEP} ELSE '' END AS out FROM (SELECT page_id, url || '&utm_source=x&keep=1' AS url FROM pages) p"),
    "norm_domain": (_pages(lambda u: U.norm_domain(u).alias("out")), f"SELECT page_id, {_HOST} AS out FROM pages"),
    "slug_of": (_pages(lambda u: U.slug_of(u).alias("out")), f"SELECT page_id, CASE WHEN {_SLUG} = '' THEN 'homepage' ELSE {_SLUG} END AS out FROM pages"),
    "slug_tokens": (lambda s, d: fixtures.view(s, d, "fx_search").select("page").distinct().select("page", F.array_join(U.slug_tokens(F.col("page")), " ").alias("words"), F.array_join(U.slug_numbers(F.col("page")), " ").alias("numbers")), f"WITH {M} SELECT DISTINCT url AS page, array_to_string(list_transform(list_filter({_SEG}, lambda t: NOT regexp_matches(t, '^\\d+$')), lambda t: CASE WHEN length(t) > 3 AND ends_with(t, 's') THEN left(t, length(t) - 1) ELSE t END), ' ') AS words, array_to_string(list_filter({_SEG}, lambda t: regexp_matches(t, '^\\d+$')), ' ') AS numbers FROM (SELECT page AS url FROM fx_search) x"),
    "brand_tokens": (_pages(lambda u: F.array_join(U.brand_tokens(u), "|").alias("out")), f"SELECT page_id, CASE WHEN length(core) < 3 THEN '' WHEN suffix IS NOT NULL AND length(core) - length(suffix) >= 3 THEN core || '|' || left(core, length(core) - length(suffix)) || '|' || left(core, length(core) - length(suffix)) || ' ' || suffix ELSE core END AS out FROM (SELECT page_id, core, {_SUFFIX} AS suffix FROM (SELECT page_id, {_CORE} AS core FROM pages) a) b"),
    "strip_brand": (lambda s, d: fixtures.view(s, d, "fx_search").select("query").distinct().select("query", U.strip_brand(F.col("query"), ["small"]).alias("out")), f"WITH {M} SELECT DISTINCT query, {STRIP} AS out FROM fx_search"),
    "brand_flag": (_q(lambda q: q.select("query", S.is_brand(F.col("query"), BRAND).alias("brand"))), f"WITH {QT} SELECT query, {_BS} AS brand FROM qt"),
    "search_universe": (_m(lambda m: S.search_universe(m, ["small"])), f"WITH {UNI} SELECT * FROM uni"),
    "query_idf": (_m(lambda m: S.query_idf(S.search_universe(m, ["small"]))), f"WITH {UNI} SELECT query, count(DISTINCT page) AS df, ln((SELECT count(DISTINCT page) FROM uni) / count(DISTINCT page)) AS idf FROM uni GROUP BY query"),
    "top_click_queries": (_m(lambda m: S.top_click_queries(S.search_universe(m, ["small"]))), f"WITH {UNI} SELECT page, query, clicks, CAST(rank AS INT) AS rank FROM (SELECT page, query, clicks, row_number() OVER (PARTITION BY page ORDER BY clicks DESC, query) AS rank FROM uni WHERE clicks > 0) x WHERE rank <= 10"),
    "weekly_series": (_m(S.weekly_series), f"WITH {M} SELECT page, query, CAST(date_trunc('week', date) AS DATE) AS week, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, {WP} AS position FROM fx_search GROUP BY 1, 2, 3"),
    "mann_kendall": (_w(S.mann_kendall), f"WITH {WK} SELECT page, n, s, z, CASE WHEN abs(z) < 1.96 THEN 'flat' WHEN z > 0 THEN 'up' ELSE 'down' END AS direction FROM mk"),
    "trend_label": (_w(S.trend_label), f"WITH {WK} SELECT page, trend, trend_slope FROM tl"),
    "page_rollup": (_d(S.page_rollup), f"WITH {WK} SELECT x.*, trend, trend_slope FROM (SELECT page, CAST(sum(clicks) AS BIGINT) AS clicks_window, CAST(sum(impressions) AS BIGINT) AS impressions_window, count(DISTINCT query) AS queries, sum(position * impressions) FILTER (date >= cut AND impressions > 0) / sum(impressions) FILTER (date >= cut AND impressions > 0) AS avg_position_90d, min(date) FILTER (clicks > 0) AS first_click, max(date) FILTER (clicks > 0) AS last_click FROM (SELECT *, (SELECT max(date) - 90 FROM fx_dense) AS cut FROM fx_dense) y GROUP BY page) x JOIN tl USING (page)"),
    "multi_page_queries": (_m(S.multi_page_queries), f"WITH {M} SELECT query, count(DISTINCT page) AS pages, CAST(sum(impressions) AS BIGINT) AS impressions, CAST(sum(clicks) AS BIGINT) AS clicks FROM fx_search GROUP BY query HAVING count(DISTINCT page) >= 2 ORDER BY pages DESC, impressions DESC, query LIMIT 50"),
    "monthly_trend": (_m(S.monthly_trend), f"WITH {MON} SELECT *, days < expected_days AS partial, 100.0 * clicks / impressions AS ctr FROM mo"),
    "brand_split": (_q(lambda q: S.brand_split(q, BRAND)), f"WITH {BSPLIT} SELECT * FROM bs2"),
    "brand_top_queries": (_q(lambda q: S.brand_top_queries(q, BRAND)), f"WITH {QT} SELECT {_BS} AS brand, (row_number() OVER (PARTITION BY {_BS} ORDER BY clicks DESC, impressions DESC, query))::INT AS rank, query, clicks, impressions FROM qt QUALIFY rank <= 25"),
    "zero_click_queries": (_q(lambda q: S.zero_click_queries(q, BRAND, below_ctr=13)), f"WITH {QT} SELECT query, impressions, clicks / impressions * 100 AS ctr, position FROM qt WHERE NOT {_BS} AND position > 0 AND position <= 10 AND impressions >= 500 AND clicks / impressions * 100 < 13 ORDER BY impressions DESC, query LIMIT 25"),
    "position_bands": (_q(lambda q: S.position_bands(q, BRAND)), f"WITH {BSPLIT} SELECT * FROM pb"),
    "graduation_score": (_q(lambda q: S.graduation_score(q, BRAND)), f"WITH {BSPLIT}, g AS (SELECT greatest(0, least(1, (100 - bsh) / 50)) AS nonbrand_share, greatest(0, least(1, (30 - np) / 22)) AS nonbrand_position, greatest(0, least(1, (p1_3 + p4_10) / 40)) AS page1_share, greatest(0, least(1, median_ctr_4_10 / 3)) AS ctr_at_rank FROM (SELECT max(click_share) FILTER (brand) AS bsh, max(position) FILTER (NOT brand) AS np FROM bs2) x, pb), h AS (SELECT *, 100 * (0.3 * nonbrand_share + 0.3 * nonbrand_position + 0.25 * page1_share + 0.15 * ctr_at_rank) AS score FROM g) SELECT *, CASE WHEN score >= 70 THEN 'graduated' WHEN score >= 45 THEN 'emerging' WHEN score >= 25 THEN 'suppressed' ELSE 'deep suppression' END AS stage FROM h"),
    "suppression_modes": (_modes, f"WITH {BSPLIT}, {MON.split(', mo AS')[1] and 'mo AS' + MON.split(', mo AS')[1]}, f AS (SELECT *, row_number() OVER (ORDER BY month) AS r, count(*) OVER () AS m, greatest(1, floor(count(*) OVER () / 3)) AS k FROM mo WHERE days >= expected_days), c AS (SELECT count(*) AS months, coalesce((avg(impressions) FILTER (r > m - k) - avg(impressions) FILTER (r <= k)) / avg(impressions) FILTER (r <= k) * 100, 0) AS ic, coalesce((avg(clicks) FILTER (r > m - k) - avg(clicks) FILTER (r <= k)) / avg(clicks) FILTER (r <= k) * 100, 0) AS cc FROM f) SELECT months >= 4 AND ic > 20 AND cc < 10 AND np > 12 AS trust_hold, false AS core_update, p1_3 + p4_10 >= 25 AND median_ctr_4_10 < 1 AS zero_click, bsh >= 75 AS brand_only FROM c, pb, (SELECT max(click_share) FILTER (brand) AS bsh, max(position) FILTER (NOT brand) AS np FROM bs2) x"),
    "window_delta": (_m(lambda m: S.window_delta(m, "page", F.lit("2024-02-22").cast("date"))), f"WITH {M}, l AS (SELECT page, CAST(sum(clicks) AS BIGINT) AS clicks_long, CAST(sum(impressions) AS BIGINT) AS impressions_long, {WP} AS position_long FROM fx_search GROUP BY page), s AS (SELECT page, CAST(sum(clicks) AS BIGINT) AS clicks_short, CAST(sum(impressions) AS BIGINT) AS impressions_short, {WP} AS position_short FROM fx_search WHERE date >= DATE '2024-02-22' GROUP BY page) SELECT page, coalesce(clicks_long, 0) AS clicks_long, coalesce(impressions_long, 0) AS impressions_long, coalesce(position_long, 0) AS position_long, coalesce(clicks_short, 0) AS clicks_short, coalesce(impressions_short, 0) AS impressions_short, coalesce(position_short, 0) AS position_short, coalesce(clicks_short, 0) - coalesce(clicks_long, 0) AS clicks_delta, coalesce(impressions_short, 0) - coalesce(impressions_long, 0) AS impressions_delta, coalesce(position_short, 0) - coalesce(position_long, 0) AS position_delta FROM l FULL JOIN s USING (page)"),
    "opportunity_queries": (_m(lambda m: S.opportunity_queries(m.select(F.concat_ws(" ", "page", "query").alias("query"), "clicks", "impressions", "position"))), f"WITH {M} SELECT page || ' ' || query AS query, impressions, position, clicks / impressions AS ctr FROM fx_search WHERE impressions >= 300 AND position <= 20 AND clicks / impressions <= 0.02"),
    "ctr_position_reading": (_q(S.ctr_position_reading), f"WITH {QT} SELECT query, position, clicks / impressions AS ctr, CASE WHEN position <= 3 AND clicks / impressions < 0.02 THEN 'snippet or intent problem' WHEN position <= 10 AND clicks / impressions < 0.01 THEN 'page one without clicks' WHEN position BETWEEN 4 AND 20 THEN 'striking distance' WHEN position > 20 THEN 'not competing' END AS reading FROM qt"),
    "position_tiers": (_m(S.position_tiers), f"WITH {M} SELECT {', '.join(f'count(*) FILTER (position <= {t}) AS top_{t}' for t in (3, 5, 10, 50, 100))} FROM fx_search"),
}
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items()}
