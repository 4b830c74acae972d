"""Queries over web-server logs, with the same answers in SQL."""

from __future__ import annotations

from searchlight import fixtures
from searchlight.functions import agents as A
from searchlight.operators import advice
from searchlight.operators import weblog as W

RANGES = "(VALUES (1, 'search_bot', 'Googlebot', 1123631104, 1123639295), (2, 'search_bot', 'Google Common Crawler', 1123631104, 1123631359), (3, 'seo_tool', 'Ahrefsbot', 167968768, 168034303)) t(list_order, class, agent, lo, hi)"


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _has(column: str, pattern: str, flags: str = "i") -> str:
    return f"regexp_matches({column}, {_q(pattern)}, '{flags}')"


PURPOSE = "CASE WHEN coalesce(url, '') = '' THEN 'unknown' " + " ".join(f"WHEN {_has('url', p)} THEN '{n}'" for n, p in A.PURPOSES) + f" WHEN {_has('url', A.TRACKING)} THEN 'tracked_content' ELSE 'content' END"
PATH = "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*:)?(//[^/?#]*)?([^?#]*)', 3)"
LAST = f"regexp_extract(lower({PATH}), '[^/]*$')"
EXT = f"CASE WHEN contains({LAST}, '.') THEN regexp_extract({LAST}, '[^.]*$') ELSE '' END"
CTYPE = f"CASE {' '.join(f'WHEN {EXT} IN ({", ".join(map(_q, e))}) THEN {_q(k)}' for k, e in A.EXTENSIONS.items())} WHEN contains(lower({PATH}), 'sitemap') THEN 'XML' WHEN lower({PATH}) = '/robots.txt' THEN 'Text' WHEN ends_with({PATH}, '/') OR {EXT} = '' THEN 'HTML' ELSE 'Other' END"
CRAWLER = "CASE " + " ".join("WHEN " + " AND ".join(f"contains(lower(ua), {_q(w)})" for w in words) + f" THEN {_q(n)}" for n, words in A.NAMED_CRAWLERS) + " END"
INFRA = "CASE " + " ".join("WHEN " + " OR ".join([f"contains(ua, {_q(w)})" for w in exact] + [f"contains(lower(ua), {_q(w)})" for w in low]) + f" THEN {_q(n)}" for n, exact, low in A.INFRA) + " END"
GENERIC = "CASE WHEN ua IN ('', '-') THEN 'No User-Agent' WHEN " + " OR ".join(f"contains(lower(ua), {_q(w)})" for w in A.BOT_SIGNALS) + " THEN substring(ua, 1, 60) END"
_in = lambda names: "(" + ", ".join(map(_q, names)) + ")"

#: From fx_weblog to r: the classified requests.
CLASSIFIED = f"""{fixtures.cte('fx_weblog')},
q AS (SELECT *, coalesce(user_agent, '') AS ua, {PURPOSE} AS purpose, {CTYPE} AS content_type FROM fx_weblog),
ipp AS (SELECT ip, count(*) AS ip_hits, count(*) FILTER (purpose IN {_in(A.ADMIN_LIKE)}) AS admin_hits FROM q GROUP BY ip),
ipn AS (SELECT *, CAST(split_part(ip, '.', 1) AS BIGINT) * 16777216 + CAST(split_part(ip, '.', 2) AS BIGINT) * 65536 + CAST(split_part(ip, '.', 3) AS BIGINT) * 256 + CAST(split_part(ip, '.', 4) AS BIGINT) AS n FROM ipp),
ver AS (SELECT ip, arg_min(t.class, t.list_order) AS vclass, arg_min(t.agent, t.list_order) || ' (verified IP)' AS vagent FROM ipn JOIN {RANGES} ON n BETWEEN t.lo AND t.hi GROUP BY ip),
c0 AS (SELECT q.*, ip_hits, admin_hits / ip_hits AS admin_share, vclass, vagent, {CRAWLER} AS crawler, {INFRA} AS infra_name, {GENERIC} AS generic, (SELECT count(*) FROM q) AS total_hits
  FROM q JOIN ipp USING (ip) LEFT JOIN ver USING (ip)),
r AS (SELECT *,
  CASE WHEN vagent IS NOT NULL THEN vclass WHEN generic = 'No User-Agent' THEN 'generic_bot'
    WHEN crawler IN {_in(A.SEO_TOOLS)} THEN 'seo_tool' WHEN crawler IN {_in(A.AI_FETCHERS)} THEN 'generic_bot' WHEN crawler IS NOT NULL THEN 'search_bot'
    WHEN infra_name IS NOT NULL THEN 'infra' WHEN generic IS NOT NULL THEN 'generic_bot' WHEN admin_share > 0.5 THEN 'human'
    WHEN {_has('ua', A.FUTURE_CHROME, 'c')} OR (ip_hits > 500 AND ip_hits / total_hits > 0.1 AND admin_share < 0.3) THEN 'suspicious' ELSE 'human' END AS class,
  CASE WHEN vagent IS NOT NULL THEN vagent WHEN generic = 'No User-Agent' THEN generic WHEN crawler IS NOT NULL THEN crawler WHEN infra_name IS NOT NULL THEN infra_name
    WHEN generic IS NOT NULL THEN generic WHEN admin_share > 0.5 THEN 'Logged-in Admin / Session'
    WHEN {_has('ua', A.FUTURE_CHROME, 'c')} THEN CASE WHEN ip_hits / total_hits > 0.1 THEN 'Mass Scraper (impossible UA)' ELSE 'Suspicious UA (Chrome 200+, not yet released)' END
    WHEN ip_hits > 500 AND ip_hits / total_hits > 0.1 AND admin_share < 0.3 THEN 'High-volume IP, content-dominated (' || ip_hits || ' hits)' ELSE 'Human' END AS agent,
  NOT (vagent IS NULL AND crawler IS NULL AND infra_name IS NULL AND generic IS NULL AND (admin_share > 0.5 OR NOT ({_has('ua', A.FUTURE_CHROME, 'c')} OR (ip_hits > 500 AND ip_hits / total_hits > 0.1 AND admin_share < 0.3)))) AS automated,
  vagent IS NOT NULL AS verified FROM c0)"""
_SEG = "CASE greatest(" + ", ".join(W.CLASSES) + ") " + " ".join(f"WHEN {c} THEN {_q(W.CLASS_LABELS[c])}" for c in W.CLASSES) + " END"
URLS = f"""{CLASSIFIED},
u0 AS (SELECT url, count(*) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes, max(struct_pack(ts := ts, status := status)) AS l, any_value(purpose) AS purpose, any_value(content_type) AS content_type,
  count(*) FILTER (verified) AS verified_hits,
  {', '.join(f'count(*) FILTER (status = {c}) AS s{c}' for c in (200, 206, 301, 302, 403, 404, 500, 502, 503, 504))},
  {', '.join(f"count(*) FILTER (status = {c} AND contains(lower(agent), 'googlebot')) AS g{c}" for c in (404, 500, 502, 503, 504))},
  {', '.join(f"count(*) FILTER (class = '{c}') AS {c}" for c in W.CLASSES)} FROM r GROUP BY url),
u AS (SELECT u0.* EXCLUDE (l), l.status AS last_status, l.ts AS last_seen, {_SEG} AS segment FROM u0)"""


def _find(category: str, issue: str, urgency: str, confidence: str, *, url="url", segment="segment", status="''", hits="hits") -> str:
    lit = lambda v: v if v.startswith(("CASE", "'", "(")) else _q(v)
    return f"{_q(category)} AS category, {lit(issue)} AS issue, {url} AS url, {segment} AS segment, CAST({status} AS VARCHAR) AS status_code, CAST({hits} AS BIGINT) AS hits, {lit(urgency)} AS urgency, {lit(confidence)} AS confidence"


P1, P2, P3 = map(_q, (W.P1, W.P2, W.P3))
_STATIC = _in(A.STATIC_TYPES)
_5XX = "(SELECT url, segment, hits AS total, unnest([500, 502, 503, 504]) AS code, unnest([s500, s502, s503, s504]) AS n, unnest([g500, g502, g503, g504]) AS g FROM u)"
_SENS = "CASE " + " ".join(f"WHEN {_has('url', p)} THEN {_q(n)}" for n, p in W.SENSITIVE) + " END"
_BACK = "CASE " + " ".join(f"WHEN contains(lower(url), {_q(k)}) THEN {_q(n)}" for k, n in W.BACKEND) + " END"
_G = "(SELECT count(*) AS total, count(*) FILTER (automated) AS automated, count(*) FILTER (class = 'search_bot') AS search_bot, count(*) FILTER (contains(lower(agent), 'googlebot')) AS google, count(*) FILTER (contains(lower(agent), 'googlebot') AND regexp_matches(ua, 'Mobile|Android|Smartphone')) AS google_mobile, (epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9 AS span_hours FROM r)"
_BAD = "(s404 + s500 + s502 + s503)"
_CODES = "'[' || concat_ws(', ', CASE WHEN s404 > 0 THEN '404' END, CASE WHEN s500 > 0 THEN '500' END, CASE WHEN s502 > 0 THEN '502' END, CASE WHEN s503 > 0 THEN '503' END) || ']'"
_SERVER = "(s500 + s502 + s503 > 0)"
#: Looser limits where the given tables would leave nothing to compare.
INFRA_PCT, STATIC_PCT, MOBILE_PCT, GOOGLE_PCT, SHARE_301 = 5, 10, 101, 101, 0.05

_BASE, _QUERY = "split_part(url, '?', 1)", "substring(url, instr(url, '?'))"
FINDINGS = {
    "issue_404": f"SELECT {_find('HTTP Errors', '404 Not Found', f'CASE WHEN g404 >= 5 THEN {P1} WHEN g404 >= 1 OR s404 >= 10 THEN {P2} ELSE {P3} END', "CASE WHEN g404 >= 1 OR s404 >= 10 THEN 'High' ELSE 'Medium' END", status="'404'", hits='s404')} FROM u WHERE (s404 >= 3 OR g404 >= 1) AND purpose <> 'scanner_probe'",
    "issue_5xx": f"SELECT {_find('HTTP Errors', "(code || ' Server Error')", f'CASE WHEN g >= 3 THEN {P1} WHEN g >= 1 THEN {P2} WHEN n >= 10 AND n / total >= 0.1 THEN {P1} ELSE {P2} END', "CASE WHEN g >= 1 OR (n >= 10 AND n / total >= 0.05) THEN 'High' ELSE 'Medium' END", status='code', hits='n')} FROM {_5XX} WHERE n > 0 AND (n >= 10 OR n / total >= 0.05 OR g >= 1)",
    "issue_301": f"SELECT {_find('Redirects', '301 Redirect Still Being Crawled', f'CASE WHEN s301 >= 50 THEN {P1} WHEN s301 >= 20 THEN {P2} ELSE {P3} END', "CASE WHEN s301 >= 20 THEN 'High' ELSE 'Medium' END", status="'301'", hits='s301')} FROM u WHERE s301 >= 5 AND s301 / hits >= @share301",
    "issue_302": f"SELECT {_find('Redirects', '302 Temporary Redirect', W.P2, "CASE WHEN s302 >= 10 THEN 'High' ELSE 'Medium' END", status="'302'", hits='s302')} FROM u WHERE s302 >= 3 AND purpose IN ('content', 'tracked_content')",
    "issue_redirect_chain": f"SELECT {_find('Redirects', 'Redirect Chain Detected', W.P2, "CASE WHEN h.hits >= 10 THEN 'High' ELSE 'Medium' END", status="'301 > 301'", hits='h.hits', url='u.url')} FROM (SELECT url, sum(n) AS hits FROM (SELECT trim(referrer) AS ref, url, count(*) AS n FROM r WHERE status = 301 AND trim(referrer) NOT IN ('', '-') GROUP BY 1, 2) x WHERE EXISTS (SELECT 1 FROM u WHERE s301 >= 1 AND contains(x.ref, u.url)) AND (SELECT count(*) FILTER (trim(referrer) NOT IN ('', '-')) / count(*) FROM r) >= 0.2 GROUP BY url ORDER BY hits DESC, url LIMIT 10) h JOIN u ON u.url = h.url",
    "issue_backend_crawl": f"SELECT {_find('Crawl Budget', f"('Backend URL Crawled: ' || {_BACK})", W.P1, 'High', segment="'Bots'", status='last_status')} FROM u WHERE {_BACK} IS NOT NULL AND search_bot >= 3",
    "issue_infra_share": f"SELECT {_find('Crawl Budget', "('High Internal Traffic: ' || agent)", f'CASE WHEN pct > 20 THEN {P2} ELSE {P3} END', 'High', url="'Multiple'", segment="'Infrastructure'")} FROM (SELECT agent, count(*) AS hits, count(*) / (SELECT count(*) FROM r) * 100 AS pct FROM r WHERE class = 'infra' GROUP BY agent) x WHERE pct > @infra",
    "issue_suspicious_ip": f"SELECT {_find('Security / Spam', 'Suspicious High-Volume IP', f"CASE WHEN conf = 'High' THEN CASE WHEN pct > 20 THEN {P1} ELSE {P2} END WHEN conf = 'Medium' THEN {P2} ELSE {P3} END", '(conf)', url='ip', segment="'Suspicious'")} FROM (SELECT *, CASE WHEN try_cast(nullif(regexp_extract(a, 'Chrome/(\\d+)\\.', 1), '') AS INT) >= 200 AND cs > 0.5 THEN 'High' WHEN cs > 0.3 THEN 'Medium' ELSE 'Low' END AS conf, hits / (SELECT count(*) FROM r) * 100 AS pct FROM (SELECT ip, count(*) AS hits, min(user_agent) AS a, count(*) FILTER (purpose IN ('content', 'tracked_content')) / count(*) AS cs FROM r WHERE class = 'suspicious' GROUP BY ip ORDER BY hits DESC, ip LIMIT 10) y) x",
    "issue_param_explosion": f"SELECT {_find('Crawl Budget', 'URL Parameter Explosion', W.P2, "CASE WHEN variants >= 50 OR tracking >= 20 THEN 'High' ELSE 'Medium' END", url='base', segment="'All'")} FROM (SELECT {_BASE} AS base, count(*) AS variants, count(*) FILTER ({_has(_QUERY, A.TRACKING)}) AS tracking, sum(hits) AS hits, sum(count(*)) OVER () AS al FROM u WHERE contains(url, '?') AND purpose NOT IN ('admin_polling', 'admin_ui', 'scanner_probe', 'static_asset') GROUP BY 1) x WHERE al > 5 AND (variants >= 20 OR tracking >= 5)",
    "issue_static_ratio": f"SELECT {_find('Crawl Budget', 'High Static Asset Crawl Ratio', f'CASE WHEN pct > 35 THEN {P2} ELSE {P3} END', "CASE WHEN pct > 40 THEN 'High' ELSE 'Medium' END", url="'Static assets'", segment="'Bots'")} FROM (SELECT count(*) FILTER (automated) AS automated, count(*) FILTER (automated AND content_type IN {_STATIC}) AS hits, count(*) FILTER (automated AND content_type IN {_STATIC}) / count(*) FILTER (automated) * 100 AS pct FROM r) x WHERE automated > 50 AND pct > @static",
    "issue_low_value": f"SELECT {_find('Crawl Budget', 'Low-Value Taxonomy Pages Over-Crawled', W.P2, 'Medium', url="'Multiple'", segment="'All'")} FROM (SELECT count(*) AS n, sum(hits) AS hits FROM u WHERE {' OR '.join(f"contains(lower(url), '{p}')" for p in W.LOW_VALUE)}) x WHERE n > 5 AND hits / (SELECT count(*) FILTER (automated) FROM r) * 100 > 10",
    "issue_robots": f"SELECT {_find('Indexability', 'robots.txt Returning Error', f'CASE WHEN {_SERVER} THEN {P1} ELSE {P2} END', f"CASE WHEN {_BAD} / hits >= 0.5 OR {_SERVER} THEN 'High' ELSE 'Medium' END", status=_CODES)} FROM u WHERE contains(url, '/robots.txt') AND {_BAD} > 0 AND ({_BAD} / hits >= 0.1 OR {_SERVER})",
    "issue_sitemap": f"SELECT {_find('Indexability', 'Sitemap Returning Error', W.P2, f"CASE WHEN {_BAD} / hits >= 0.5 OR {_SERVER} THEN 'High' ELSE 'Medium' END", status=_CODES)} FROM u WHERE contains(lower(url), 'sitemap') AND {_BAD} > 0 AND ({_BAD} / hits >= 0.1 OR {_SERVER})",
    "issue_trailing_slash": f"SELECT {_find('Indexability', 'Trailing Slash Duplicate URLs', W.P2, 'High', url='a.url', segment='a.segment', hits='a.hits + b.hits')} FROM u a JOIN u b ON ends_with(a.url, '/') AND b.url = left(a.url, length(a.url) - 1) WHERE a.s301 / a.hits <= 0.8 AND b.s301 / b.hits <= 0.8",
    "issue_oversized_html": f"SELECT {_find('Performance', 'Oversized HTML Page', W.P3, "CASE WHEN floor(m / 1024) > 1500 THEN 'High' ELSE 'Medium' END", status='last_status')} FROM (SELECT *, bytes / hits AS m FROM u WHERE content_type = 'HTML' AND bytes / hits > 750000 ORDER BY m DESC, url LIMIT 10) x",
    "issue_sensitive_file": f"SELECT {_find('Security', f"('Sensitive File: ' || {_SENS})", f'CASE WHEN s200 + s206 > 0 THEN {P1} ELSE {P3} END', "CASE WHEN s200 + s206 > 0 OR s403 + s404 >= 5 THEN 'High' ELSE 'Medium' END", status='last_status')} FROM u WHERE {_SENS} IS NOT NULL",
    "issue_mobile_share": f"SELECT {_find('Indexability', 'Googlebot Mobile-First Imbalance', f'CASE WHEN google_mobile / google * 100 < 30 THEN {P2} ELSE {P3} END', "CASE WHEN google >= 200 THEN 'High' ELSE 'Medium' END", url="'Site-wide'", segment="'Search Bots'", hits='google')} FROM {_G} x WHERE google >= 50 AND google_mobile / google * 100 < @mobile",
    "issue_low_googlebot": f"SELECT {_find('Indexability', 'Low Googlebot Activity', f'CASE WHEN span_hours < 48 THEN {P3} WHEN google / base * 100 < 2 THEN {P1} ELSE {P2} END', "CASE WHEN span_hours < 48 THEN 'Low' ELSE 'High' END", url="'Site-wide'", segment="'Search Bots'", hits='google')} FROM (SELECT *, CASE WHEN search_bot >= 20 THEN search_bot WHEN automated > 50 THEN automated END AS base FROM {_G} y) x WHERE base IS NOT NULL AND google / base * 100 < @google",
}


def _limits(sql: str, loose: bool) -> str:
    values = {"@share301": SHARE_301, "@infra": INFRA_PCT, "@static": STATIC_PCT, "@mobile": MOBILE_PCT, "@google": GOOGLE_PCT} if loose else {"@share301": 0.5, "@infra": 15, "@static": 30, "@mobile": 50, "@google": 10}
    for name, value in values.items():
        sql = sql.replace(name, str(value))
    return sql


_ALL = " UNION ALL ".join(f"SELECT * FROM ({_limits(s, False)})" for s in FINDINGS.values())
ALL_FINDINGS = f"{URLS}, f AS ({_ALL})"
_RANK = f"CASE urgency WHEN {P1} THEN 0 WHEN {P2} THEN 1 ELSE 2 END"


def _data(spark, sf_dir):
    requests = fixtures.view(spark, sf_dir, "fx_weblog")
    return requests, fixtures.view(spark, sf_dir, "fx_ranges")


def _classified(spark, sf_dir):
    return W.classify_requests(*_data(spark, sf_dir))


def _urls(spark, sf_dir):
    return W.url_rollup(_classified(spark, sf_dir))


def _both(f, **how):
    def run(spark, sf_dir):
        c = _classified(spark, sf_dir)
        return f(c, W.url_rollup(c), **how)

    return run


_on_c = lambda f, **how: lambda spark, sf_dir: f(_classified(spark, sf_dir), **how)
_on_u = lambda f, **how: lambda spark, sf_dir: f(_urls(spark, sf_dir), **how)


def _kept(spark, sf_dir):
    """The classified requests and their roll-up, kept while eighteen rules read them; they spill to disk."""
    c = _classified(spark, sf_dir).persist()
    return c, W.url_rollup(c).persist()


def _findings(spark, sf_dir):
    return W.all_findings(*_kept(spark, sf_dir))


def _health(spark, sf_dir):
    c, urls = _kept(spark, sf_dir)
    return W.health_score(c, W.all_findings(c, urls))


_URL_COLUMNS = ["url", "hits", "bytes", "purpose", "content_type", "last_status", "last_seen", "segment", "verified_hits", *W.CLASSES, "s200", "s301", "s302", "s404", "s500"]
_W = lambda cte, select: f"WITH {cte} {select}"
_SHARE = "round(count(*) / sum(count(*)) OVER () * 100, 2) AS pct"

from pyspark.sql import functions as F  # noqa: E402

#: Addresses of both kinds, in either case and with or without a gap, and a list whose networks overlap.
MIXED = """SELECT DISTINCT CASE user_id % 5 WHEN 0 THEN concat('2001:4860:4801:', lower(hex(cast(user_id % 64 AS int))), '::', lower(hex(cast(user_id % 65536 AS int)))) WHEN 1 THEN concat('2A03:288', hex(cast(user_id % 16 AS int)), ':F::1')
  WHEN 2 THEN concat('10.1.2.', cast(user_id % 256 AS string)) WHEN 3 THEN concat('fe80:0:0:0:0:0:0:', lower(hex(cast(user_id % 65536 AS int)))) ELSE concat('::', lower(hex(cast(user_id % 65536 AS int)))) END AS ip, user_id % 5 AS k, user_id % 64 AS a, user_id % 16 AS b FROM {events}"""
NETWORKS = """SELECT list_order, class, agent, cidr, cast(lo AS bigint) AS lo, cast(hi AS bigint) AS hi FROM (VALUES (3, 'search_bot', 'Wide', '2001:4860:4801::/48', NULL, NULL), (2, 'search_bot', 'Narrow', '2001:4860:4801:10:0:0:0:0/60', NULL, NULL),
  (4, 'generic_bot', 'Social', '2a03:2880::/29', NULL, NULL), (5, 'seo_tool', 'Four', '10.1.2.0/24', 167838208, 167838463), (6, 'seo_tool', 'Late', '2001:4860::/32', NULL, NULL), (7, 'infra', 'One', '::1f/128', NULL, NULL), (8, 'infra', 'Broken', '2001:zz::/200', NULL, NULL)) t(list_order, class, agent, cidr, lo, hi)"""


def _mixed(s, d):
    return fixtures.made(s, MIXED, {"events": s.read.parquet(f"{d}/events.parquet")})


SIMPLE = {
    "verify_bot_ip_mixed": (lambda s, d: W.verify_bot_ip(_mixed(s, d), s.sql(NETWORKS)), f"SELECT DISTINCT ip, CASE k WHEN 0 THEN 'search_bot' WHEN 1 THEN 'generic_bot' WHEN 2 THEN 'seo_tool' ELSE 'infra' END AS verified_class, CASE WHEN k = 0 AND a BETWEEN 16 AND 31 THEN 'Narrow' WHEN k = 0 THEN 'Wide' WHEN k = 1 THEN 'Social' WHEN k = 2 THEN 'Four' ELSE 'One' END || ' (verified IP)' AS verified_agent FROM ({MIXED.replace('{events}', 'events')}) m WHERE k IN (0, 2) OR k = 1 AND b < 8 OR ip = '::1f'"),
    "url_purpose": (lambda s, d: _data(s, d)[0].select("event_id", A.url_purpose(F.col("url")).alias("purpose")), _W(CLASSIFIED, "SELECT event_id, purpose FROM q")),
    "content_type": (lambda s, d: _data(s, d)[0].select("event_id", A.content_type(F.col("url")).alias("content_type")), _W(CLASSIFIED, "SELECT event_id, content_type FROM q")),
    "named_crawler": (lambda s, d: _data(s, d)[0].select("event_id", A.named_crawler(F.col("user_agent")).alias("crawler"), A.crawler_class(A.named_crawler(F.col("user_agent"))).alias("class")), _W(CLASSIFIED, f"SELECT event_id, crawler, CASE WHEN crawler IN {_in(A.SEO_TOOLS)} THEN 'seo_tool' WHEN crawler IN {_in(A.AI_FETCHERS)} THEN 'generic_bot' WHEN crawler IS NOT NULL THEN 'search_bot' END AS class FROM c0")),
    "infra_agent": (lambda s, d: _data(s, d)[0].select("event_id", A.infra_agent(F.col("user_agent")).alias("infra")), _W(CLASSIFIED, "SELECT event_id, infra_name AS infra FROM c0")),
    "generic_bot": (lambda s, d: _data(s, d)[0].select("event_id", A.generic_bot(F.col("user_agent")).alias("bot")), _W(CLASSIFIED, "SELECT event_id, generic AS bot FROM c0")),
    "agent_modernity": (lambda s, d: _data(s, d)[0].select("event_id", A.is_real_browser(F.col("user_agent")).alias("real_browser"), A.chrome_version(F.col("user_agent")).alias("chrome"), F.coalesce(A.chrome_version(F.col("user_agent")) >= 200, F.lit(False)).alias("future")), _W(fixtures.cte("fx_weblog"), "SELECT event_id, regexp_matches(user_agent, 'Mozilla/5\\.0.*AppleWebKit', 'i') AS real_browser, try_cast(nullif(regexp_extract(user_agent, 'Chrome/(\\d+)\\.', 1), '') AS INT) AS chrome, coalesce(try_cast(nullif(regexp_extract(user_agent, 'Chrome/(\\d+)\\.', 1), '') AS INT) >= 200, false) AS future FROM fx_weblog")),
    "ip_profile": (lambda s, d: W.ip_profile(_data(s, d)[0]), _W(CLASSIFIED, "SELECT ip, ip_hits AS hits, admin_hits, admin_hits / ip_hits AS admin_share FROM ipp")),
    "verify_bot_ip": (lambda s, d: W.verify_bot_ip(*_data(s, d)), _W(CLASSIFIED, "SELECT ip, vclass AS verified_class, vagent AS verified_agent FROM ver")),
    "classify_requests": (lambda s, d: _classified(s, d).select("event_id", "ip", "url", "class", "agent", "automated", "verified"), _W(CLASSIFIED, "SELECT event_id, ip, url, class, agent, automated, verified FROM r")),
    "url_rollup": (lambda s, d: _urls(s, d).select(*_URL_COLUMNS), _W(URLS, f"SELECT {', '.join(_URL_COLUMNS)} FROM u")),
    "top_urls": (lambda s, d: _urls(s, d).select("url", "hits").orderBy(F.desc("hits"), "url").limit(50), _W(URLS, "SELECT url, hits FROM u ORDER BY hits DESC, url LIMIT 50")),
    "traffic_segments": (_on_c(W.traffic_segments), _W(CLASSIFIED, f"SELECT class, count(*) AS requests, {_SHARE} FROM r GROUP BY class")),
    "agent_rollup": (_on_c(W.agent_rollup), _W(CLASSIFIED, f"SELECT a.agent, a.class, a.requests, a.unique_urls, a.pct, b.top_status FROM (SELECT agent, any_value(class) AS class, count(*) AS requests, count(DISTINCT url) AS unique_urls, {_SHARE} FROM r GROUP BY agent) a JOIN (SELECT agent, arg_max(status, n * 1000 - status) AS top_status FROM (SELECT agent, status, count(*) AS n FROM r GROUP BY 1, 2) GROUP BY agent) b USING (agent) ORDER BY requests DESC, a.agent LIMIT 30")),
    "status_mix": (_on_c(W.status_mix), _W(CLASSIFIED, f"SELECT status, count(*) AS requests, {_SHARE} FROM r GROUP BY status")),
    "content_mix": (_on_c(W.content_mix), _W(CLASSIFIED, "SELECT content_type, count(*) AS total, count(*) FILTER (automated) AS bot_crawls FROM r GROUP BY content_type")),
    "bot_crawl_detail": (_on_c(W.bot_crawl_detail), _W(CLASSIFIED, f"SELECT url, engine, agent, count(*) AS hits, max(struct_pack(ts := ts, status := status)).status AS last_status, CAST(floor(sum(bytes) / count(*)) AS BIGINT) AS avg_bytes, max(ts) AS last_seen FROM (SELECT *, CASE {' '.join(f'WHEN agent IN {_in(n)} THEN {_q(e)}' for e, n in A.ENGINES.items())} END AS engine FROM r) x WHERE engine IS NOT NULL GROUP BY url, engine, agent")),
    "crawl_trend": (_on_c(W.crawl_trend), _W(CLASSIFIED, "SELECT CAST(ts AS DATE) AS day, count(*) AS total, " + ", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in W.CLASSES) + " FROM r GROUP BY 1")),
    "log_window": (_on_c(W.log_window), _W(CLASSIFIED, "SELECT min(ts) AS first_seen, max(ts) AS last_seen, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 3.6e9, 1) AS span_hours FROM r")),
    "crossref_sitemap": (lambda s, d: W.crossref_sitemap(_classified(s, d), fixtures.view(s, d, "fx_sitemap")), _W(f"{CLASSIFIED}, {fixtures.cte('fx_sitemap')}", "SELECT loc FROM fx_sitemap WHERE regexp_replace(regexp_replace(loc, '^https?://[^/]*', ''), '/+$', '') NOT IN (SELECT regexp_replace(split_part(url, '?', 1), '/+$', '') FROM r)")),
    "redirect_chains": (_both(W.redirect_chains), _W(URLS, "SELECT url, CAST(sum(n) AS BIGINT) AS hits FROM (SELECT trim(referrer) AS ref, url, count(*) AS n FROM r WHERE status = 301 AND trim(referrer) NOT IN ('', '-') GROUP BY 1, 2) x WHERE EXISTS (SELECT 1 FROM u WHERE s301 >= 1 AND contains(x.ref, u.url)) GROUP BY url ORDER BY hits DESC, url LIMIT 10")),
    "trailing_slash_pairs": (_on_u(W.trailing_slash_pairs), _W(URLS, "SELECT a.url, b.url AS other, a.hits + b.hits AS hits, a.segment FROM u a JOIN u b ON ends_with(a.url, '/') AND b.url = left(a.url, length(a.url) - 1) WHERE a.s301 / a.hits <= 0.8 AND b.s301 / b.hits <= 0.8")),
    "suspect_profile": (_on_c(W.suspect_profile), _W(CLASSIFIED, "SELECT i.*, t.top_urls FROM (SELECT ip, count(*) AS hits, min(user_agent) AS user_agent, count(*) FILTER (purpose IN ('content', 'tracked_content')) / count(*) AS content_share, coalesce(try_cast(nullif(regexp_extract(min(user_agent), 'Chrome/(\\d+)\\.', 1), '') AS INT) >= 200, false) AS future_agent FROM r WHERE class = 'suspicious' GROUP BY ip ORDER BY hits DESC, ip LIMIT 10) i JOIN (SELECT ip, string_agg(url, ' | ' ORDER BY k) AS top_urls FROM (SELECT ip, url, row_number() OVER (PARTITION BY ip ORDER BY count(*) DESC, url) AS k FROM r WHERE class = 'suspicious' GROUP BY ip, url) y WHERE k <= 3 GROUP BY ip) t USING (ip)")),
    "issue_404": (_on_u(W.issue_404), None),
    "issue_5xx": (_on_u(W.issue_5xx), None),
    "issue_301": (_on_u(W.issue_301, share=SHARE_301), None),
    "issue_302": (_on_u(W.issue_302), None),
    "issue_redirect_chain": (_both(W.issue_redirect_chain), None),
    "issue_backend_crawl": (_on_u(W.issue_backend_crawl), None),
    "issue_infra_share": (_on_c(W.issue_infra_share, least_pct=INFRA_PCT), None),
    "issue_suspicious_ip": (_on_c(W.issue_suspicious_ip), None),
    "issue_param_explosion": (_on_u(W.issue_param_explosion), None),
    "issue_static_ratio": (_on_c(W.issue_static_ratio, least_pct=STATIC_PCT), None),
    "issue_low_value": (_both(W.issue_low_value), None),
    "issue_robots": (_on_u(W.issue_robots), None),
    "issue_sitemap": (_on_u(W.issue_sitemap), None),
    "issue_trailing_slash": (_on_u(W.issue_trailing_slash), None),
    "issue_oversized_html": (_on_u(W.issue_oversized_html), None),
    "issue_sensitive_file": (_on_u(W.issue_sensitive_file), None),
    "issue_mobile_share": (_on_c(W.issue_mobile_share, below_pct=MOBILE_PCT), None),
    "issue_low_googlebot": (_on_c(W.issue_low_googlebot, below_pct=GOOGLE_PCT), None),
    "finding_order": (lambda s, d: W.finding_order(_findings(s, d)), _W(ALL_FINDINGS, "SELECT * FROM f")),
    "finding_groups": (lambda s, d: W.finding_groups(_findings(s, d)), _W(ALL_FINDINGS, f"SELECT category, issue, count(*) AS findings, CAST(sum(hits) AS BIGINT) AS hits, CASE min({_RANK}) WHEN 0 THEN {P1} WHEN 1 THEN {P2} ELSE {P3} END AS worst_urgency, count(*) FILTER (confidence = 'High') AS high, count(*) FILTER (confidence = 'Medium') AS medium, count(*) FILTER (confidence = 'Low') AS low, string_agg(url, ' | ' ORDER BY k) FILTER (k <= 10) AS top_urls FROM (SELECT *, row_number() OVER (PARTITION BY category, issue ORDER BY hits DESC, url) AS k FROM f) x GROUP BY 1, 2")),
}
_gauge = lambda name, value, a, b, up=False: f"SELECT '{name}' AS gauge, CAST({value} AS DOUBLE) AS value, {a} AS a, {b} AS b, {str(up).lower()} AS up FROM r"
_state = lambda c: f"CASE WHEN count(*) FILTER ({c} AND status >= 400) > 0 THEN 2 WHEN count(*) FILTER ({c} AND status BETWEEN 300 AND 399) > 0 THEN 1 ELSE 0 END"
_HEALTH = " UNION ALL ".join([
    _gauge("404 Error Rate", "count(*) FILTER (status = 404) / count(*) * 100", 1, 5),
    _gauge("301 Redirect Rate", "count(*) FILTER (status = 301) / count(*) * 100", 3, 10),
    _gauge("5xx Error Rate", "count(*) FILTER (status >= 500) / count(*) * 100", 0, 0.5),
    _gauge("Robots.txt", _state("contains(url, '/robots.txt')"), 0, 1),
    _gauge("Sitemap", _state("contains(lower(url), 'sitemap')"), 0, 1),
    _gauge("Googlebot Share", "count(*) FILTER (contains(lower(agent), 'googlebot')) / CASE WHEN count(*) FILTER (class = 'search_bot') >= 20 THEN count(*) FILTER (class = 'search_bot') ELSE greatest(count(*) FILTER (automated), 1) END * 100", 50, 20, True),
    _gauge("Static Crawl Ratio", f"count(*) FILTER (automated AND content_type IN {_STATIC}) / greatest(count(*) FILTER (automated), 1) * 100", 20, 35),
    _gauge("Suspicious Traffic", "count(*) FILTER (class = 'suspicious') / count(*) * 100", 1, 10),
    _gauge("Infra Traffic", "count(*) FILTER (class = 'infra') / count(*) * 100", 10, 30),
    f"SELECT 'P1 Issues', CAST(count(*) FILTER (urgency = {P1}) AS DOUBLE), 0, 2, false FROM f",
])
_TEXTS = ", ".join(f"({', '.join(map(_q, row))})" for row in advice.RULES)
SIMPLE["finding_texts"] = (
    lambda s, d: advice.with_rule_texts(_findings(s, d), advice.rule_texts(s)),
    _W(ALL_FINDINGS, f"SELECT f.*, t.* FROM f LEFT JOIN (VALUES {_TEXTS}) AS t({', '.join(advice.COLUMNS)}) ON f.issue = t.rule OR starts_with(f.issue, t.rule || ': ') OR f.issue LIKE '5__ ' || t.rule"),
)
SIMPLE["health_score"] = (_health, _W(ALL_FINDINGS, f"SELECT gauge, value, CASE WHEN CASE WHEN up THEN value >= a ELSE value <= a END THEN 'Green' WHEN CASE WHEN up THEN value >= b ELSE value <= b END THEN 'Yellow' ELSE 'Red' END AS score FROM ({_HEALTH}) x"))

QUERIES = {name: run for name, (run, _) in SIMPLE.items()}
ORACLE_SQL = {name: sql or _W(URLS, _limits(FINDINGS[name], True)) for name, (_, sql) in SIMPLE.items()}
