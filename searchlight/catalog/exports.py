"""Queries of export and log readers over files made from the base tables, with SQL that knows what the files hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlight import fixtures
from searchlight.operators import baseline as B
from searchlight.sources import exports as E
from searchlight.sources import logs as L

_P = "concat('https://x.example/', cast(p_partkey AS string))"
_END = '"' * 3
_N = "cast(p_size * 31 + 1000 AS string)"
#: A file a part: raw rows with keys, flat rows, a comma table with a preamble, a tab table, a pipe table; two rows each.
DUMPS = f"""SELECT concat('f', cast(p_partkey AS string)) AS file, CASE p_partkey % 6
  WHEN 0 THEN concat('{{"rows":[{{"keys":["', {_P}, '","', p_name, '","2024-01-05"],"clicks":', cast(p_size AS string), ',"impressions":', {_N}, ',"ctr":0.5,"position":2.5}},{{"keys":["', {_P}, '","q two","2024-01-06"],"clicks":1,"impressions":2,"ctr":0.5,"position":7}}]}}')
  WHEN 1 THEN concat('{{"dimensions":["query","page"],"data":[{{"keys":["', p_name, '","', {_P}, '"],"clicks":', cast(p_size AS string), ',"impressions":', {_N}, ',"ctr":0.5,"position":2.5}}]}}')
  WHEN 2 THEN concat('[{{"page":"', {_P}, '","query":"', p_name, '","clicks":', cast(p_size AS string), ',"impressions":', {_N}, ',"ctr":0.5,"position":2.5}}]')
  WHEN 3 THEN concat('Some report', chr(10), 'Top pages,Queries,Date,URL clicks,Impr,CTR,Average position', chr(13), chr(10), {_P}, ',"', p_name, ', it says ""x{_END},2024-01-05,', cast(p_size AS string), ',"1,', cast(100 + p_size AS string), '",50%,2.5', chr(10))
  WHEN 4 THEN concat('page', chr(9), 'query', chr(9), 'clicks', chr(9), 'position', chr(10), {_P}, chr(9), p_name, chr(9), cast(p_size AS string), chr(9), 'n/a')
  ELSE concat('Results (2 rows)', chr(10), chr(10), 'page | query | Clicks | Impressions | CTR | Position', chr(10), '-------------', chr(10), {_P}, ' | ', p_name, ' | ', cast(p_size AS string), ' | ', {_N}, ' | 50% | 2.5', chr(10), 'a | b | c | 1 | 2 | 3 | 4') END AS content FROM {{part}}"""
_ROW = "SELECT 'f' || p_partkey AS file, {row} AS row, {page} AS page, {query} AS query, {date} AS date, {clicks}::DOUBLE AS clicks, {impressions}::DOUBLE AS impressions, {ctr}::DOUBLE AS ctr, {position}::DOUBLE AS position FROM part WHERE p_partkey % 6 = {kind}"
_ADDRESS = "'https://x.example/' || p_partkey"
_D = {"row": 0, "page": _ADDRESS, "query": "p_name", "date": "NULL::VARCHAR", "clicks": "p_size", "impressions": "p_size * 31 + 1000", "ctr": 0.5, "position": 2.5}
_KNOWN = [_D | {"kind": 0, "date": "'2024-01-05'"}, _D | {"kind": 0, "row": 1, "query": "'q two'", "date": "'2024-01-06'", "clicks": 1, "impressions": 2, "position": 7}, _D | {"kind": 1}, _D | {"kind": 2}, _D | {"kind": 3, "query": "p_name || ', it says \"x\"'", "date": "'2024-01-05'", "impressions": "1100 + p_size", "ctr": 50}, _D | {"kind": 4, "impressions": 0, "ctr": 0, "position": 0}, _D | {"kind": 5, "ctr": 50}]
PERIODS = "SELECT concat('f', cast(p_brand AS string)) AS file, concat('Country,Clicks,Impressions,Position', chr(10), p_name, ',', cast(p_size AS string), ',', cast(p_partkey % 4 * 10 AS string), ',3.5', chr(10), 'nan,1,2,3', chr(10), ',1,2,3') AS content FROM {part}"
RANGES = """SELECT p_partkey AS list_order, 'search_bot' AS class, concat('Bot ', cast(p_partkey AS string)) AS agent, CASE p_partkey % 5
  WHEN 0 THEN concat('{"prefixes":[{"ipv4Prefix":"10.', cast(p_partkey % 200 AS string), '.17.0/20"},{"ipv6Prefix":"2001:db8::/32"}]}') WHEN 1 THEN concat('{"ips":[{"ip_address":"10.1.2.', cast(p_partkey % 250 AS string), '"},{"ip":"::1"}]}')
  WHEN 2 THEN '["192.0.2.0/24",{"prefix":"198.51.100.0/25"}]' WHEN 3 THEN 'no list' ELSE '{"prefixes":[{"other":1}]}' END AS doc FROM {part}"""
SNAPSHOTS = "SELECT CASE WHEN page_id % 2 = 0 THEN concat('/d/https_x.example_a_', cast(page_id AS string), '.html') ELSE concat('/d/view-source_y.example_', cast(page_id AS string), '.html') END AS file, CASE WHEN page_id % 3 = 0 THEN concat('<!-- crawled: ', url, ' -->', html) WHEN page_id % 3 = 1 THEN replace(replace(html, '<', '&lt;'), '>', '&gt;') ELSE html END AS content FROM {pages}"
BEHAVIOUR = "SELECT concat('b', cast(p_partkey AS string)) AS file, concat('Project,X', chr(10), 'Page,/p/', cast(p_partkey AS string), chr(10), 'Page,/q/', cast(p_partkey AS string), chr(10), chr(10), 'Metric,Scroll', chr(10), chr(10), 'depth,visitors', chr(10), '5,', cast(p_size AS string), chr(10), ',', chr(10), '10,\"1,2\"') AS content FROM {part}"
FPM = "SELECT concat('backend_', cast(event_id % 3 AS string), '.access.log') AS file, concat('Jan  5 10:00:0', cast(event_id % 10 AS string), chr(10), '10.0.0.', cast(event_id % 250 AS string), chr(10), 'GET \"', CASE WHEN event_id % 4 = 0 THEN 'x' ELSE '200' END, ' 0.1\" ', CASE WHEN event_id % 2 = 0 THEN '/p' ELSE 'p' END, cast(event_id % 30 AS string), chr(10), 'noise', chr(10)) AS content, event_id FROM {events}"
LINES = "SELECT concat(CASE event_id % 3 WHEN 0 THEN '/l/access.log' WHEN 1 THEN '/l/php-app.access.log.1' ELSE '/l/site.error.log' END) AS file, event_id, CASE WHEN event_id % 3 = 0 THEN concat('10.0.0.1 - - [05/Jan/2024:10:00:00 +0000] \"GET /p', cast(event_id % 40 AS string), ' HTTP/1.1\" 200 5 \"-\" \"x\"') ELSE concat('host', cast(event_id % 9 AS string), ' says GET /q', cast(event_id % 20 AS string), ' gave ', cast(CASE WHEN event_id % 2 = 0 THEN 404 ELSE 999 END AS string)) END AS value FROM {events}"


def _made(sql):
    tables = fixtures.names_of(sql)
    return lambda s, d: fixtures.made(s, sql, {t: s.read.parquet(f"{d}/{t}.parquet") for t in tables})


_dumps, _periods, _ranges, _snapshots, _behaviour, _fpm, _lines = map(_made, (DUMPS, PERIODS, RANGES, SNAPSHOTS, BEHAVIOUR, FPM, LINES))


def _sources(s, d):
    lines = _lines(s, d)
    parsed = L.parse_combined(lines).withColumn("role", L.log_role(F.col("file")))
    return B.log_sources(parsed, L.primary_roles(lines.select(F.col("file").alias("path")).distinct()))


def _robots(s, d):
    lines = _lines(s, d)
    return L.parse_last_resort(lines.where("event_id % 3 > 0 or event_id % 7 = 0"), L.parse_combined(lines)).select("file", "event_id", "ip", "method", "url", "status")


def _names(s, d):
    """Files called by parts: rotated, packed and other names."""
    p = s.read.parquet(f"{d}/part.parquet")
    ends = F.array(*map(F.lit, ("access.log", "access.log.3", "x_access_log", "a.log.gz", "b.JSONL", "c.tsv.bz2", "photo.png", "notes.md", "site.log-2024", "error_log")))
    return p.select("p_partkey", F.concat(F.lit("/logs/"), F.col("p_brand"), F.lit("/"), F.element_at(ends, (F.col("p_partkey") % 10 + 1).cast("int"))).alias("path"))


ALL = {
    "read_search_dump": (lambda s, d: E.read_search_dump(_dumps(s, d)), " UNION ALL ".join(_ROW.format(**k) for k in _KNOWN)),
    "read_flex_csv": (lambda s, d: E.read_flex_csv(_dumps(s, d).where(~F.col("content").rlike(r"^[\[{]"))), " UNION ALL ".join(_ROW.format(**k) for k in _KNOWN if k["kind"] >= 3)),
    "read_period_export": (lambda s, d: E.read_period_export(_periods(s, d)), "SELECT 'f' || p_brand AS file, p_name AS key, p_size::DOUBLE AS clicks, (p_partkey % 4 * 10)::DOUBLE AS impressions, 3.5::DOUBLE AS position, CASE WHEN p_partkey % 4 > 0 THEN p_size / (p_partkey % 4 * 10) END AS ctr FROM part"),
    "read_ip_ranges": (lambda s, d: E.read_ip_ranges(_ranges(s, d), [("search_bot", "Fallback", "5.45.192.0/18")]).withColumn("list_order", F.col("list_order").cast("bigint")), "WITH r AS (SELECT p_partkey AS k, unnest(CASE p_partkey % 5 WHEN 0 THEN ['10.' || (p_partkey % 200) || '.17.0/20', '2001:db8::/32'] WHEN 1 THEN ['10.1.2.' || (p_partkey % 250) || '/32', '::1/128'] WHEN 2 THEN ['192.0.2.0/24', '198.51.100.0/25'] END) AS cidr FROM part) SELECT k::BIGINT AS list_order, 'search_bot' AS class, 'Bot ' || k AS agent, cidr, CASE WHEN contains(cidr, ':') THEN NULL WHEN k % 5 = 0 THEN 167772160 + (k % 200) * 65536 + 4096 WHEN k % 5 = 1 THEN 167837696 + 512 + k % 250 WHEN starts_with(cidr, '192') THEN 3221225984 ELSE 3325256704 END::BIGINT AS lo, CASE WHEN contains(cidr, ':') THEN NULL WHEN k % 5 = 0 THEN 167772160 + (k % 200) * 65536 + 8191 WHEN k % 5 = 1 THEN 167837696 + 512 + k % 250 WHEN starts_with(cidr, '192') THEN 3221226239 ELSE 3325256831 END::BIGINT AS hi FROM r UNION ALL SELECT 1000000, 'search_bot', 'Fallback', '5.45.192.0/18', 86884352, 86900735"),
    "read_page_snapshots": (lambda s, d: E.read_page_snapshots(_snapshots(s, d)).select("url", F.length("html").alias("n"), F.col("html").startswith("<!DOCTYPE").alias("plain")), "SELECT CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 2 = 0 THEN 'https://x.example/a/' || page_id || '/' ELSE 'https://y.example/' || page_id || '/' END AS url, CASE WHEN page_id % 3 = 1 THEN length(replace(replace(replace(replace(replace(replace(html, '&nbsp;', ' '), '&copy;', 'c'), '&middot;', '.'), '&quot;', '-'), '&#39;', '-'), '&amp;', '&')) ELSE length(html) END::INT AS n, true AS plain FROM pages"),
    "read_behaviour_export": (lambda s, d: E.read_behaviour_export(_behaviour(s, d)).select("file", "metric", F.col("header")["Project"].alias("project"), F.col("header")["Page"].alias("page"), F.array_join("columns", "|").alias("columns"), "row", F.array_join("cells", "|").alias("cells")), "SELECT 'b' || p_partkey AS file, 'Scroll' AS metric, 'X' AS project, '/q/' || p_partkey AS page, 'depth|visitors' AS columns, row, CASE row WHEN 0 THEN '5|' || p_size ELSE '10|1,2' END AS cells FROM part CROSS JOIN (SELECT 0 AS row UNION ALL SELECT 1) r"),
    "parse_fpm3": (lambda s, d: L.parse_fpm3(_fpm(s, d), 2024).where("ok").select("event_id", "ip", "ts", "method", "url", "status"), "SELECT event_id, '10.0.0.' || (event_id % 250) AS ip, TIMESTAMP '2024-01-05 10:00:00' + to_seconds(CAST(event_id % 10 AS INT)) AS ts, 'GET' AS method, '/p' || (event_id % 30) AS url, 200 AS status FROM events WHERE event_id % 4 > 0"),
    "parse_last_resort": (_robots, "SELECT CASE event_id % 3 WHEN 1 THEN '/l/php-app.access.log.1' ELSE '/l/site.error.log' END AS file, event_id, 'host' || (event_id % 9) AS ip, 'GET' AS method, '/q' || (event_id % 20) AS url, 404 AS status FROM events WHERE event_id % 3 > 0 AND event_id % 2 = 0"),
    "log_sources": (_sources, "SELECT role, 1::BIGINT AS files, count(*) FILTER (role = 'access') AS rows, count(DISTINCT CASE WHEN role = 'access' THEN event_id % 40 END) AS unique_urls, role = 'access' AS main FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'access' WHEN 1 THEN 'cloudways_php' ELSE 'error' END AS role FROM events) x GROUP BY 1"),
    "discover_logs": (lambda s, d: _names(s, d).select("p_partkey", L.is_log_name(F.col("path")).alias("is_log")), "SELECT p_partkey, p_partkey % 10 NOT IN (6, 7) AS is_log FROM part"),
    "route_log_roles": (lambda s, d: L.primary_roles(_lines(s, d).select(F.col("file").alias("path")).distinct()), "SELECT * FROM (VALUES ('access', 1::BIGINT, true), ('cloudways_php', 1::BIGINT, false), ('error', 1::BIGINT, false)) t(role, files, main) WHERE EXISTS (SELECT 1 FROM events)"),
    "read_sitemap": (lambda s, d: L.read_sitemap(s.read.parquet(f"{d}/pages.parquet").select(F.concat(F.lit("<urlset><url><LOC> "), "url", F.lit(" </loc></url><url><loc>https://x.example/"), "page_id", F.lit("</loc></url></urlset>")).alias("value"))), "SELECT url AS loc FROM pages UNION ALL SELECT 'https://x.example/' || page_id FROM pages"),
    "read_disavow": (lambda s, d: L.read_disavow(s.read.parquet(f"{d}/supplier.parquet").select(F.expr("case s_suppkey % 4 when 0 then concat('domain:WWW.s', s_suppkey, '.example # bad') when 1 then '# note' when 2 then '' else concat(' domain:s', s_suppkey % 50, '.example') end").alias("value"))), "SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 's' || s_suppkey || '.example' ELSE 's' || (s_suppkey % 50) || '.example' END AS domain FROM supplier WHERE s_suppkey % 4 IN (0, 3)"),
}
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items()}
