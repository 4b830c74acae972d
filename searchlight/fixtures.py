"""Views over the base tables in the shapes of real exports, in SQL that Spark and DuckDB both read.

Base tables stand in braces: Spark gets DataFrames for them, SQL text their names.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "fx_weblog": """
SELECT event_id, ts, user_id, k,
  CASE WHEN user_id % 10 = 0 THEN concat('66.249.', cast(64 + cast(floor(user_id / 256.0) AS int) % 32 AS string), '.', cast(user_id % 256 AS string))
       ELSE concat('10.', cast(user_id % 4 AS string), '.', cast(cast(floor(user_id / 256.0) AS int) % 256 AS string), '.', cast(user_id % 256 AS string)) END AS ip,
  CASE WHEN event_type = 'purchase' THEN 'POST' ELSE 'GET' END AS method,
  CASE WHEN k < 6  THEN '/wp-admin/admin-ajax.php'
       WHEN k < 9  THEN '/.env'
       WHEN k < 12 THEN '/robots.txt'
       WHEN k < 15 THEN '/sitemap.xml'
       WHEN k < 30 THEN concat('/static/app-', cast(k AS string), '.css')
       WHEN k < 45 THEN concat('/shop/?utm_source=s', cast(k AS string))
       WHEN k < 55 THEN concat('/tag/t', cast(k AS string), '/')
       WHEN k < 60 THEN concat('/p/', cast(k AS string))
       WHEN k < 65 THEN concat('/p/', cast(k - 5 AS string), '/')
       ELSE concat('/blog/post-', cast(k AS string), '/') END AS url,
  CASE event_type WHEN 'error' THEN CASE WHEN k % 3 = 0 THEN 500 ELSE 404 END
       WHEN 'signup' THEN CASE WHEN k % 2 = 0 THEN 301 ELSE 302 END ELSE 200 END AS status,
  cast(floor(value * 20000) AS bigint) AS bytes,
  CASE user_id % 10 WHEN 0 THEN 'Mozilla/5.0 (Linux; Android 6.0.1) (compatible; Googlebot/2.1) Mobile'
       WHEN 1 THEN 'Mozilla/5.0 (compatible; bingbot/2.0)' WHEN 2 THEN 'GPTBot/1.1'
       WHEN 3 THEN 'AhrefsBot/7.0' WHEN 4 THEN 'WordPress/6.5; https://shop.example.com'
       WHEN 5 THEN 'Mozilla/5.0 AppleWebKit/537.36 Chrome/201.0.0.0 Safari/537.36'
       WHEN 6 THEN 'curl/8.0' WHEN 7 THEN '-'
       ELSE 'Mozilla/5.0 AppleWebKit/537.36 Chrome/137.0.0.0 Safari/537.36' END AS user_agent,
  CASE WHEN k % 2 = 0 THEN '-' ELSE concat('https://shop.example.com/p/', cast(55 + k % 5 AS string)) END AS referrer
FROM (SELECT *, cast(regexp_extract(props, '[0-9]+', 0) AS int) AS k FROM {events}) e
""",
    "fx_search": """
SELECT concat('https://shop.example.com/', lower(p.p_type), '/', replace(lower(p.p_brand), '#', '-')) AS page,
  p.p_name AS query,
  cast(DATE '2024-01-01' + cast(dayofyear(l.l_shipdate) % 112 AS int) AS date) AS date,
  cast(floor(cast(l.l_quantity AS int) * (11 - cast(round(l.l_discount * 100) AS int)) / 100.0) AS bigint) AS clicks,
  cast(l.l_quantity AS bigint) * 10 AS impressions,
  1.0 + round(l.l_discount * 100) AS position
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey
""",
    "fx_toxic": """
SELECT concat('www.s', cast(s_suppkey AS string), '.example') AS domain, src,
  CASE src WHEN 'dataforseo' THEN (s_suppkey * 37) % 101 WHEN 'ahrefs' THEN (s_suppkey * 53) % 101
           ELSE (s_suppkey * 71) % 101 END AS score
FROM {supplier} CROSS JOIN (SELECT 'dataforseo' AS src UNION ALL SELECT 'ahrefs' UNION ALL SELECT 'semrush') z
""",
    "fx_snapshot": """
SELECT page_id, url, html AS raw_html,
  replace(html, '</article>', concat('<h2>More ', cast(page_id AS string), '</h2><img src="/i/', cast(page_id AS string),
   '.png"><a href="/js/', cast(page_id % 7 AS string), '">js link</a></article>')) AS rendered_html
FROM {pages}
""",
    "fx_keywords": """
SELECT CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END AS keyword,
  cast(p_size * 10 + p_partkey % 7 AS double) AS search_volume,
  cast(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END AS double) AS kd,
  cast(CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_retailprice / 1000 END AS double) AS cpc,
  p_brand AS seed, p_partkey AS ordinal
FROM {part}
""",
    "fx_ranges": """
SELECT * FROM (VALUES (1, 'search_bot', 'Googlebot', '66.249.64.0/19', 1123631104, 1123639295),
                      (2, 'search_bot', 'Google Common Crawler', '66.249.64.0/24', 1123631104, 1123631359),
                      (3, 'seo_tool', 'Ahrefsbot', '10.3.0.0/16', 167968768, 168034303)) t(list_order, class, agent, cidr, lo, hi)
""",
    "fx_sitemap": """
SELECT DISTINCT concat('https://shop.example.com/blog/post-', cast(p_partkey % 120 AS string), '/') AS loc FROM {part}
""",
    "fx_scroll": """
SELECT event_type AS page, depth_pct, count(*) AS visitors
FROM {events} CROSS JOIN (SELECT 5 AS depth_pct UNION ALL SELECT 25 UNION ALL SELECT 50 UNION ALL SELECT 75 UNION ALL SELECT 100) d
WHERE value >= depth_pct / 10.0 GROUP BY event_type, depth_pct
""",
    "fx_clicks": """
SELECT event_type AS page,
  CASE user_id % 6 WHEN 0 THEN 'body>nav.menu>a' WHEN 1 THEN 'main>a.get-a-quote' WHEN 2 THEN 'main>div.card>button'
       WHEN 3 THEN 'footer>a.contact' WHEN 4 THEN 'section>a.book-now' ELSE 'div.contact>span.x' END AS selector, count(*) AS clicks
FROM {events} GROUP BY 1, 2
""",
    "fx_segment": """
SELECT CASE WHEN o_orderdate < TIMESTAMP '1998-04-16' THEN 'baseline' ELSE 'current' END AS period,
  o_orderpriority AS key, count(*) AS clicks, cast(sum(floor(o_totalprice)) AS bigint) AS impressions
FROM {orders} GROUP BY 1, 2
""",
    "fx_topics": """
SELECT p_partkey AS id, p_brand AS entity, p_type AS attribute, p_name AS value,
  CASE p_size % 8 WHEN 0 THEN 'FIXTURE' WHEN 1 THEN 'DRAIN' WHEN 2 THEN 'SERVICE' WHEN 3 THEN 'PROBLEM' WHEN 4 THEN 'ROLE' WHEN 5 THEN 'TOOL' WHEN 6 THEN 'MATERIAL' ELSE 'STANDARD' END AS value_type,
  concat(CASE p_partkey % 14 WHEN 0 THEN 'installation cost of ' WHEN 1 THEN 'why is leaking my ' WHEN 2 THEN 'best ' WHEN 3 THEN 'how to install ' WHEN 4 THEN 'repair ' WHEN 5 THEN 'unclog '
    WHEN 6 THEN 'types of ' WHEN 7 THEN 'license for ' WHEN 8 THEN 'what causes bad ' WHEN 9 THEN 'valve valve ' WHEN 10 THEN 'permit for ' WHEN 11 THEN 'fixture about ' WHEN 12 THEN 'humming ' ELSE 'about ' END,
    p_name, CASE WHEN p_partkey % 17 = 0 THEN ' with Curtain Rod' ELSE '' END) AS keyword,
  CASE WHEN p_partkey % 5 > 0 THEN p_size > 20 END AS volume, p_partkey % 2 = 0 AS different_entity, p_partkey % 3 = 0 AS low_similarity, p_size % 3 > 0 AS pattern,
  CASE p_partkey % 4 WHEN 0 THEN 'dedicated' WHEN 1 THEN 'parent' ELSE 'na' END AS serp_verdict,
  CASE WHEN p_size % 3 = 0 THEN 'Landing' ELSE 'Blog post' END AS page_type
FROM {part}
""",
    "fx_domains": """
SELECT concat('s', cast(s_suppkey AS string), '.example') AS domain, (s_suppkey * 37) % 1000 AS rank, (s_suppkey * 13) % 100 AS spam_score, s_suppkey % 50 AS backlinks FROM {supplier}
""",
    "fx_spam": """
SELECT concat('s', cast(s_suppkey AS string), '.example') AS domain, (s_suppkey * 7) % 100 AS score FROM {supplier} WHERE s_suppkey % 3 = 0
""",
    "fx_reports": """
SELECT concat('/p/', cast(o_orderkey AS string)) AS page,
  CASE WHEN o_orderkey % 11 = 0 THEN 'no report' ELSE concat('{"categories":{"performance":{"score":0.', cast(10 + o_orderkey % 90 AS string), '},"accessibility":{"score":0.', cast(10 + o_orderkey % 83 AS string),
   '},"best-practices":{"score":1},"seo":{"score":', CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '0.5' END, '}},"audits":{"largest-contentful-paint":{"numericValue":', cast(o_orderkey % 5000 AS string),
   '.5},"cumulative-layout-shift":{"numericValue":0.', cast(1000 + o_orderkey % 9000 AS string), '1},"total-blocking-time":{"numericValue":', cast(o_orderkey % 700 AS string), '.25}',
   CASE WHEN o_orderkey % 3 = 0 THEN concat(',"experimental-interaction-to-next-paint":{"numericValue":', cast(o_orderkey % 300 AS string), '}') ELSE '' END, '}}') END AS doc
FROM {orders}
""",
    "fx_listings": """
SELECT c_custkey AS place, CASE c_custkey % 4 WHEN 0 THEN concat('{"title":"Shop ', cast(c_custkey AS string), '","is_claimed":true,"rating":{"value":4.5,"votes_count":', cast(c_custkey % 90 AS string), '},"category":"Plumber"}')
  WHEN 1 THEN concat('{"name":"Shop ', cast(c_custkey AS string), '","is_claimed":false,"rating_value":3.5,"rating_count":', cast(c_custkey % 70 AS string), '}')
  WHEN 2 THEN '{"is_claimed":true}' ELSE 'nothing' END AS doc
FROM {customer}
""",
    "fx_signals": """
SELECT page_id, signal_id, CASE (page_id + length(signal_id)) % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'info' ELSE 'pass' END AS severity,
  (page_id * 3 + length(signal_id)) % 5 > 0 AS matches, length(html) % 900 AS raw_chars, length(html) % 1300 AS rendered_chars
FROM {pages} CROSS JOIN (SELECT 'json_ld' AS signal_id UNION ALL SELECT 'body_text' UNION ALL SELECT 'images' UNION ALL SELECT 'canonical' UNION ALL SELECT 'headings') z
""",
    "fx_solutions": """
SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'images_missing_alt' WHEN 1 THEN 'headings' ELSE 'body_text_js_gated' END AS signal_id, CASE page_id % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'warning' WHEN 2 THEN 'pass' ELSE 'info' END AS severity FROM {pages}
""",
    "fx_access": """
SELECT page_id, page_id % 4 AS blocked_bots, CASE WHEN page_id % 2 = 0 THEN 'present' ELSE 'absent' END AS llms_txt FROM {pages} WHERE page_id % 6 > 0
""",
    "fx_hosts": """
SELECT concat('h', cast(c_custkey AS string), '.example') AS host, c_custkey % 2 = 0 AS specific_cta, c_custkey % 3 = 0 AS phone_present, c_custkey % 10 AS n_ctas, c_custkey % 5 = 0 AS review_stats, c_custkey % 7 = 0 AS testimonials,
  c_custkey % 4 = 0 AS guarantee, c_custkey % 6 = 0 AS badges, c_custkey % 100 AS trust_total, c_custkey % 2 = 1 AS has_form, c_custkey % 8 = 0 AS pricing, c_custkey % 3000 AS avg_words, (c_custkey % 10) / 10.0 AS hero_frac,
  c_custkey % 9 = 0 AS has_sticky, c_custkey % 5 AS service_pages, 1 + c_custkey % 3 AS pages
FROM {customer}
""",
    "fx_ratings": """
SELECT concat('/c/', cast(ps AS string)) AS page, name, CASE WHEN ps % 3 = 0 THEN '4.8' WHEN k % 4 > 0 THEN concat('4.', cast(k % 3 AS string)) END AS rating_value, CASE WHEN ps % 3 = 0 THEN 1247 ELSE k % 2 END AS review_count
FROM (SELECT p_partkey % 40 AS ps, p_partkey AS k, p_name AS name FROM {part}) x
""",
    "fx_outlinks": """
SELECT event_id AS link_id, concat('/p/', cast(user_id % 40 AS string)) AS page,
  CASE event_id % 6 WHEN 0 THEN 'https://www.amazon.com/dp/x' WHEN 1 THEN 'https://amzn.to/abc' WHEN 2 THEN 'https://www.awin1.com/cread' WHEN 3 THEN 'https://old.example/offer' WHEN 4 THEN 'https://en.wikipedia.org/wiki/X' ELSE 'https://blog.example/post' END AS href,
  CASE event_id % 5 WHEN 0 THEN 'sponsored nofollow' WHEN 1 THEN 'NoFollow' WHEN 2 THEN 'noopener' WHEN 3 THEN '' END AS rel,
  cast(CASE event_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 503 WHEN 3 THEN 302 ELSE 200 END AS int) AS status,
  CASE event_id % 20 WHEN 1 THEN 'https://www.amazon.com/ap/signin' WHEN 11 THEN 'https://www.amazon.com/dp/y' WHEN 3 THEN 'https://shop.example/' END AS final_url, cast(event_id % 6 * 10 AS int) AS authority
FROM {events}
""",
    "fx_money_pages": """
SELECT page_id, concat(CASE page_id % 4 WHEN 0 THEN '<p>We may earn a share.</p>' WHEN 1 THEN '' ELSE '<p>Hello.</p>' END, CASE WHEN page_id % 5 > 0 THEN '<a href="https://www.amazon.com/dp/1">buy</a>' ELSE '' END,
  CASE WHEN page_id % 4 = 1 THEN '<p>Contains affiliate links.</p>' ELSE '' END, html) AS html FROM {pages}
""",
    "fx_fields": """
SELECT concat('/f/', cast(o_custkey % 50 AS string)) AS page, cast(o_orderkey % 3 AS int) AS form, CASE WHEN o_orderkey % 9 = 0 THEN 'textarea' ELSE 'input' END AS tag,
  CASE o_orderkey % 5 WHEN 0 THEN 'email' WHEN 1 THEN 'tel' ELSE 'text' END AS kind, CASE o_orderkey % 7 WHEN 0 THEN 'full_name' WHEN 1 THEN 'phone' WHEN 2 THEN 'company' WHEN 3 THEN 'your email' ELSE 'field' END AS name,
  CASE o_orderkey % 4 WHEN 0 THEN 'Your number' WHEN 1 THEN 'How can we help' WHEN 2 THEN '' ELSE 'Other' END AS label, o_orderkey % 3 = 0 AS required
FROM {orders}
""",
    "fx_fetched": """
SELECT url, status, CASE WHEN status IN (301, 302) THEN concat(url, 'new/') END AS location, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN concat(upper(url), '/') WHEN 2 THEN 'https://other.example/' WHEN 3 THEN '' END AS canonical
FROM (SELECT page_id, url, CASE page_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 301 WHEN 2 THEN 302 WHEN 3 THEN NULL ELSE 200 END AS status FROM {pages}) p
""",
    "fx_dense": """
SELECT page, query, date, cast(sum(clicks * f) AS bigint) AS clicks, cast(sum(impressions) AS bigint) AS impressions,
  sum(position * impressions) / sum(impressions) AS position
FROM (SELECT concat('https://shop.example.com/', lower(p.p_type), '/') AS page, p.p_name AS query,
    cast(DATE '2024-01-01' + cast(dayofyear(l.l_shipdate) % 112 AS int) AS date) AS date,
    cast(l.l_quantity AS bigint) AS clicks, cast(l.l_quantity AS bigint) * 10 AS impressions,
    1.0 + round(l.l_discount * 40) + CASE WHEN p.p_type = 'MEDIUM' THEN 18 ELSE 0 END AS position,
    CASE WHEN p.p_type = 'ECONOMY' AND length(p.p_name) % 3 = 0 THEN greatest(0, 8 - cast(floor((dayofyear(l.l_shipdate) % 112) / 7.0) AS int))
         WHEN p.p_type = 'SMALL'   AND length(p.p_name) % 3 = 0 THEN least(8, cast(floor((dayofyear(l.l_shipdate) % 112) / 7.0) AS int))
         WHEN p.p_type = 'MEDIUM' THEN 1 ELSE 4 END AS f
  FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey) x
GROUP BY page, query, date
""",
}


def names_of(sql: str) -> list[str]:
    """The base tables that stand in braces."""
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def made(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The DataFrame of a text with tables in braces; other braces stand for themselves."""
    return spark.sql(re.sub(r"\{\{(\w+)\}\}", r"{\1}", sql.replace("{", "{{").replace("}", "}}")), **tables)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return made(spark, VIEWS[name], {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in names_of(VIEWS[name])})


def cte(*names: str) -> str:
    """The views as common table expressions for another engine, without the leading WITH."""
    return ",\n".join(f"{n} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[n])})" for n in names)
