"""Queries of page checks, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlight import fixtures
from searchlight.catalog import pages as CP
from searchlight.operators import page_audit as Q
from searchlight.operators import page_checks as K

_p = lambda f: lambda s, d: f(s.read.parquet(f"{d}/pages.parquet"))
_TEXT = f"trim(regexp_replace({CP._DECODE}, '\\s+', ' ', 'g'))"
_HOST = "regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#:].*$', ''), '^www\\.', '')"
_LEN = lambda tag: f"coalesce(list_sum(list_transform(regexp_extract_all(html, '<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1, 'is'), lambda x: length(x))), 0)::INT"
_COUNT = lambda pattern: f"len(regexp_extract_all(html, '{pattern}', 0, 'i'))::INT"
_WORDS = lambda t: f"len(list_filter(string_split({t}, ' '), lambda w: w <> ''))::INT"
#: Pages with a different set of files, pictures, trackers and structured data on each.
LOADED = """SELECT page_id, url, concat(CASE WHEN page_id % 2 = 0 THEN '<link href="a.css" rel="preload stylesheet"><LINK rel=stylesheet href=b.css>' ELSE '<link rel="icon" href="i">' END, repeat('<script async src="https://x/gtag/js?id=1"></script>', cast(page_id % 3 AS int)), CASE WHEN page_id % 5 = 0 THEN '<script>load("fbevents.js")</script>' ELSE '' END,
  repeat('<svg><path d=""/></svg>', cast(page_id % 4 AS int)), CASE WHEN page_id % 7 = 0 THEN '<script type="application/ld+json">{"@type":"Thing"}</script>' ELSE '' END, CASE WHEN page_id % 6 = 0 THEN '<meta content="about &amp; more" name="description">' ELSE '' END, html) AS html FROM {pages}"""
_LOADED = LOADED.replace("{pages}", "pages")
WEIGHT = f"SELECT page_id, strlen(html)::INT AS bytes, {_LEN('style')} AS inline_css, {_LEN('script')} AS inline_js, {_COUNT('<script\\b')} AS scripts, {_COUNT('<style\\b')} AS styles, (CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END + {_COUNT('<link[^>]*stylesheet')} - CASE WHEN page_id % 2 = 0 THEN 2 ELSE 0 END)::INT AS external_css, {_COUNT('<script[^>]*src=')} AS external_js, {_COUNT('<svg')} AS svg, len(string_split(html, 'gtag/js')) + len(string_split(html, 'fbevents.js')) + len(string_split(html, 'swap.js')) - 3 AS trackers, {_COUNT('<[a-z]')} AS tags, {_COUNT('<form\\b')} AS forms, length(trim(regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '\\s+', ' ', 'g')))::INT AS title_chars, length(regexp_extract(regexp_extract(html, '(<meta[^>]*name=\"description\"[^>]*>)', 1, 'i'), 'content=\"([^\"]*)\"', 1, 'i'))::INT AS meta_chars, {_COUNT('application/ld\\+json')} AS schema_blocks, {_WORDS(_TEXT)} AS words FROM ({_LOADED}) pages"
LINKS = f"SELECT page_id, host, pos - 1 AS position, href FROM (SELECT page_id, {_HOST} AS host, unnest(h) AS href, unnest(range(1, len(h) + 1)) AS pos FROM (SELECT page_id, url, regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*\"([^\"]*)\"', 1, 'is') AS h FROM pages) x) y"
#: Pages with what asks for a conversion, a different part of it on each.
OFFERS = """SELECT page_id, CASE WHEN page_id % 6 = 0 THEN replace(url, '/fr/', '/services/') ELSE url END AS url, concat(CASE WHEN page_id % 3 = 0 THEN '<section style="background-image: url(x)"><p>Hi</p></section>' ELSE '' END,
  CASE page_id % 7 WHEN 0 THEN '<a href="tel:1">Get a <b>free</b> quote</a>' WHEN 1 THEN '<button class="sticky-bar">Contact us</button>' WHEN 2 THEN '<a href="/x">Book a call today, we wait for you and all your friends</a>' WHEN 3 THEN '<a href="/y">Sign up</a> <a href="/y">Sign up</a>' WHEN 4 THEN '<a href="/z">Request</a><button>Start now</button>' ELSE '<a href="/c">Claim it</a>' END,
  CASE page_id % 5 WHEN 0 THEN '<p>Rated 4.8 / 5 by 1200+ verified reviews, money back.</p>' WHEN 1 THEN '<p>Our plans: $9 / month. Trusted by clients, 20 years in trade.</p>' WHEN 2 THEN '<form><p>x</p><input></form>' WHEN 3 THEN '<p>Case studies and a free guide. Call 555-123-4567</p>' ELSE '<p>Gold partner, 30 five-star</p>' END, html) AS html FROM {pages}"""
_ASKS = " || ".join(f"regexp_extract_all(html, '<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1, 'is')" for tag in ("a", "button"))
_HAS = lambda c, p: f"regexp_matches({c}, {CP.CW._q(p)}, 'is')"
FEATURES = f"""SELECT page_id, {_HOST} AS host, {_WORDS('t')} AS words, list_filter(list_transform({_ASKS}, lambda c: trim(regexp_replace(regexp_replace(c, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))), lambda c: regexp_matches(c, {CP.CW._q(K.CTA)}, 'i') AND length(c) < 40) AS ctas, {_HAS('t', K.SPECIFIC_CTA)} AS specific_cta,
list_transform(regexp_extract_all(t, {CP.CW._q(K.REVIEW_STAT)}, 0, 'i'), lambda x: trim(x)) AS review_stats, len(regexp_extract_all(t, {CP.CW._q(K.TRUST)}, 0, 'i'))::INT AS trust, {', '.join(f'{_HAS("t", p)} AS {n}' for n, p in K.IN_TEXT.items())}, contains(html, 'href="tel:') OR {_HAS('t', K.PHONE)} AS phone, {_HAS('url', K.SERVICE_URL)} AS service_page, {_HAS('html', K.FORM)} AS has_form, {_HAS('html', K.STICKY)} AS has_sticky, {_HAS('html', K.HERO)} AS hero FROM (SELECT *, {_TEXT} AS t FROM ({OFFERS.replace('{pages}', 'pages')}) o) x"""
_LISTED = "page_id, host, words, array_to_string(ctas, '|') AS ctas, specific_cta, array_to_string(review_stats, '|') AS review_stats, trust, guarantee, pricing, lead_magnet, badges, testimonials, phone, service_page, has_form, has_sticky, hero"
PROFILE = f"""WITH f AS ({FEATURES}), c AS (SELECT host, list(c ORDER BY n DESC, c)[1:8] AS top_ctas FROM (SELECT host, c, count(*) AS n FROM (SELECT host, unnest(ctas) AS c FROM f) u GROUP BY 1, 2) v GROUP BY host),
r AS (SELECT host, list_sort(list(DISTINCT x))[1:6] AS review_counts FROM (SELECT host, unnest(review_stats) AS x FROM f) u GROUP BY host)
SELECT host, count(*) AS pages, count(*) FILTER (service_page) AS service_pages, round(count(*) FILTER (hero) / count(*), 2) AS hero_frac, floor(avg(words))::BIGINT AS avg_words, CAST(sum(trust) AS BIGINT) AS trust_total, bool_or(specific_cta) AS specific_cta, {', '.join(f'bool_or({n}) AS {n}' for n in K.IN_TEXT)}, bool_or(has_form) AS has_form, bool_or(has_sticky) AS has_sticky, bool_or(phone) AS phone_present, coalesce(any_value(top_ctas), []) AS top_ctas, coalesce(any_value(review_counts), []) AS review_counts FROM f LEFT JOIN c USING (host) LEFT JOIN r USING (host) GROUP BY host"""


def _features(s, d):
    return K.conversion_features(fixtures.made(s, OFFERS, {"pages": s.read.parquet(f"{d}/pages.parquet")}))


def _profile(s, d):
    return K.host_profile(_features(s, d))


#: Pages with landmarks, pagers, filters and an organisation, a different part of them on each.
AUDITED = """SELECT page_id, url, concat(CASE page_id % 4 WHEN 0 THEN '<main>x</main>' WHEN 1 THEN '<main>a<MAIN>b</MAIN></main>' WHEN 2 THEN '<main>a</main><main>b</main>' ELSE '' END,
  CASE page_id % 5 WHEN 0 THEN '<div class="pager"><button data-page="2">2</button></div>' WHEN 1 THEN '<ul id="pagination"><li><a href="/2">2</a></li></ul>' ELSE '' END, CASE WHEN page_id % 6 = 0 THEN '<input type="checkbox" data-tax="c">' ELSE '' END,
  CASE page_id % 7 WHEN 0 THEN '<script type="application/ld+json">{"@graph":[{"@type":"WebSite"},{"@type":["Thing","LocalBusiness"],"name":"X","sameAs":["a"],"aggregateRating":{"ratingValue":"5.0"}}]}</script>' WHEN 1 THEN '<script type="application/ld+json">{"@type":"Organization","logo":"l","founders":[{"name":"f"}],"address":{"a":1},"telephone":"1","aggregateRating":{"ratingValue":4}}</script>'
   WHEN 2 THEN '<script type="application/ld+json">[{"@type":"OnlineStore","name":"Y"}]</script><script type="application/ld+json">broken</script>' WHEN 3 THEN '<script type="application/ld+json">{"@type":"Product"}</script>' ELSE '' END,
  CASE WHEN page_id % 8 = 0 THEN '<a href="/about-us">us</a> Since 1999' ELSE '' END, CASE page_id % 3 WHEN 0 THEN replace(replace(html, '<h1>', '<h6>'), '</h1>', '</h6>') WHEN 1 THEN replace(html, '<h1>', '<h1>Hi</h1><h1>') ELSE html END) AS html FROM {pages}"""
_AUDIT = AUDITED.replace("{pages}", "pages")
_BODY = lambda tag: f"trim(regexp_replace(regexp_replace(regexp_extract(html, '<{tag}\\b[^>]*>(.*?)</{tag}\\s*>', 1, 'is'), '<[^>]*>', '', 'g'), '\\s+', ' ', 'g'))"
_LETTERS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z]+'))"
CHECKS = f"""WITH x AS (SELECT page_id, {_BODY('title')} AS title, {_BODY('h1')} AS h1 FROM ({_AUDIT}) a), y AS (SELECT page_id, 'pagination' AS "check", CASE page_id % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'OK' ELSE 'LOW' END AS severity FROM pages UNION ALL SELECT page_id, 'landmarks', CASE page_id % 4 WHEN 0 THEN 'OK' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END FROM pages
UNION ALL SELECT page_id, 'title', CASE WHEN title = '' THEN 'MEDIUM' END FROM x UNION ALL SELECT page_id, 'heading', CASE WHEN h1 = '' THEN 'HIGH' WHEN title <> '' AND length(h1) < 25 AND len(list_filter({_LETTERS('title')}, lambda w: NOT list_contains({_LETTERS('h1')}, w))) >= 2 THEN 'MEDIUM' WHEN title <> '' THEN 'OK' END FROM x UNION ALL SELECT page_id, 'filters', 'LOW' FROM pages WHERE page_id % 6 = 0) SELECT * FROM y WHERE severity IS NOT NULL"""
ENTITY = "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 1 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 1 ELSE 0 END::INT AS blocks, page_id % 7 <= 2 AS has_organisation, page_id % 7 IN (0, 2) AS name, page_id % 7 = 0 AS same_as, page_id % 7 = 1 AS logo, page_id % 7 = 1 AS founder, page_id % 7 = 1 AS address, page_id % 7 = 1 AS telephone, page_id % 7 = 0 AS perfect_rating, page_id % 8 = 0 OR regexp_matches(html, 'href=[\"''][^\"'']*about', 'i') AS about_link, page_id % 8 = 0 OR regexp_matches(html, '\\b(founded|established|since)\\b\\s*\\d{4}', 'i') AS founded FROM pages"
_TEMPLATES = "SELECT page_id, page_id % 9 AS grp, concat('<div>head</div>', chr(10), '<p>', cast(page_id % 3 AS string), '</p>', chr(10), '<p>same</p>', chr(10), 'own ', cast(CASE WHEN page_id % 4 = 0 THEN 0 ELSE page_id END AS string), chr(10), CASE WHEN page_id % 5 = 0 THEN 'more\nand more\nand even more' ELSE '' END) AS html FROM {pages}"
TEMPLATE = f"WITH t AS ({_TEMPLATES.replace('{pages}', 'pages')}), l AS (SELECT page_id, grp, list_distinct(list_filter(list_transform(string_split(html, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS x FROM t) SELECT * FROM (SELECT a.page_id AS a, b.page_id AS b, len(list_intersect(a.x, b.x))::BIGINT AS common, 2 * len(list_intersect(a.x, b.x)) / (len(a.x) + len(b.x)) AS similarity, CASE WHEN 2 * len(list_intersect(a.x, b.x)) / (len(a.x) + len(b.x)) > 0.85 THEN 'very high' ELSE 'substantial' END AS label FROM l a JOIN l b ON a.grp = b.grp AND a.page_id < b.page_id) p WHERE similarity > 0.5"


def _made(sql):
    return lambda s, d: fixtures.made(s, sql, {"pages": s.read.parquet(f"{d}/pages.parquet")})


_audited, _templates, _loaded = _made(AUDITED), _made(_TEMPLATES), _made(LOADED)


def _outbound(s, d):
    """The pages' own links, moved to a shop."""
    pages = s.read.parquet(f"{d}/pages.parquet").withColumn("html", F.replace("html", F.lit('href="/'), F.lit('href="https://amzn.to/')))
    return K.outbound_links(K.page_links(pages)).select("page_id", "href", K.link_network(F.col("target")).alias("network"))


ALL = {
    "page_weight": (lambda s, d: K.page_weight(_loaded(s, d)), WEIGHT),
    "page_weight_flags": (lambda s, d: K.page_weight_flags(K.page_weight(_loaded(s, d))), f"SELECT page_id, concat_ws(';', CASE WHEN inline_css > 30000 THEN 'inline css' END, CASE WHEN tags > 1400 THEN 'many nodes' END, CASE WHEN trackers > 1 THEN 'trackers' END, CASE WHEN forms = 0 THEN 'no form' END, CASE WHEN title_chars > 60 THEN 'long title' END, CASE WHEN schema_blocks = 0 THEN 'no schema' END) AS flags FROM ({WEIGHT}) w"),
    "page_links": (_p(lambda p: K.page_links(p).withColumn("position", F.col("position").cast("bigint"))), LINKS),
    "outbound_links": (_outbound, f"SELECT page_id, 'https://amzn.to/' || substring(href, 2) AS href, 'Amazon' AS network FROM ({LINKS}) l"),
    "link_targets": (_p(lambda p: K.link_targets(K.page_links(p))), f"SELECT href, count(DISTINCT page_id) AS pages, count(*) AS places FROM ({LINKS}) l WHERE NOT regexp_matches(href, '^(https?:)?//', 'i') GROUP BY href"),
    "conversion_features": (lambda s, d: _features(s, d).withColumns({c: F.array_join(c, "|") for c in ("ctas", "review_stats")}), f"SELECT {_LISTED} FROM ({FEATURES}) f"),
    "host_profile": (lambda s, d: _profile(s, d).drop("n_ctas", "review_stats").withColumns({c: F.array_join(c, "|") for c in ("top_ctas", "review_counts")}), f"SELECT * REPLACE (array_to_string(top_ctas, '|') AS top_ctas, array_to_string(review_counts, '|') AS review_counts) FROM ({PROFILE}) p"),
    "conversion_findings": (lambda s, d: K.conversion_findings(_profile(s, d)), f"SELECT host, 'many calls to action without a clear one' AS finding FROM ({PROFILE}) p WHERE len(top_ctas) > 4 AND NOT specific_cta UNION ALL SELECT host, 'no review figure' FROM ({PROFILE}) p WHERE len(review_counts) = 0"),
    "page_audit": (lambda s, d: Q.page_audit(_audited(s, d)), CHECKS),
    "entity_signals": (lambda s, d: Q.entity_signals(_audited(s, d)), ENTITY),
    "template_similarity": (lambda s, d: Q.template_similarity(_templates(s, d), "grp"), TEMPLATE),
    "template_candidates": (lambda s, d: Q.template_similarity(_templates(s, d), "grp", least=0.85, bands=32), f"SELECT * FROM ({TEMPLATE}) t WHERE similarity > 0.85"),
    "priority_weighting": (lambda s, d: K.priority_weighting(s.read.parquet(f"{d}/pages.parquet").selectExpr("page_id", "url", "concat('i', page_id % 3) AS issue", "concat('P', 1 + page_id % 3, ' - x') AS urgency"), s.read.parquet(f"{d}/pages.parquet").where("page_id % 4 > 0").selectExpr("page_id", "page_id % 9 AS clicks", "cast(page_id % 25 as double) AS position"), "page_id"), "SELECT url, 'i' || (page_id % 3) AS issue, CAST((3 - page_id % 3) * greatest(CASE WHEN page_id % 4 > 0 THEN page_id % 9 ELSE 0 END, 1) * CASE WHEN page_id % 4 > 0 AND page_id % 25 BETWEEN 11 AND 20 THEN 2 ELSE 1 END AS BIGINT) AS weight FROM pages"),
}
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items() if sql}
