"""Queries of keyword planning, baselines and audits over stored reports, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from searchlight import fixtures
from searchlight.catalog.weblog import _q
from searchlight.operators import baseline as B
from searchlight.operators import page_checks as K
from searchlight.operators import planning as P

FOREIGN = ["curtain rod", "valve"]
SUNSET = ["old.example"]
BRAND, TARGETS = ["acme", "shop example"], ["blue widget", "cheap steel pipe"]



def _sql(text, *names):
    return f"WITH {fixtures.cte(*names)} {text}"


def _anchored(s, d):
    return P.keyword_anchor(fixtures.view(s, d, "fx_topics"))


def _decided(s, d):
    return P.qdp_decision(P.noise_flags(_anchored(s, d), FOREIGN))


_PICK = lambda i: "CASE " + " ".join(f"WHEN regexp_matches(lower(keyword), {_q(row[1])}) THEN {_q(row[i])}" for row in P.ANCHORS) + f" ELSE {_q((P.GENERAL[0], '', *P.GENERAL[1:])[i])} END"
ANCHORED = f"SELECT *, {_PICK(0)} AS anchor, {_PICK(2)} AS category, replace({_PICK(3)}, '{{V}}', value) AS title FROM fx_topics"
_IN = lambda names: "(" + ", ".join(_q(n) for n in sorted(names)) + ")"
GATE = " AND ".join(f"NOT (value_type = '{t}' AND anchor NOT IN {_IN(a)})" for t, a in P.ONLY.items()) + " AND " + " AND ".join(f"NOT (value_type = '{t}' AND anchor IN {_IN(a)})" for t, a in P.NEVER.items()) + f" AND (anchor != 'unclog' OR value_type = 'DRAIN') AND (anchor != 'brands' OR value_type IN {_IN(P.BRAND_TYPES)})"
# The SQL engine's patterns have no back references: neighbours are compared as lists of words.
_DOUBLED = lambda c: f"len(list_filter(list_zip(regexp_extract_all(lower({c}), '\\w+'), regexp_extract_all(lower({c}), '\\w+')[2:]), lambda x: x[1] = x[2])) > 0"
_TERM = "list_filter([" + ", ".join(map(_q, FOREIGN)) + "], lambda t: NOT contains(lower(value), t) AND (contains(lower(title), t) OR contains(lower(keyword), t)))[1]"
NOISE = f"SELECT *, CASE WHEN {_DOUBLED('title')} OR {_DOUBLED('keyword')} THEN 'doubled word' WHEN {_TERM} IS NOT NULL THEN 'foreign term: ' || {_TERM} WHEN value_type = 'SERVICE' AND anchor NOT IN {_IN(P.ONLY['SERVICE'])} THEN 'anchor does not fit a service' END AS reason FROM ({ANCHORED}) a"
_SCORE = "coalesce(volume, false)::INT + different_entity::INT + low_similarity::INT + pattern::INT"
DECIDED = f"SELECT *, {_SCORE} AS score, CASE WHEN NOT different_entity AND NOT low_similarity THEN 'variant' WHEN {_SCORE} IN (2, 3) AND serp_verdict = 'dedicated' THEN 'page' WHEN {_SCORE} IN (2, 3) AND serp_verdict = 'parent' THEN 'heading' WHEN {_SCORE} >= 3 THEN 'page' WHEN {_SCORE} = 2 THEN 'heading' ELSE 'dropped' END AS decision, volume IS NULL AS undecided FROM ({NOISE}) n"
_HOST = "regexp_replace(lower(regexp_extract(href, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\\.', '')"
_NETWORK = "CASE " + " ".join(f"WHEN {_HOST} = {_q(h)} OR ends_with({_HOST}, {_q('.' + h)}) THEN {_q(n)}" for h, n in K.NETWORKS) + " END"
_REL = "string_split_regex(lower(coalesce(rel, '')), '\\s+')"
_NUMBER = lambda path: f"TRY_CAST(json_extract_string(j, {_q(path)}) AS DOUBLE)"
_AUDIT = lambda name, places=0: f"round_even({_NUMBER(f'$.audits.{chr(34)}{name}{chr(34)}.numericValue')}, {places})"
_CATEGORY = lambda name: f"CAST(round_even({_NUMBER(f'$.categories.{chr(34)}{name}{chr(34)}.score')} * 100, 0) AS BIGINT)"
_JSON = "CASE WHEN json_valid(doc) THEN doc END AS j"
_RANK = lambda c: f"coalesce(list_position(['pass', 'info', 'warning', 'critical'], {c}), 1)"
_ROLE = "CASE WHEN lower(tag) = 'textarea' THEN 'message' WHEN lower(kind) = 'email' THEN 'email' WHEN lower(kind) = 'tel' THEN 'phone' " + " ".join(f"WHEN regexp_matches(concat_ws(' ', lower(kind), name, label), {_q(p)}) THEN '{r}'" for r, p in B.ROLES) + " ELSE 'other' END"
_CLAMP = lambda x: f"CAST(least(10, greatest(0, {x})) AS INT)"
_PLAIN = lambda c: f"rtrim(regexp_replace(lower({c}), '^https?://(www\\.)?', ''), '/')"
_ANCHOR_TEXT = "CASE p_partkey % 8 WHEN 0 THEN 'Acme pipes' WHEN 1 THEN 'https://acme.example/x' WHEN 2 THEN 'Blue Widget' WHEN 3 THEN 'click here' WHEN 4 THEN 'the best steel around' WHEN 5 THEN 'www.acme.example' WHEN 6 THEN 'acme.example' ELSE p_name END"
_LABELS = "SELECT p_partkey AS id, concat(p_type, ' ', p_brand, ' page') AS label, concat('https://x.example/', lower(p_type), '/') AS url FROM {part}"


def _anchors(s, d):
    rows = s.sql(f"SELECT p_partkey AS id, {_ANCHOR_TEXT} AS anchor FROM {{part}}", part=s.read.parquet(f"{d}/part.parquet"))
    return rows.select("id", P.anchor_class5(F.col("anchor"), BRAND, TARGETS).alias("kind"))


def _labels(s, d):
    return s.sql(_LABELS, part=s.read.parquet(f"{d}/part.parquet")).select("id", B.label_url_mismatch(F.col("label"), F.col("url")).alias("missing"))


def _leakage(s, d):
    m = fixtures.view(s, d, "fx_search")
    m = m.withColumn("clicks", F.when(F.col("query").contains("a"), F.lit(0).cast("bigint")).otherwise(F.col("clicks"))).withColumn("position", F.col("position") / 5)
    return P.brand_leakage(m, F.col("query").rlike("(?i)red|blue|green|steel|small"))


def _reconcile(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    page = F.concat(F.lit("/p/"), (F.col("user_id") % 60).cast("string"))
    return B.attribution_reconcile(e.where("user_id % 7 > 0 and event_type != 'error'").groupBy(page.alias("page")).agg(F.count("*").alias("clicks")), e.where("user_id % 60 > 3").groupBy(page.alias("page")).agg(F.count_if(F.col("event_type") != "purchase").alias("sessions")))


def _reviews(s, d):
    p = s.read.parquet(f"{d}/pages.parquet")
    url = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("https://x.example/reviews/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    types = F.when(F.col("page_id") % 4 == 0, F.array(F.lit("Review"), F.lit("Organization"))).when(F.col("page_id") % 4 == 1, F.array(F.lit("AggregateRating"))).when(F.col("page_id") % 4 == 2, F.array().cast("array<string>"))
    return B.review_schema_check(p.select(url.alias("url"), types.alias("types"), (F.col("page_id") % 5 == 0).alias("has_score")))


ALL = {
    "keyword_anchor": (lambda s, d: _anchored(s, d).select("id", "anchor", "category", "title"), _sql(f"SELECT id, anchor, category, title FROM ({ANCHORED}) a", "fx_topics")),
    "value_type_gate": (lambda s, d: P.value_type_gate(_anchored(s, d)).select("id", "value_type", "anchor"), _sql(f"SELECT id, value_type, anchor FROM ({ANCHORED}) a WHERE {GATE}", "fx_topics")),
    "noise_flags": (lambda s, d: P.noise_flags(_anchored(s, d), FOREIGN).select("id", "reason"), _sql(f"SELECT id, reason FROM ({NOISE}) x", "fx_topics")),
    "qdp_decision": (lambda s, d: _decided(s, d).select("id", "score", "decision", "undecided"), _sql(f"SELECT id, score, decision, undecided FROM ({DECIDED}) x", "fx_topics")),
    "page_plan_counts": (lambda s, d: P.page_plan_counts(_decided(s, d)), _sql(f"SELECT * FROM (SELECT entity, attribute, value, count(*) FILTER (decision = 'page' AND reason IS NULL AND starts_with(lower(page_type), 'blog')) AS blog, count(*) FILTER (decision = 'page' AND reason IS NULL AND NOT starts_with(lower(page_type), 'blog')) AS landing, count(*) FILTER (decision = 'page' AND reason IS NULL) AS total, count(*) FILTER (reason IS NOT NULL) AS noise FROM ({DECIDED}) x GROUP BY 1, 2, 3) y WHERE total + noise > 0", "fx_topics")),
    "anchor_class5": (_anchors, f"SELECT id, CASE WHEN regexp_matches(a, '^(https?://|www\\.)|^[a-z0-9-]+(\\.[a-z0-9-]+)+(/\\S*)?$') THEN 'naked-URL' WHEN regexp_matches(a, '\\b(acme|shop example)\\b') THEN 'branded' WHEN a IN ('blue widget', 'cheap steel pipe') THEN 'exact-match' WHEN a IN {_IN(P.GENERIC_ANCHORS)} OR a = '' THEN 'generic' WHEN regexp_matches(a, '\\b(blue|cheap|pipe|steel|widget)\\b') THEN 'partial-match' ELSE 'generic' END AS kind FROM (SELECT p_partkey AS id, trim(lower({_ANCHOR_TEXT})) AS a FROM part) x"),
    "brand_leakage": (_leakage, _sql("SELECT * FROM (SELECT page, query, CAST(sum(c) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, sum(position / 5 * impressions) / sum(impressions) AS position FROM (SELECT *, CASE WHEN contains(query, 'a') THEN 0 ELSE clicks END AS c FROM fx_search) f WHERE regexp_matches(query, 'red|blue|green|steel|small', 'i') GROUP BY 1, 2) x WHERE position <= 1.5 AND clicks <= 0.01 * impressions", "fx_search")),
    "spam_score_lookup": (lambda s, d: B.spam_score_lookup(fixtures.view(s, d, "fx_domains"), fixtures.view(s, d, "fx_spam")), _sql("SELECT d.domain, rank, CAST(coalesce(score, spam_score) AS DOUBLE) AS spam_score, coalesce(score, spam_score) >= 30 AS spam, backlinks, CASE WHEN rank < 200 THEN 'low' WHEN rank < 500 THEN 'medium' ELSE 'high' END AS band FROM fx_domains d LEFT JOIN fx_spam USING (domain)", "fx_domains", "fx_spam")),
    "backlink_summary": (lambda s, d: B.backlink_summary(B.spam_score_lookup(fixtures.view(s, d, "fx_domains"), fixtures.view(s, d, "fx_spam"))), _sql("SELECT CASE WHEN rank < 200 THEN 'low' WHEN rank < 500 THEN 'medium' ELSE 'high' END AS band, count(*) AS domains, count(*) FILTER (coalesce(score, spam_score) >= 30) AS flagged, CAST(sum(backlinks) AS BIGINT) AS backlinks FROM fx_domains d LEFT JOIN fx_spam USING (domain) GROUP BY 1", "fx_domains", "fx_spam")),
    "lab_metrics": (lambda s, d: B.lab_metrics(fixtures.view(s, d, "fx_reports")), _sql(f"SELECT page, {_CATEGORY('performance')} AS performance, {_CATEGORY('accessibility')} AS accessibility, {_CATEGORY('best-practices')} AS best_practices, {_CATEGORY('seo')} AS seo, {_AUDIT('largest-contentful-paint')} AS lcp_ms, {_AUDIT('cumulative-layout-shift', 3)} AS cls, {_AUDIT('total-blocking-time')} AS tbt_ms, {_AUDIT('speed-index')} AS speed_index_ms, coalesce({_AUDIT('interaction-to-next-paint')}, {_AUDIT('experimental-interaction-to-next-paint')}) AS inp_ms FROM (SELECT page, {_JSON} FROM fx_reports) x", "fx_reports")),
    "listing_status": (lambda s, d: B.listing_status(fixtures.view(s, d, "fx_listings")), _sql(f"SELECT place, coalesce(json_extract_string(j, '$.title'), json_extract_string(j, '$.name'), '') AS name, coalesce(TRY_CAST(json_extract_string(j, '$.is_claimed') AS BOOLEAN), false) AS claimed, coalesce({_NUMBER('$.rating.value')}, {_NUMBER('$.rating_value')}, 0) AS rating, CAST(coalesce({_NUMBER('$.rating.votes_count')}, {_NUMBER('$.rating_count')}, 0) AS BIGINT) AS reviews, coalesce(json_extract_string(j, '$.category'), '') AS category FROM (SELECT place, {_JSON} FROM fx_listings) x", "fx_listings")),
    "severity_merge": (lambda s, d: B.severity_merge(fixtures.view(s, d, "fx_signals"), fixtures.view(s, d, "fx_solutions")).select("page_id", "signal_id", "severity"), _sql(f"SELECT s.page_id, s.signal_id, CASE WHEN w > {_RANK('s.severity')} THEN ['pass', 'info', 'warning', 'critical'][w] ELSE s.severity END AS severity FROM fx_signals s LEFT JOIN (SELECT page_id, regexp_replace(signal_id, '_missing_alt|_js_gated', '') AS signal_id, max({_RANK('severity')}) AS w FROM fx_solutions GROUP BY 1, 2) o USING (page_id, signal_id)", "fx_signals", "fx_solutions")),
    "render_scores": (lambda s, d: B.render_scores(fixtures.view(s, d, "fx_signals"), fixtures.view(s, d, "fx_access")), _sql("SELECT page_id, CAST(greatest(0, 100 - 15 * c - 5 * w) AS BIGINT) AS google_score, CAST(greatest(0, 100 - 20 * coalesce(blocked_bots, 0) - CASE WHEN llms_txt = 'present' THEN 0 ELSE 10 END - CASE WHEN schema_ok > 0 THEN 0 ELSE 10 END) AS BIGINT) AS ai_bot_score, CAST(greatest(0, 100 - floor(gap * 0.5) - 5 * mismatches) AS BIGINT) AS render_gap_score FROM (SELECT page_id, count(*) FILTER (severity = 'critical') AS c, count(*) FILTER (severity = 'warning') AS w, count(*) FILTER (signal_id = 'json_ld' AND severity = 'pass') AS schema_ok, count(*) FILTER (NOT matches) AS mismatches, coalesce(max(greatest(0, (rendered_chars - raw_chars) / rendered_chars * 100)) FILTER (signal_id = 'body_text' AND rendered_chars > 0), 0) AS gap FROM fx_signals GROUP BY 1) s LEFT JOIN fx_access USING (page_id)", "fx_signals", "fx_access")),
    "host_scores": (lambda s, d: B.host_scores(fixtures.view(s, d, "fx_hosts")), _sql(f"SELECT *, round((ui_ux + coverage + page + cta + trust) / 5.0, 1)::DOUBLE AS overall FROM (SELECT host, {_CLAMP('4 + CASE WHEN hero_frac >= 0.5 THEN 2 ELSE 0 END + has_sticky::INT')} AS ui_ux, {_CLAMP('2 + least(6, 2 * service_pages) + CASE WHEN pages > 1 THEN 1 ELSE 0 END')} AS coverage, {_CLAMP('3 + 2 * has_form::INT + 2 * pricing::INT + least(3, avg_words // 700)')} AS page, {_CLAMP('5 + 2 * specific_cta::INT + phone_present::INT - CASE WHEN n_ctas > 6 THEN 2 ELSE 0 END')} AS cta, {_CLAMP('2 + 2 * review_stats::INT + 2 * testimonials::INT + 2 * guarantee::INT + badges::INT + least(1, trust_total // 40)')} AS trust FROM fx_hosts) x", "fx_hosts")),
    "duplicate_ratings": (lambda s, d: B.duplicate_ratings(fixtures.view(s, d, "fx_ratings")), _sql("SELECT page, count(*) AS entities, count(DISTINCT (rating_value, review_count)) AS signatures, CASE WHEN count(*) >= 3 AND count(DISTINCT (rating_value, review_count)) = 1 THEN 'CRITICAL' WHEN count(*) >= 3 THEN 'OK' END AS verdict FROM fx_ratings WHERE rating_value IS NOT NULL GROUP BY 1", "fx_ratings")),
    "attribution_reconcile": (_reconcile, "SELECT *, abs(gap) / nullif(greatest(clicks, sessions), 0) AS gap_share, coalesce(abs(gap) / nullif(greatest(clicks, sessions), 0) > 0.2, false) AS off FROM (SELECT '/p/' || (user_id % 60) AS page, count(*) FILTER (user_id % 7 > 0 AND event_type != 'error') AS clicks, count(*) FILTER (user_id % 60 > 3 AND event_type != 'purchase') AS sessions, count(*) FILTER (user_id % 7 > 0 AND event_type != 'error') - count(*) FILTER (user_id % 60 > 3 AND event_type != 'purchase') AS gap FROM events WHERE (user_id % 7 > 0 AND event_type != 'error') OR user_id % 60 > 3 GROUP BY 1) x"),
    "label_url_mismatch": (_labels, f"SELECT id, nullif(array_to_string(list_filter(string_split_regex(lower(label), '[^a-z0-9]+'), lambda w: length(w) > 3 AND w NOT IN {_IN(B.LABEL_STOP)} AND NOT contains(lower(url), w)), ','), '') AS missing FROM (SELECT p_partkey AS id, concat(p_type, ' ', p_brand, ' page') AS label, concat('https://x.example/', lower(p_type), '/') AS url FROM part) x"),
    "form_role": (lambda s, d: fixtures.view(s, d, "fx_fields").groupBy("tag", "kind", "name", "label", B.form_role(F.col("tag"), F.col("kind"), F.col("name"), F.col("label")).alias("role")).count(), _sql(f"SELECT tag, kind, name, label, {_ROLE} AS role, count(*) AS count FROM fx_fields GROUP BY ALL", "fx_fields")),
    "form_quality": (lambda s, d: B.form_quality(fixtures.view(s, d, "fx_fields")), _sql(f"SELECT page, form, fields, required, roles, concat_ws(';', CASE WHEN fields > 7 THEN 'many fields' END, CASE WHEN unlabelled > 0 THEN 'fields without labels' END, CASE WHEN astext > 0 THEN 'phone as text' END, CASE WHEN required = 0 THEN 'nothing required' END) AS findings FROM (SELECT page, form, count(*) AS fields, count(*) FILTER (required) AS required, array_to_string(list_sort(list_distinct(list(role))), ',') AS roles, count(*) FILTER (label = '') AS unlabelled, count(*) FILTER (role = 'phone' AND kind != 'tel') AS astext, row_number() OVER (PARTITION BY page ORDER BY count(*) DESC, form) AS r FROM (SELECT *, {_ROLE} AS role FROM fx_fields) y GROUP BY 1, 2) z WHERE r = 1", "fx_fields")),
    "link_verdicts": (lambda s, d: B.link_verdicts(fixtures.view(s, d, "fx_outlinks"), SUNSET).select("link_id", "network", "verdict"), _sql(f"SELECT link_id, network, CASE WHEN status >= 400 THEN 'Dead-fix' WHEN old THEN 'Re-point' WHEN status BETWEEN 300 AND 399 AND coalesce(regexp_matches(final_url, '/(login|signin|ap/signin)|^[a-z]+://[^/]+/?$', 'i'), false) THEN 'Dead-fix' WHEN NOT list_contains(rels, 'sponsored') AND NOT list_contains(rels, 'nofollow') THEN 'Add-rel' WHEN status != 200 THEN 'Review-manually' ELSE 'OK' END AS verdict FROM (SELECT *, {_NETWORK} AS network, {_HOST} = 'old.example' AS old, {_REL} AS rels FROM fx_outlinks) x WHERE network IS NOT NULL OR old", "fx_outlinks")),
    "outbound_equity": (lambda s, d: B.outbound_equity(fixtures.view(s, d, "fx_outlinks")), _sql(f"SELECT * FROM (SELECT page, host, count(*) AS links, count(*) FILTER (network IS NOT NULL AND NOT list_contains(rels, 'sponsored')) AS untagged, count(*) FILTER (network IS NULL AND NOT list_contains(rels, 'nofollow') AND NOT list_contains(rels, 'sponsored') AND NOT list_contains(rels, 'ugc')) AS followed, CASE WHEN count(*) FILTER (network IS NOT NULL AND NOT list_contains(rels, 'sponsored')) > 0 THEN 'add sponsored' WHEN count(*) FILTER (network IS NULL AND NOT list_contains(rels, 'nofollow') AND NOT list_contains(rels, 'sponsored') AND NOT list_contains(rels, 'ugc')) >= 3 AND max(authority) < 20 THEN 'equity leak' END AS finding FROM (SELECT *, {_HOST} AS host, {_NETWORK} AS network, {_REL} AS rels FROM fx_outlinks) x GROUP BY 1, 2) y WHERE finding IS NOT NULL", "fx_outlinks")),
    "disclosure_position": (lambda s, d: B.disclosure_position(fixtures.view(s, d, "fx_money_pages")), _sql("SELECT page_id, CASE WHEN link = 0 THEN 'not needed' WHEN note = 0 THEN 'missing' WHEN note < link THEN 'before' ELSE 'after' END AS disclosure FROM (SELECT page_id, instr(html, 'href=\"https://www.amazon.com') AS link, CASE page_id % 4 WHEN 0 THEN instr(html, 'We may earn') WHEN 1 THEN instr(html, 'affiliate links') ELSE 0 END AS note FROM fx_money_pages) x", "fx_money_pages")),
    "review_schema_check": (_reviews, "SELECT * FROM (SELECT u AS url, CASE WHEN r AND page_id % 4 != 0 THEN 'review page without schema' WHEN NOT r AND page_id % 4 = 1 THEN 'rating on another page' WHEN NOT r AND page_id % 5 = 0 THEN 'score on another page' END AS finding FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://x.example/reviews/' || page_id ELSE url END AS u, regexp_matches(CASE WHEN page_id % 3 = 0 THEN 'https://x.example/reviews/' || page_id ELSE url END, '/reviews?/|-review/?$', 'i') AS r FROM pages) x) y WHERE finding IS NOT NULL"),
    "canonical_status": (lambda s, d: B.canonical_status(fixtures.view(s, d, "fx_fetched")), _sql(f"SELECT url, status, CASE WHEN status BETWEEN 300 AND 399 THEN location ELSE nullif(canonical, '') END AS target, CASE WHEN status IS NULL OR status >= 400 THEN 'error' WHEN status >= 300 THEN 'redirected' WHEN coalesce(canonical, '') = '' THEN 'no canonical' WHEN {_PLAIN('canonical')} = {_PLAIN('url')} THEN 'own canonical' ELSE 'consolidated' END AS verdict FROM fx_fetched", "fx_fetched")),
}
QUERIES = {name: run for name, (run, _) in ALL.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in ALL.items()}
