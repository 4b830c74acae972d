"""Web-server log analytics: classification, roll-ups, evidence-gated findings and health gauges.

Requests have the columns ip, ts, method, url, status, bytes, user_agent, referrer. Roll-ups keep one row
a URL, agent, IP or day, so everything after the classification works on small tables.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlight.functions import agents as A
from searchlight.storage import written

# The labels of traffic classes.
CLASS_LABELS = {"search_bot": "Search Bots", "seo_tool": "SEO Tools", "infra": "Infrastructure", "generic_bot": "Generic Bots", "suspicious": "Suspicious", "human": "Human"}
CLASSES = list(CLASS_LABELS)
P1, P2, P3 = "P1 - Critical", "P2 - High", "P3 - Monitor"
# Backend paths and their labels, in order.
BACKEND = [
    ("/wp-admin", "WordPress admin panel"),
    ("/wp-login", "WordPress login page"),
    ("admin-ajax.php", "WordPress AJAX handler"),
    ("/wp-cron.php", "WordPress pseudo-cron (replace with real server cron)"),
    ("/xmlrpc.php", "WordPress XML-RPC : legacy remote API, usually safe to block"),
    ("/wp-json/oembed", "WordPress oEmbed endpoint"),
    ("/wp-json/wp/v2/", "WordPress REST API"),
    ("/administrator", "Joomla admin panel"),
    ("?seraph_accel", "Seraph Accel cache preloader parameter"),
]
LOW_VALUE = ["/tag/", "/author/", "/page/", "/feed/", "/category/page/"]
# Patterns of sensitive files, in order.
SENSITIVE = [
    (".env", r"(/|^)\.env(\.|/|$)"),
    (".bak", r"\.bak(\?|/|$)"),
    (".sql", r"\.sql(\?|/|$|\.gz)"),
    ("wp-config", r"/wp-config(\.php|-sample|\.bak|\.backup)"),
    ("/.git", r"/\.git(/|$)"),
    ("phpinfo", r"/phpinfo\.php|phpinfo\(\)"),
    (".config", r"\.config(\?|/|$)"),
    ("/.svn", r"/\.svn(/|$)"),
    ("/backup", r"/backup(/|s/|\.|$)"),
    ("debug.log", r"/debug\.log(\?|$)"),
]
#: IPs that are broadcast, about 100 bytes each.
MOST_IPS = 100_000
#: Characters of URLs in an automaton, about 40 bytes each in a task's memory.
MOST_CHARS = 4_000_000
FINDING = ["category", "issue", "url", "segment", "status_code", "hits", "urgency", "confidence"]


def with_purpose(requests: DataFrame) -> DataFrame:
    return requests.withColumn("purpose", A.url_purpose(F.col("url"))).withColumn("content_type", A.content_type(F.col("url")))


def ip_number(ip: Column) -> Column:
    """An IPv4 address as a number, or null."""
    parts = F.split(ip, r"\.")
    valid = ip.rlike(r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$")
    return F.when(valid, sum((parts[i].cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0)))


def ip_profile(requests: DataFrame) -> DataFrame:
    """ip, hits, admin_hits, admin_share: how much of an IP's traffic is a logged-in user's."""
    admin = A.url_purpose(F.col("url")).isin(A.ADMIN_LIKE)
    return requests.groupBy("ip").agg(F.count("*").alias("hits"), F.count_if(admin).alias("admin_hits")).withColumn("admin_share", F.col("admin_hits") / F.col("hits"))


def ip6_hex(ip: Column) -> Column:
    """An IPv6 address as 32 hexadecimal digits, or null. A dotted tail is not read."""
    halves = F.split(F.lower(F.trim(ip)), "::")
    groups = lambda text: F.filter(F.split(F.coalesce(text, F.lit("")), ":"), lambda g: g != "")
    left, right = groups(F.try_element_at(halves, F.lit(1))), groups(F.try_element_at(halves, F.lit(2)))
    given = F.size(left) + F.size(right)
    gap = F.when(F.size(halves) == 2, F.greatest(8 - given, F.lit(0))).otherwise(0)
    whole = F.concat(left, F.array_repeat(F.lit("0"), gap), right)
    fits = ip.contains(":") & (F.size(halves) <= 2) & (F.size(whole) == 8) & F.forall(whole, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
    return F.when(fits, F.array_join(F.transform(whole, lambda g: F.lpad(g, 4, "0")), ""))


def hex_prefix(digits: Column, length: Column) -> Column:
    """The first ``length`` bits of hexadecimal digits; of a digit that is cut, the bits within."""
    whole, rest = F.floor(length / 4).cast("int"), length % 4
    digit = F.conv(F.substring(digits, whole + 1, F.lit(1)), 16, 10).cast("int")
    cut = F.hex(F.floor(digit / F.pow(F.lit(2), 4 - rest)).cast("int"))
    return F.when(rest == 0, F.substring(digits, F.lit(1), whole)).otherwise(F.concat(F.substring(digits, F.lit(1), whole), F.lit("."), cut))


def verify_bot_ip(ips: DataFrame, ranges: DataFrame) -> DataFrame:
    """ip, verified_class, verified_agent for IPs within a published range; of several, the first in list order.

    IPv4 ranges are dealt out to the blocks of 65 536 addresses they touch. IPv6 networks are read from ``cidr``, where ranges
    have it, and meet an address by their length and prefix: an address is looked up once for each length (129 at most) that
    occurs in the list. So both range joins are equi-joins.
    """
    cut = ranges.select("*", F.explode(F.sequence(F.shiftright("lo", 16), F.shiftright("hi", 16))).alias("block"))
    distinct = ips.select("ip").distinct()
    at = distinct.withColumn("n", ip_number(F.col("ip"))).where("n is not null").withColumn("block", F.shiftright("n", 16))
    found = at.join(cut, "block").where("n between lo and hi").select("ip", "list_order", "class", "agent")
    if "cidr" in ranges.columns:
        length = F.substring_index("cidr", "/", -1).try_cast("int")
        six = ranges.where(F.col("cidr").contains(":")).select("list_order", "class", "agent", length.alias("length"), hex_prefix(ip6_hex(F.substring_index("cidr", "/", 1)), length).alias("prefix"))
        lengths = [r.length for r in six.where("length between 0 and 128").select("length").distinct().collect()]
        if lengths:
            digits = distinct.where(F.col("ip").contains(":")).select("ip", ip6_hex(F.col("ip")).alias("digits")).where("digits is not null")
            tried = digits.select("ip", "digits", F.explode(F.array(*map(F.lit, lengths))).alias("length")).select("ip", "length", hex_prefix(F.col("digits"), F.col("length")).alias("prefix"))
            found = found.unionByName(tried.join(six, ["length", "prefix"]).select("ip", "list_order", "class", "agent"))
    first = found.groupBy("ip").agg(F.min_by(F.struct("class", "agent"), "list_order").alias("r"))
    return first.select("ip", F.col("r.class").alias("verified_class"), F.concat("r.agent", F.lit(" (verified IP)")).alias("verified_agent"))


def classify(ua: Column, hits: Column, total: Column, admin_share: Column, verified_class: Column, verified_agent: Column) -> Column:
    """struct(class, agent, automated) of a request; the first rule that applies decides."""
    crawler, infra, generic = A.named_crawler(ua), A.infra_agent(ua), A.generic_bot(ua)
    share = hits / F.greatest(total, F.lit(1))
    row = lambda c, a, auto: F.struct((F.lit(c) if isinstance(c, str) else c).alias("class"), (F.lit(a) if isinstance(a, str) else a).alias("agent"), F.lit(auto).alias("automated"))
    spoofed = F.when(share > 0.10, "Mass Scraper (impossible UA)").otherwise("Suspicious UA (Chrome 200+, not yet released)")
    heavy = F.concat(F.lit("High-volume IP, content-dominated ("), hits.cast("string"), F.lit(" hits)"))
    return A.first_of(
        [
            (verified_agent.isNotNull(), row(verified_class, verified_agent, True)),
            (generic == "No User-Agent", row("generic_bot", generic, True)),
            (crawler.isNotNull(), row(A.crawler_class(crawler), crawler, True)),
            (infra.isNotNull(), row("infra", infra, True)),
            (generic.isNotNull(), row("generic_bot", generic, True)),
            (admin_share > 0.5, row("human", "Logged-in Admin / Session", False)),
            (ua.rlike(A.FUTURE_CHROME), row("suspicious", spoofed, True)),
            ((hits > 500) & (share > 0.10) & (admin_share < 0.3), row("suspicious", heavy, True)),
        ],
        row("human", "Human", False),
    )


def classify_requests(requests: DataFrame, ranges: DataFrame) -> DataFrame:
    """requests with purpose, content_type, class, agent, automated and verified.

    One aggregate by IP comes first and is written; the requests are read once for it and once for the verdicts. A rule looks at an IP only if it is verified, mostly a logged-in user's or has over a
    tenth of all requests. Up to ``MOST_IPS`` of such IPs are broadcast, so no request is shuffled; more are joined, and
    Spark's skew join splits a heavy IP's rows.
    """
    profile = written(ip_profile(requests).withColumnRenamed("hits", "ip_hits"))
    total = profile.agg(F.sum("ip_hits")).first()[0] or 0
    known = profile.join(verify_bot_ip(profile, ranges), "ip", "left").where(F.col("verified_agent").isNotNull() | (F.col("admin_share") > 0.5) | (F.col("ip_hits") > 0.10 * total))
    known = known.select("ip", "ip_hits", "admin_share", "verified_class", "verified_agent")
    rows = known.limit(MOST_IPS + 1).collect()
    if len(rows) <= MOST_IPS:
        known = F.broadcast(requests.sparkSession.createDataFrame(rows, known.schema))
    joined = with_purpose(requests).join(known, "ip", "left")
    none = lambda c: F.coalesce(c, F.lit(0))
    verdict = classify(F.coalesce("user_agent", F.lit("")), none("ip_hits"), F.lit(total), none("admin_share"), F.col("verified_class"), F.col("verified_agent"))
    return joined.withColumn("verdict", verdict).select("*", "verdict.class", "verdict.agent", "verdict.automated", F.col("verified_agent").isNotNull().alias("verified")).drop("verdict", "ip_hits", "admin_share", "verified_class", "verified_agent")


def is_googlebot(agent: Column) -> Column:
    return F.lower(agent).contains("googlebot")


def top_label(classes: list[Column]) -> Column:
    """The label of the class with the most hits, of equal ones the first in the order of CLASSES."""
    most = F.greatest(*classes)
    return A.first_of([(c == most, CLASS_LABELS[name]) for name, c in zip(CLASSES, classes)])


def url_rollup(classified: DataFrame) -> DataFrame:
    """One row a URL: hits, hits by status and by class, bytes, last status and time. The last request is the latest; of equal times the one with the highest status."""
    status = {f"s{c}": F.count_if(F.col("status") == c) for c in (200, 206, 301, 302, 403, 404, 500, 502, 503, 504)}
    google = {f"g{c}": F.count_if((F.col("status") == c) & is_googlebot(F.col("agent"))) for c in (404, 500, 502, 503, 504)}
    by_class = {c: F.count_if(F.col("class") == c) for c in CLASSES}
    rolled = classified.groupBy("url").agg(
        F.count("*").alias("hits"),
        F.sum("bytes").alias("bytes"),
        F.max(F.struct("ts", "status")).alias("last"),
        F.first("purpose").alias("purpose"),
        F.first("content_type").alias("content_type"),
        F.count_if("verified").alias("verified_hits"),
        *[v.alias(k) for k, v in {**status, **google, **by_class}.items()],
    )
    return rolled.select("*", F.col("last.status").alias("last_status"), F.col("last.ts").alias("last_seen"), top_label([F.col(c) for c in CLASSES]).alias("segment")).drop("last")


def share_of_all(df: DataFrame, count: str = "requests") -> Column:
    """The percentage of all counts of a roll-up, which is best written before."""
    return F.round(F.col(count) / df.agg(F.sum(count)).scalar() * 100, 2)


def traffic_segments(classified: DataFrame) -> DataFrame:
    return _with_share(classified.groupBy("class").agg(F.count("*").alias("requests")))


def _with_share(df: DataFrame) -> DataFrame:
    df = written(df)
    return df.withColumn("pct", share_of_all(df))


def agent_rollup(classified: DataFrame, top: int = 30) -> DataFrame:
    """Requests, share, distinct URLs and most frequent status of the most frequent agents."""
    per = classified.groupBy("agent", "status", "url").agg(F.count("*").alias("n"), F.first("class").alias("class"))
    by_status = per.groupBy("agent", "status").agg(F.sum("n").alias("n"), F.first("class").alias("class"))
    agents = by_status.groupBy("agent").agg(F.first("class").alias("class"), F.sum("n").alias("requests"), F.max_by("status", F.struct("n", -F.col("status"))).alias("top_status"))
    urls = per.groupBy("agent", "url").agg(F.sum("n").alias("n")).groupBy("agent").agg(F.count("url").alias("unique_urls"))
    return _with_share(agents).join(urls, "agent").select("agent", "class", "requests", "unique_urls", "pct", "top_status").orderBy(F.desc("requests"), "agent").limit(top)


def status_mix(classified: DataFrame) -> DataFrame:
    return _with_share(classified.groupBy("status").agg(F.count("*").alias("requests")))


def content_mix(classified: DataFrame) -> DataFrame:
    return classified.groupBy("content_type").agg(F.count("*").alias("total"), F.count_if("automated").alias("bot_crawls"))


def bot_crawl_detail(classified: DataFrame) -> DataFrame:
    """Per URL, engine and crawler: hits, last status, mean bytes, last seen."""
    found = classified.withColumn("engine", A.engine(F.col("agent"))).where("engine is not null")
    rolled = found.groupBy("url", "engine", "agent").agg(F.count("*").alias("hits"), F.max(F.struct("ts", "status")).alias("last"), F.floor(F.sum("bytes") / F.count("*")).alias("avg_bytes"))
    return rolled.select("url", "engine", "agent", "hits", F.col("last.status").alias("last_status"), "avg_bytes", F.col("last.ts").alias("last_seen"))


def crawl_trend(classified: DataFrame) -> DataFrame:
    """Requests a day and class, one column a class."""
    by = [F.count_if(F.col("class") == c).alias(c) for c in CLASSES]
    return classified.where("ts is not null").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("total"), *by)


def log_window(classified: DataFrame) -> DataFrame:
    span = (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3.6e9
    return classified.agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.round(span, 1).alias("span_hours"))


def crossref_sitemap(classified: DataFrame, sitemap: DataFrame) -> DataFrame:
    """Sitemap URLs whose path was never requested."""
    path = lambda c: F.coalesce(F.nullif(F.rtrim(A.url_path(c), F.lit("/")), F.lit("")), F.lit("/"))
    crawled = classified.select(path(F.col("url")).alias("path")).distinct()
    return sitemap.withColumn("path", path(F.col("loc"))).join(crawled, "path", "left_anti").select("loc")


def crossref_search(classified: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages (url, impressions) with impressions whose path was never requested."""
    return crossref_sitemap(classified, pages.where("impressions > 0").withColumnRenamed("url", "loc")).join(pages.withColumnRenamed("url", "loc"), "loc").select(F.col("loc").alias("url"), "impressions")


def finding(df: DataFrame, category: str, issue: Column | str, urgency: Column | str, confidence: Column | str, *, url: Column | str = "url", segment: Column | str = "segment", status: Column | str = "", hits: Column | str = "hits") -> DataFrame:
    lit = lambda v: F.lit(v) if isinstance(v, str) else v
    col = lambda v: F.col(v) if isinstance(v, str) else v
    return df.select(F.lit(category).alias("category"), lit(issue).alias("issue"), col(url).alias("url"), col(segment).alias("segment"), lit(status).cast("string").alias("status_code"), col(hits).cast("bigint").alias("hits"), lit(urgency).alias("urgency"), lit(confidence).alias("confidence"))


def issue_404(urls: DataFrame, least: int = 3) -> DataFrame:
    n, g = F.col("s404"), F.col("g404")
    found = urls.where(((n >= least) | (g >= 1)) & (F.col("purpose") != "scanner_probe"))
    urgency = F.when(g >= 5, P1).when((g >= 1) | (n >= 10), P2).otherwise(P3)
    return finding(found, "HTTP Errors", "404 Not Found", urgency, F.when((g >= 1) | (n >= 10), "High").otherwise("Medium"), status="404", hits=n)


def issue_5xx(urls: DataFrame) -> DataFrame:
    """Server errors by URL and code; one that a search crawler met counts at any volume."""
    codes = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"s{c}").alias("n"), F.col(f"g{c}").alias("g")) for c in (500, 502, 503, 504)]))
    rows = urls.select("url", "segment", "verified_hits", F.col("hits").alias("all"), codes.alias("e")).select("url", "segment", "verified_hits", "all", "e.code", "e.n", "e.g")
    n, g, share = F.col("n"), F.col("g"), F.col("n") / F.greatest("all", F.lit(1))
    found = rows.where((n > 0) & ((n >= 10) | (share >= 0.05) | (g >= 1)))
    urgency = F.when(g >= 3, P1).when(g >= 1, P2).when((n >= 10) & (share >= 0.10), P1).otherwise(P2)
    confidence = F.when((g >= 1) | ((n >= 10) & (share >= 0.05)), "High").otherwise("Medium")
    return finding(found, "HTTP Errors", F.concat(F.col("code").cast("string"), F.lit(" Server Error")), urgency, confidence, status=F.col("code"), hits=n)


def issue_301(urls: DataFrame, least: int = 5, share: float = 0.5) -> DataFrame:
    n = F.col("s301")
    found = urls.where((n >= least) & (n / F.greatest("hits", F.lit(1)) >= share))
    return finding(found, "Redirects", "301 Redirect Still Being Crawled", F.when(n >= 50, P1).when(n >= 20, P2).otherwise(P3), F.when(n >= 20, "High").otherwise("Medium"), status="301", hits=n)


def issue_302(urls: DataFrame, least: int = 3) -> DataFrame:
    n = F.col("s302")
    found = urls.where((n >= least) & F.col("purpose").isin("content", "tracked_content"))
    return finding(found, "Redirects", "302 Temporary Redirect", P2, F.when(n >= 10, "High").otherwise("Medium"), status="302", hits=n)


def naming(texts: DataFrame, names: DataFrame, most_chars: int = MOST_CHARS) -> DataFrame:
    """The rows of texts (one string column) that contain any of names (one string column).

    An automaton of all names reads a text once, whatever their number. Names go to the tasks in blocks of about ``most_chars``
    characters; each block is a pass over the texts, which don't move.
    """
    column, name = texts.columns[0], names.columns[0]
    names = names.where(F.col(name) != "").distinct()
    blocks = 1 + (names.agg(F.sum(F.length(name))).first()[0] or 0) // most_chars
    sc = texts.sparkSession.sparkContext

    def run(held):
        def found(batches):
            from ahocorasick import Automaton

            automaton = Automaton()
            for word in held.value:
                automaton.add_word(word, 0)
            automaton.make_automaton()
            for batch in batches:
                yield batch.filter(pa.array([text is not None and next(automaton.iter(text), None) is not None for text in batch.column(0).to_pylist()], pa.bool_()))

        return found

    parts = []
    for block in range(blocks):
        own = [r[0] for r in names.where(F.pmod(F.xxhash64(name), F.lit(blocks)) == block).collect()]
        if own:
            parts.append(texts.mapInArrow(run(sc.broadcast(own)), texts.schema))
    return reduce(DataFrame.unionByName, parts).distinct() if parts else texts.limit(0)


def redirect_chains(classified: DataFrame, urls: DataFrame, least_coverage: float = 0.2, top: int = 10, exact: bool = False, most_chars: int = MOST_CHARS) -> DataFrame:
    """301 answers whose referrer names a URL that itself answers 301: url, hits, coverage.

    By default a referrer names a URL that it contains anywhere, which ``naming`` finds in one pass over the distinct
    referrers; exact compares paths by an equi-join.
    """
    given = F.trim("referrer").isNotNull() & ~F.trim("referrer").isin("", "-")
    coverage = classified.agg((F.count_if(given) / F.greatest(F.count("*"), F.lit(1))).alias("c")).scalar()
    hops = classified.where(given & (F.col("status") == 301)).groupBy(F.trim("referrer").alias("referrer"), "url").agg(F.count("*").alias("n"))
    sources = urls.where("s301 >= 1 and url != ''").select(F.col("url").alias("source"))
    if exact:
        chained = hops.withColumn("path", A.url_path(F.col("referrer"))).join(sources.withColumn("path", A.url_path(F.col("source"))), "path", "left_semi")
    else:
        chained = hops.join(naming(hops.select("referrer").distinct(), sources, most_chars), "referrer", "left_semi")
    return chained.where(coverage >= least_coverage).groupBy("url").agg(F.sum("n").alias("hits")).orderBy(F.desc("hits"), "url").limit(top)


def issue_redirect_chain(classified: DataFrame, urls: DataFrame) -> DataFrame:
    found = redirect_chains(classified, urls).join(urls.select("url", "segment"), "url")
    return finding(found, "Redirects", "Redirect Chain Detected", P2, F.when(F.col("hits") >= 10, "High").otherwise("Medium"), status="301 > 301")


def issue_backend_crawl(urls: DataFrame, least: int = 3) -> DataFrame:
    label = A.first_of([(F.lower("url").contains(key.lower()), name) for key, name in BACKEND])
    found = urls.withColumn("label", label).where(F.col("label").isNotNull() & (F.col("search_bot") >= least))
    return finding(found, "Crawl Budget", F.concat(F.lit("Backend URL Crawled: "), "label"), P1, "High", segment=F.lit("Bots"), status=F.col("last_status"))


def issue_infra_share(classified: DataFrame, least_pct: float = 15, high_pct: float = 20) -> DataFrame:
    total = classified.agg(F.count("*")).scalar()
    found = classified.where("class = 'infra'").groupBy("agent").agg(F.count("*").alias("hits")).withColumn("pct", F.col("hits") / total * 100).where(F.col("pct") > least_pct)
    return finding(found, "Crawl Budget", F.concat(F.lit("High Internal Traffic: "), "agent"), F.when(F.col("pct") > high_pct, P2).otherwise(P3), "High", url=F.lit("Multiple"), segment=F.lit("Infrastructure"))


def suspect_profile(classified: DataFrame, top: int = 10) -> DataFrame:
    """The suspicious IPs with the most hits: ip, hits, agent, content_share, future_agent, top_urls (three)."""
    bad = classified.where("class = 'suspicious'")
    per_url = bad.groupBy("ip", "url").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("ip").orderBy(F.desc("n"), "url"))
    best = per_url.withColumn("r", rank).where("r <= 3").groupBy("ip").agg(F.array_sort(F.collect_list(F.struct("r", "url"))).alias("u"))
    ips = bad.groupBy("ip").agg(F.count("*").alias("hits"), F.min("user_agent").alias("user_agent"), (F.count_if(F.col("purpose").isin("content", "tracked_content")) / F.count("*")).alias("content_share"))
    ips = ips.orderBy(F.desc("hits"), "ip").limit(top)
    future = F.coalesce(A.chrome_version(F.col("user_agent")) >= 200, F.lit(False))
    return ips.join(best, "ip").select("ip", "hits", "user_agent", "content_share", future.alias("future_agent"), F.array_join("u.url", " | ").alias("top_urls"))


def issue_suspicious_ip(classified: DataFrame) -> DataFrame:
    total = classified.agg(F.count("*")).scalar()
    found = suspect_profile(classified).withColumn("pct", F.col("hits") / total * 100)
    confidence = F.when(F.col("future_agent") & (F.col("content_share") > 0.5), "High").when(F.col("content_share") > 0.3, "Medium").otherwise("Low")
    urgency = F.when(confidence == "High", F.when(F.col("pct") > 20, P1).otherwise(P2)).when(confidence == "Medium", P2).otherwise(P3)
    return finding(found, "Security / Spam", "Suspicious High-Volume IP", urgency, confidence, url="ip", segment=F.lit("Suspicious"))


def issue_param_explosion(urls: DataFrame) -> DataFrame:
    """Base URLs with many parameter variants, or several tracking variants."""
    rows = urls.where(F.col("url").contains("?") & ~F.col("purpose").isin("admin_polling", "admin_ui", "scanner_probe", "static_asset"))
    base, query = F.substring_index("url", "?", 1), F.expr("substring(url, instr(url, '?'))")
    rolled = rows.groupBy(base.alias("url")).agg(F.count("*").alias("variants"), F.count_if(query.rlike("(?i)" + A.TRACKING)).alias("tracking"), F.sum("hits").alias("hits"))
    rolled = written(rolled)
    found = rolled.withColumn("all", rolled.agg(F.sum("variants")).scalar()).where((F.col("all") > 5) & ((F.col("variants") >= 20) | (F.col("tracking") >= 5)))
    return finding(found, "Crawl Budget", "URL Parameter Explosion", P2, F.when((F.col("variants") >= 50) | (F.col("tracking") >= 20), "High").otherwise("Medium"), segment=F.lit("All"))


def issue_static_ratio(classified: DataFrame, least_pct: float = 30) -> DataFrame:
    one = classified.agg(F.count_if("automated").alias("automated"), F.count_if(F.col("automated") & F.col("content_type").isin(A.STATIC_TYPES)).alias("hits"))
    pct = F.col("hits") / F.greatest("automated", F.lit(1)) * 100
    found = one.withColumn("pct", pct).where((F.col("automated") > 50) & (F.col("pct") > least_pct))
    return finding(found, "Crawl Budget", "High Static Asset Crawl Ratio", F.when(F.col("pct") > 35, P2).otherwise(P3), F.when(F.col("pct") > 40, "High").otherwise("Medium"), url=F.lit("Static assets"), segment=F.lit("Bots"))


def issue_low_value(classified: DataFrame, urls: DataFrame, bots_only: bool = False) -> DataFrame:
    """Taxonomy pages that take over a tenth of automated traffic; by default visits of all count, as in the usual report."""
    automated = classified.agg(F.count_if("automated")).scalar()
    hit = sum((F.lower("url").contains(p).cast("int") for p in LOW_VALUE), F.lit(0)) > 0
    hits = F.sum(F.col("hits") - F.col("human")) if bots_only else F.sum("hits")
    one = urls.where(hit).agg(F.count("*").alias("n"), hits.alias("hits"))
    found = one.where((F.col("n") > 5) & (F.col("hits") / F.greatest(automated, F.lit(1)) * 100 > 10))
    return finding(found, "Crawl Budget", "Low-Value Taxonomy Pages Over-Crawled", P2, "Medium", url=F.lit("Multiple"), segment=F.lit("All"))


def _file_errors(urls: DataFrame, issue: str, critical: bool) -> DataFrame:
    codes = F.filter(F.array(*[F.when(F.col(f"s{c}") > 0, F.lit(c)) for c in (404, 500, 502, 503)]), lambda c: c.isNotNull())
    bad = (F.col("s404") + F.col("s500") + F.col("s502") + F.col("s503")) / F.greatest("hits", F.lit(1))
    server = (F.col("s500") + F.col("s502") + F.col("s503")) > 0
    found = urls.where((bad > 0) & ((bad >= 0.10) | server))
    text = F.concat(F.lit("["), F.array_join(codes, ", "), F.lit("]"))
    return finding(found, "Indexability", issue, F.when(server, P1).otherwise(P2) if critical else P2, F.when((bad >= 0.5) | server, "High").otherwise("Medium"), status=text)


def issue_robots(urls: DataFrame) -> DataFrame:
    return _file_errors(urls.where(F.col("url").contains("/robots.txt")), "robots.txt Returning Error", True)


def issue_sitemap(urls: DataFrame) -> DataFrame:
    return _file_errors(urls.where(F.lower("url").contains("sitemap")), "Sitemap Returning Error", False)


def trailing_slash_pairs(urls: DataFrame, redirected: float = 0.8) -> DataFrame:
    """URLs that answer with and without a final slash where neither mostly redirects: url, other, hits."""
    moved = lambda t: F.col(f"{t}.s301") / F.greatest(f"{t}.hits", F.lit(1)) > redirected
    a = urls.where(F.col("url").endswith("/")).withColumn("bare", F.expr("left(url, length(url) - 1)")).alias("a")
    b = urls.alias("b")
    found = a.join(b, F.col("a.bare") == F.col("b.url")).where(~moved("a") & ~moved("b"))
    return found.select(F.col("a.url").alias("url"), F.col("b.url").alias("other"), (F.col("a.hits") + F.col("b.hits")).alias("hits"), F.col("a.segment").alias("segment"))


def issue_trailing_slash(urls: DataFrame) -> DataFrame:
    return finding(trailing_slash_pairs(urls), "Indexability", "Trailing Slash Duplicate URLs", P2, "High")


def issue_oversized_html(urls: DataFrame, least_bytes: int = 750_000, top: int = 10) -> DataFrame:
    mean = F.col("bytes") / F.greatest("hits", F.lit(1))
    found = urls.where((F.col("content_type") == "HTML") & (mean > least_bytes)).withColumn("mean", mean).orderBy(F.desc("mean"), "url").limit(top)
    return finding(found, "Performance", "Oversized HTML Page", P3, F.when(F.floor(F.col("mean") / 1024) > 1500, "High").otherwise("Medium"), status=F.col("last_status"))


def issue_sensitive_file(urls: DataFrame) -> DataFrame:
    kind = A.first_of([(F.col("url").rlike("(?i)" + pattern), name) for name, pattern in SENSITIVE])
    exposed = (F.col("s200") + F.col("s206")) > 0
    found = urls.withColumn("kind", kind).where("kind is not null")
    return finding(found, "Security", F.concat(F.lit("Sensitive File: "), "kind"), F.when(exposed, P1).otherwise(P3), F.when(exposed | (F.col("s403") + F.col("s404") >= 5), "High").otherwise("Medium"), status=F.col("last_status"))


def google_totals(classified: DataFrame) -> DataFrame:
    """One row: total, automated, search_bot, google, google_mobile, span_hours."""
    g = is_googlebot(F.col("agent"))
    mobile = F.col("user_agent").rlike("Mobile|Android|Smartphone")
    return classified.agg(F.count("*").alias("total"), F.count_if("automated").alias("automated"), F.count_if(F.col("class") == "search_bot").alias("search_bot"), F.count_if(g).alias("google"), F.count_if(g & mobile).alias("google_mobile"), ((F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))) / 3.6e9).alias("span_hours"))


def issue_mobile_share(classified: DataFrame, below_pct: float = 50) -> DataFrame:
    pct = F.col("google_mobile") / F.greatest("google", F.lit(1)) * 100
    found = google_totals(classified).where((F.col("google") >= 50) & (pct < below_pct))
    return finding(found, "Indexability", "Googlebot Mobile-First Imbalance", F.when(pct < 30, P2).otherwise(P3), F.when(F.col("google") >= 200, "High").otherwise("Medium"), url=F.lit("Site-wide"), segment=F.lit("Search Bots"), hits="google")


def issue_low_googlebot(classified: DataFrame, below_pct: float = 10) -> DataFrame:
    base = F.when(F.col("search_bot") >= 20, F.col("search_bot")).when(F.col("automated") > 50, F.col("automated"))
    pct = F.col("google") / F.col("base") * 100
    found = google_totals(classified).withColumn("base", base).where(F.col("base").isNotNull() & (pct < below_pct))
    short = F.coalesce(F.col("span_hours") < 48, F.lit(False))
    urgency = F.when(short, P3).when(pct < 2, P1).otherwise(P2)
    return finding(found, "Indexability", "Low Googlebot Activity", urgency, F.when(short, "Low").otherwise("High"), url=F.lit("Site-wide"), segment=F.lit("Search Bots"), hits="google")


def all_findings(classified: DataFrame, urls: DataFrame) -> DataFrame:
    parts = [issue_404(urls), issue_5xx(urls), issue_301(urls), issue_302(urls), issue_redirect_chain(classified, urls), issue_backend_crawl(urls), issue_infra_share(classified), issue_suspicious_ip(classified), issue_param_explosion(urls), issue_static_ratio(classified), issue_low_value(classified, urls), issue_robots(urls), issue_sitemap(urls), issue_trailing_slash(urls), issue_oversized_html(urls), issue_sensitive_file(urls), issue_mobile_share(classified), issue_low_googlebot(classified)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def urgency_rank(urgency: Column) -> Column:
    return F.when(urgency == P1, 0).when(urgency == P2, 1).when(urgency == P3, 2).otherwise(3)


def finding_order(findings: DataFrame) -> DataFrame:
    return findings.orderBy(urgency_rank(F.col("urgency")), F.desc("hits"), "category", "issue", "url")


def finding_groups(findings: DataFrame) -> DataFrame:
    """Per category and issue: findings, hits, worst urgency, findings by confidence, and the ten URLs with the most hits.

    Each task keeps ten rows a group before the shuffle, as the rank is bounded.
    """
    rank = F.row_number().over(Window.partitionBy("category", "issue").orderBy(F.desc("hits"), "url"))
    best = findings.select("category", "issue", "url", "hits").withColumn("r", rank).where("r <= 10")
    best = best.groupBy("category", "issue").agg(F.array_sort(F.collect_list(F.struct("r", "url"))).alias("t"))
    worst = F.min(urgency_rank(F.col("urgency")))
    grouped = findings.groupBy("category", "issue").agg(F.count("*").alias("findings"), F.sum("hits").alias("hits"), worst.alias("w"), *[F.count_if(F.col("confidence") == c).alias(c.lower()) for c in ("High", "Medium", "Low")])
    grouped = grouped.join(best, ["category", "issue"])
    return grouped.select("category", "issue", "findings", "hits", F.element_at(F.array(*map(F.lit, (P1, P2, P3))), F.col("w") + 1).alias("worst_urgency"), "high", "medium", "low", F.array_join("t.url", " | ").alias("top_urls"))


def health_score(classified: DataFrame, findings: DataFrame) -> DataFrame:
    """Ten gauges: gauge, value, score (Green, Yellow or Red). Percentages are rounded to one decimal place only in reports."""
    share = lambda c: F.count_if(c) / F.count("*") * 100
    automated = F.greatest(F.count_if("automated"), F.lit(1))
    search = F.count_if(F.col("class") == "search_bot")
    state = lambda c: F.when(F.count_if(c & (F.col("status") >= 400)) > 0, 2.0).when(F.count_if(c & F.col("status").between(300, 399)) > 0, 1.0).otherwise(0.0)
    gauges = {
        "404 Error Rate": (share(F.col("status") == 404), 1, 5),
        "301 Redirect Rate": (share(F.col("status") == 301), 3, 10),
        "5xx Error Rate": (share(F.col("status") >= 500), 0, 0.5),
        "Robots.txt": (state(F.col("url").contains("/robots.txt")), 0, 1),
        "Sitemap": (state(F.lower("url").contains("sitemap")), 0, 1),
        "Googlebot Share": (F.count_if(is_googlebot(F.col("agent"))) / F.when(search >= 20, search).otherwise(automated) * 100, 50, 20),
        "Static Crawl Ratio": (F.count_if(F.col("automated") & F.col("content_type").isin(A.STATIC_TYPES)) / automated * 100, 20, 35),
        "Suspicious Traffic": (share(F.col("class") == "suspicious"), 1, 10),
        "Infra Traffic": (share(F.col("class") == "infra"), 10, 30),
    }
    one = classified.agg(*[v.cast("double").alias(k) for k, (v, _, _) in gauges.items()]).withColumn("P1 Issues", findings.agg(F.count_if(F.col("urgency") == P1).cast("double")).scalar())
    limits = {k: (a, b) for k, (_, a, b) in gauges.items()} | {"P1 Issues": (0, 2)}
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("gauge"), F.col(f"`{k}`").alias("value"), F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for k, (a, b) in limits.items()]))
    up = F.col("gauge") == "Googlebot Share"
    green = F.when(up, F.col("value") >= F.col("a")).otherwise(F.col("value") <= F.col("a"))
    yellow = F.when(up, F.col("value") >= F.col("b")).otherwise(F.col("value") <= F.col("b"))
    return one.select(rows.alias("g")).select("g.*").select("gauge", "value", F.when(green, "Green").when(yellow, "Yellow").otherwise("Red").alias("score"))
