"""Who sent a request, and what it asked for: ordered first-match rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names and keywords of crawlers, in the order in which they are tried.
NAMED_CRAWLERS = [
    ("Googlebot Smartphone", ["googlebot", "mobile"]),
    ("Googlebot Desktop", ["googlebot"]),
    ("Googlebot Image", ["googlebot-image"]),
    ("Googlebot Video", ["googlebot-video"]),
    ("GoogleOther Image", ["googleother-image"]),
    ("GoogleOther Video", ["googleother-video"]),
    ("GoogleOther", ["googleother"]),
    ("Google StoreBot", ["storebot-google"]),
    ("AdsBot Google Mobile", ["adsbot-google-mobile"]),
    ("AdsBot Google", ["adsbot-google"]),
    ("Google Inspectiontool", ["google-inspectiontool"]),
    ("APIs Google", ["apis-google"]),
    ("Mediapartners Google", ["mediapartners-google"]),
    ("Google Safety", ["google-safety"]),
    ("Bingbot", ["bingbot"]),
    ("Bingbot", ["msnbot"]),
    ("Bingbot", ["bingpreview"]),
    ("Yandexbot", ["yandexbot"]),
    ("Baiduspider", ["baiduspider"]),
    ("DuckDuckBot", ["duckduckbot"]),
    ("Applebot", ["applebot"]),
    ("OAI-SearchBot", ["oai-searchbot"]),
    ("GPTBot", ["gptbot"]),
    ("ChatGPT-User", ["chatgpt-user"]),
    ("PerplexityBot", ["perplexitybot"]),
    ("ClaudeBot", ["claudebot"]),
    ("Claude-User", ["claude-user"]),
    ("Amazonbot", ["amazonbot"]),
    ("Meta AI", ["meta-externalagent"]),
    ("Bytespider", ["bytespider"]),
    ("Semrushbot", ["semrushbot"]),
    ("Ahrefsbot", ["ahrefsbot"]),
    ("Moz", ["rogerbot"]),
    ("Screaming Frog", ["screaming frog"]),
    ("Majestic", ["mj12bot"]),
    ("Deepcrawl", ["deepcrawl"]),
    ("Sitebulb", ["sitebulb"]),
]
# Crawler names by class; all others are search bots.
SEO_TOOLS = ["Semrushbot", "Ahrefsbot", "Moz", "Screaming Frog", "Majestic", "Deepcrawl", "Sitebulb"]
AI_FETCHERS = ["GPTBot", "ChatGPT-User", "PerplexityBot", "ClaudeBot", "Claude-User", "Amazonbot", "Meta AI", "Bytespider"]
# Substrings of infrastructure agents; those in the second list are sought in lower case.
INFRA = [
    ("WordPress Self-Ping", ["WordPress/"], []),
    ("WP Cache Preloader", ["seraph-accel"], ["wp-rocket", "wp_rocket"]),
    ("Hotjar Analytics", ["Hotjar"], []),
    ("Cleantalk", ["Cleantalk"], []),
    ("StatusCake Monitor", ["StatusCake"], []),
    ("Uptime Robot", ["UptimeRobot"], []),
    ("Pingdom", ["Pingdom"], []),
    ("GTmetrix", ["GTmetrix"], []),
    ("Datadog Synthetics", ["Datadog"], []),
    ("Generic Monitoring", [], ["monitor", "healthcheck", "health-check", "pingcheck"]),
]
# Substrings of generic bots.
BOT_SIGNALS = ["bot", "crawl", "spider", "scrape", "fetch", "check", "scan", "validator", "indexer", "harvest", "wget", "curl", "python-requests", "go-http-client", "axios", "libwww", "java/", "okhttp", "httpx"]
# Patterns of a URL's purpose, in the order in which they are tried.
PURPOSES = [
    ("admin_polling", r"/wp-admin/admin-ajax\.php|/wp-cron\.php|seraph_accel|wc-analytics/imports|wc-admin/options|heartbeat"),
    ("admin_ui", r"/wp-admin/(load-scripts|load-styles|edit\.php|post(-new|)\.php|admin\.php|options-|themes\.php|plugins\.php|users\.php|tools\.php|profile\.php|upload\.php|index\.php)"),
    ("rest_api", r"/wp-json/"),
    ("service_worker", r"(service-worker|[-/]sw[-.]|/sw\.js|superpwa-sw|onesignal)"),
    ("account_area", r"/(my-account|account|customer|checkout|cart|login|logout|signin|signup|register)/?"),
    ("scanner_probe", r"/\.env|/\.git|/wp-config|/phpinfo|/\.DS_Store|/backup|debug\.log|/\.svn|/wp-login\.php|/xmlrpc\.php|/(adminer|phpmyadmin|mysql)"),
    ("static_asset", r"\.(css|js|jpg|jpeg|png|gif|webp|svg|ico|woff2?|ttf|eot|map)(\?|$)"),
    ("feed_or_sitemap", r"(/feed/?|/rss|sitemap[^/]*\.xml|sitemap_index)"),
    ("robots", r"/robots\.txt$"),
]
# Fixed value.
TRACKING = r"(?:^|[?&])(utm_[a-z]+|fbclid|gclid|msclkid|mc_cid|mc_eid|yclid|_ga|_gl)="
# Fixed value.
ADMIN_LIKE = ["admin_polling", "admin_ui", "rest_api", "service_worker"]
# Fixed value.
FUTURE_CHROME = r"Chrome/([2-9]\d{2}|\d{4,})\."
# Content types by file extension.
EXTENSIONS = {
    "HTML": ["html", "htm", "php", "asp", "aspx"],
    "CSS": ["css"],
    "JavaScript": ["js"],
    "Image": ["jpg", "jpeg", "png", "gif", "webp", "ico"],
    "SVG": ["svg"],
    "Font": ["woff", "woff2", "ttf", "eot"],
    "PDF": ["pdf"],
    "XML": ["xml"],
    "JSON": ["json"],
    "Text": ["txt"],
}
STATIC_TYPES = ["CSS", "JavaScript", "Font", "Image", "SVG"]
# Search engines by crawler name.
ENGINES = {
    "Google": ["Googlebot Smartphone", "Googlebot Desktop", "Googlebot Image", "Googlebot Video", "GoogleOther", "GoogleOther Image", "GoogleOther Video", "Google StoreBot", "AdsBot Google", "AdsBot Google Mobile", "Google Inspectiontool", "APIs Google", "Mediapartners Google", "Google Safety", "Googlebot (verified IP)", "Google Common Crawler (verified IP)", "Google Special Crawler (verified IP)", "Google User Fetcher (verified IP)"],
    "Bing": ["Bingbot", "Bingbot (verified IP)"],
    "Yandex": ["Yandexbot", "Yandexbot (verified IP)"],
    "Baidu": ["Baiduspider"],
    "DuckDuckGo": ["DuckDuckBot", "DuckDuckBot (verified IP)"],
    "Apple": ["Applebot", "Applebot (verified IP)"],
    "OpenAI Search": ["OAI-SearchBot", "OAI-SearchBot (verified IP)"],
}


def first_of(cases: list[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    """The value of the first condition that holds."""
    out = None
    for condition, value in cases:
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(F.lit(otherwise) if isinstance(otherwise, str) else otherwise)


def url_purpose(url: Column) -> Column:
    """A URL's functional purpose; 'unknown' for a null or empty one."""
    cases = [(F.coalesce(url, F.lit("")) == "", "unknown")]
    cases += [(url.rlike("(?i)" + pattern), name) for name, pattern in PURPOSES]
    return first_of([*cases, (url.rlike("(?i)" + TRACKING), "tracked_content")], "content")


def url_path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), ";[^/]*$", "")


def content_type(url: Column) -> Column:
    """What kind of file a URL names."""
    path = F.lower(url_path(url))
    last = F.substring_index(path, "/", -1)
    extension = F.when(last.contains("."), F.substring_index(last, ".", -1)).otherwise("")
    cases = [(extension.isin(names), kind) for kind, names in EXTENSIONS.items()]
    return first_of([*cases, (path.contains("sitemap"), "XML"), (path == "/robots.txt", "Text"), (path.endswith("/") | (extension == ""), "HTML")], "Other")


def named_crawler(agent: Column) -> Column:
    """The first crawler whose keywords all occur in the agent, or null."""
    low = F.lower(agent)
    cases = []
    for name, words in NAMED_CRAWLERS:
        condition = low.contains(words[0])
        for word in words[1:]:
            condition = condition & low.contains(word)
        cases.append((condition, name))
    return first_of(cases)


def crawler_class(name: Column) -> Column:
    return F.when(name.isin(SEO_TOOLS), "seo_tool").when(name.isin(AI_FETCHERS), "generic_bot").when(name.isNotNull(), "search_bot")


def infra_agent(agent: Column) -> Column:
    """The first monitor, preloader or self-ping that the agent names, or null."""
    low = F.lower(agent)
    cases = []
    for name, exact, lower in INFRA:
        found = [agent.contains(w) for w in exact] + [low.contains(w) for w in lower]
        condition = found[0]
        for other in found[1:]:
            condition = condition | other
        cases.append((condition, name))
    return first_of(cases)


def generic_bot(agent: Column) -> Column:
    """'No User-Agent', or the first 60 characters of an agent that names a bot, or null."""
    import re

    pattern = "|".join(map(re.escape, BOT_SIGNALS))
    return F.when(F.coalesce(agent, F.lit("")).isin("", "-"), "No User-Agent").when(F.lower(agent).rlike(pattern), F.substring(agent, 1, 60))


def chrome_version(agent: Column) -> Column:
    return F.regexp_extract(agent, r"Chrome/(\d+)\.", 1).try_cast("int")


def is_real_browser(agent: Column) -> Column:
    return F.coalesce(agent.rlike(r"(?i)Mozilla/5\.0.*AppleWebKit"), F.lit(False))


def engine(agent_name: Column) -> Column:
    return first_of([(agent_name.isin(names), name) for name, names in ENGINES.items()])
