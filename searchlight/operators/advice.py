"""What to do about a finding: one row of texts for each rule, joined to findings as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ("rule", "owner", "effort", "root_cause", "impact", "action", "verify")
#: The rules that come with the library; more are more rows.
RULES = [
    ("404 Not Found", "SEO", "Low", "A URL that was linked or indexed is gone", "Crawls end at an error and links to it are lost", "Restore it, redirect it to its nearest successor, or answer 410", "No crawler asks for it in the next log"),
    ("Server Error", "Engineering", "High", "The server fails on this URL", "Crawlers slow down and may drop the page", "Find the failure in the application log of that time and mend it", "The share of 5xx falls to none in the next log"),
    ("301 Redirect Still Being Crawled", "SEO", "Low", "Links or sitemaps still name the old address", "Every visit costs a second request", "Let internal links and sitemaps name the new address", "Requests of the old address go down"),
    ("302 Temporary Redirect", "Engineering", "Low", "A lasting move is answered as a temporary one", "The old address stays indexed", "Answer 301 if the move is to last", "The URL answers 301 or 200"),
    ("Redirect Chain Detected", "Engineering", "Medium", "A redirect leads to another redirect", "Each step costs a request and may be given up", "Redirect to the last address at once", "One step leads to a page that answers 200"),
    ("Backend URL Crawled", "Engineering", "Low", "Addresses of the back end can be reached and are linked", "Crawlers spend requests on what is not to be indexed", "Disallow them in robots.txt and take their links out", "Crawlers stop asking for them"),
    ("High Internal Traffic", "Engineering", "Low", "Monitors or jobs of one's own ask often", "Shares of all other agents look smaller", "Ask less often, or leave them out of the log", "Its share falls below the limit"),
    ("Suspicious High-Volume IP", "Security", "Medium", "One address sends many requests without naming a known agent", "Load, and contents taken or tested for holes", "Look at its requests, then limit or block it", "Its requests end or are answered 403 or 429"),
    ("URL Parameter Explosion", "Engineering", "Medium", "Filters or tracking parameters make many addresses of one page", "Crawlers spend requests on copies", "Name one canonical address and disallow the parameters", "Fewer variants are crawled"),
    ("High Static Asset Crawl Ratio", "Engineering", "Medium", "Assets are short-lived in caches or change names often", "Less of the crawl is left for pages", "Cache assets for long and keep their names", "The share of assets falls below the limit"),
    ("Low-Value Taxonomy Pages Over-Crawled", "SEO", "Medium", "Tags, archives and the like are linked from everywhere", "Less of the crawl is left for contents", "Take them out of the index and link them less", "Their share falls below the limit"),
    ("robots.txt Returning Error", "Engineering", "Low", "robots.txt is missing or fails", "On server errors crawlers may stop altogether", "Serve it as a file that answers 200", "All its requests answer 200 or 304"),
    ("Sitemap Returning Error", "Engineering", "Low", "A sitemap is missing or fails", "New pages are found late", "Serve it at the address that robots.txt names", "All its requests answer 200 or 304"),
    ("Trailing Slash Duplicate URLs", "Engineering", "Low", "A page answers with and without a slash at its end", "Two addresses share what one should have", "Redirect one to the other and link that one only", "Only one of the two answers 200"),
    ("Oversized HTML Page", "Engineering", "Medium", "Markup, styles or data stand in the page itself", "Pages load slowly and may be read in part", "Move styles, scripts and data out of the page", "Its mean size falls below the limit"),
    ("Sensitive File", "Security", "Low", "A file that should not be public is asked for, and may be there", "Secrets or versions may be known to others", "Remove it, deny the path, and change what it held", "It answers 403 or 404"),
    ("Googlebot Mobile-First Imbalance", "SEO", "Medium", "Pages are crawled by the desktop crawler for the most part", "The mobile version may not be the one that is indexed", "See that mobile pages have the same contents and can be reached", "The mobile share rises above half"),
    ("Low Googlebot Activity", "SEO", "Medium", "The crawler is kept out, or finds little that changes", "Changes reach the index late", "Look at blocks, errors and speed, and at internal links", "Its share rises above the limit"),
]


def rule_texts(spark: SparkSession) -> DataFrame:
    """RULES as a table."""
    return spark.createDataFrame(RULES, ", ".join(f"{c} string" for c in COLUMNS))


def rule_of(issue: Column) -> Column:
    """The rule of an issue: without what stands behind its colon or, for a server error, the code before it."""
    return F.regexp_replace(F.substring_index(issue, ": ", 1), r"^5\d\d (?=Server Error$)", "")


def with_rule_texts(findings: DataFrame, texts: DataFrame) -> DataFrame:
    """findings with the rule, its owner and effort, and the texts on cause, impact, action and check.

    texts has COLUMNS, one row a rule; issues without a row (or null) keep null texts, and no finding is lost. A catalogue
    of rules is small, so Spark broadcasts it by its known size.
    """
    return findings.withColumn("rule", rule_of(F.col("issue"))).join(texts.select(*COLUMNS).dropDuplicates(["rule"]), "rule", "left")
