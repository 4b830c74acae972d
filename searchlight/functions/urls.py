"""URL, domain and query text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes of tracking parameters.
TRACKING_PREFIXES = ["utm_", "gclid", "fbclid", "msclkid", "gclsrc", "dclid", "mc_cid", "mc_eid", "_ga", "yclid", "igshid", "ref_src"]
# Words that end a brand's host name, in the order in which they are tried.
BRAND_SUFFIXES = ["education", "academy", "institute", "university", "college", "school", "classes", "coaching", "tutoring", "learning", "training", "online", "official", "digital", "media", "group", "agency", "studio", "studios", "labs", "solutions", "services", "consulting", "marketing", "design", "works", "tech", "software", "apps", "hub", "shop", "store", "global", "world", "hq"]


def strip_query_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "[?#].*$", "")


def norm_url(url: Column) -> Column:
    return F.coalesce(F.rtrim(url, F.lit("/")), F.lit(""))


def canonical_url(url: Column) -> Column:
    """Without the fragment and tracking parameters; other parameters stay, in their order."""
    bare = F.regexp_replace(url, "#.*$", "")
    base, query = F.regexp_replace(bare, r"\?.*$", ""), F.regexp_extract(bare, r"\?(.*)$", 1)
    tracked = "(?i)^(" + "|".join(map(re.escape, TRACKING_PREFIXES)) + ")"
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(tracked))
    return F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)


def norm_domain(url: Column) -> Column:
    """The host in lower case, without scheme, path, port and a leading www."""
    host = F.regexp_replace(F.lower(F.trim(url)), r"^([a-z][a-z0-9+.-]*:)?//", "")
    return F.regexp_replace(F.regexp_replace(host, r"[/?#:].*$", ""), r"^www\.", "")


def slug_of(url: Column) -> Column:
    """The last path segment as [a-z0-9-], or homepage."""
    path = F.regexp_replace(F.regexp_replace(strip_query_fragment(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), "/+$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.substring_index(path, "/", -1)), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", "homepage").otherwise(slug)


def slug_words(url: Column) -> Column:
    path = F.regexp_replace(F.regexp_replace(strip_query_fragment(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*", ""), "^/+|/+$", "")
    return F.filter(F.split(F.lower(F.substring_index(path, "/", -1)), "[-_]+"), lambda t: t != "")


def slug_tokens(url: Column) -> Column:
    """The slug's words, without numbers and without a plural s."""
    words = F.filter(slug_words(url), lambda t: ~t.rlike(r"^\d+$"))
    return F.transform(words, lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t))


def slug_numbers(url: Column) -> Column:
    return F.filter(slug_words(url), lambda t: t.rlike(r"^\d+$"))


def brand_tokens(domain: Column) -> Column:
    """What a brand may be called in queries, from its host: the core, without its suffix word, and with that word apart."""
    core = F.substring_index(norm_domain(domain), ".", 1)
    extra = F.array().cast("array<string>")
    for suffix in reversed(BRAND_SUFFIXES):
        prefix = F.substring(core, F.lit(1), F.greatest(F.length(core) - len(suffix), F.lit(0)))
        found = F.when(F.length(prefix) >= 3, F.array(prefix, F.concat(prefix, F.lit(" " + suffix)))).otherwise(F.array().cast("array<string>"))
        extra = F.when(core.endswith(suffix), found).otherwise(extra)
    return F.when(F.length(core) < 3, F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(F.array(core), extra)))


def strip_brand(query: Column, tokens: list[str]) -> Column:
    """The query in lower case without brand words; longer ones go first, spaces are squeezed."""
    out = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    for token in sorted((t for t in tokens if t), key=lambda t: (-len(t), t)):
        out = F.regexp_replace(out, r"\b" + re.escape(token).replace("\\ ", " ") + r"\b", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))
