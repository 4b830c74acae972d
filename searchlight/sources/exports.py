"""Readers of exported reports: search dumps in several shapes, period exports, behaviour exports, saved pages, network lists.

An export is one small file (25 000 rows at most a pull), so readers take whole files, as (file, content) rows that
``read_files`` gives, and take them apart by column expressions; many files are read by many tasks.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names that a column of a search export has, letters and digits only.
ALIASES = {
    "date": ["date", "day"],
    "query": ["query", "queries", "topqueries", "searchquery", "keyword"],
    "page": ["page", "pages", "toppages", "url", "landingpage"],
    "clicks": ["clicks", "click", "urlclicks"],
    "impressions": ["impressions", "impr", "impressionscount"],
    "ctr": ["ctr", "clickthroughrate"],
    "position": ["position", "avgposition", "averageposition", "pos"],
}
NUMBERS = ("clicks", "impressions", "ctr", "position")
KEYS = ("query", "page", "date", "country", "device", "appearance")
#: Lines in which a header is looked for.
PREAMBLE = 6
#: A character reference as escaping writes it; what has no semicolon stood in the page like that.
REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """file, content of whole text files."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def number(text: Column) -> Column:
    """A number without its percent sign and thousands separators; 0 for what is none."""
    return F.coalesce(F.regexp_replace(F.trim(text), "[%,]", "").try_cast("double"), F.lit(0.0))


def _name(cell: Column) -> Column:
    """The canonical name of a header cell, or null."""
    key = F.regexp_replace(F.lower(cell), "[^a-z0-9]+", "")
    out = F.when(F.lit(False), "")
    for name, keys in ALIASES.items():
        out = out.when(key.isin(keys), name)
    return out


def _cells(line: Column, delimiter: Column) -> Column:
    """The cells of a line; in comma-separated lines quotes hold."""
    comma = F.transform(F.regexp_extract_all(line, F.lit(r'(?:^|,)("(?:[^"]|"")*"|[^,]*)'), F.lit(1)), lambda c: F.when(c.startswith('"'), F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(c))
    plain = F.when(delimiter == "|", F.split(line, r"\|")).otherwise(F.split(line, "\t"))
    return F.transform(F.when(delimiter == ",", comma).otherwise(plain), lambda c: F.trim(c))


def _lines(files: DataFrame) -> DataFrame:
    lines = F.filter(F.split(F.regexp_replace("content", "^﻿", ""), r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.trim(x).rlike(r"^[-| ]+$"))
    return files.select("file", lines.alias("lines"))


def export_rows(files: DataFrame) -> DataFrame:
    """file, row, and the named columns as text, of comma-, tab- or pipe-separated exports; up to five lines may precede the header.

    Rows of a pipe table with another number of cells are left out.
    """
    delimiter = F.when(F.exists(F.slice("lines", 1, PREAMBLE), lambda x: x.contains("\t")), "\t").when(F.exists(F.slice("lines", 1, PREAMBLE), lambda x: x.contains("|")), "|").otherwise(",")
    cut = _lines(files).withColumn("delimiter", delimiter).withColumn("heads", F.transform(F.slice("lines", 1, PREAMBLE), lambda x: F.transform(_cells(x, F.col("delimiter")), _name)))
    at = F.array_position(F.transform("heads", lambda h: F.exists(h, lambda n: n.isNotNull())), True)
    found = cut.withColumn("at", at.cast("int")).where("at > 0").withColumn("names", F.element_at("heads", F.col("at")))
    rows = found.select("file", "delimiter", "names", F.posexplode(F.expr("slice(lines, at + 1, size(lines))")).alias("row", "line")).withColumn("cells", _cells(F.col("line"), F.col("delimiter")))
    get = lambda n: F.when(F.array_position("names", n) > 0, F.nullif(F.try_element_at("cells", F.array_position("names", n).cast("int")), F.lit(""))).alias(n)
    return rows.where((F.col("delimiter") != "|") | (F.size("cells") == F.size("names"))).select("file", "row", *[get(n) for n in ALIASES])


def read_flex_csv(files: DataFrame) -> DataFrame:
    """file, row, date, query, page, clicks, impressions, ctr, position of exports whose headers vary; absent numbers are 0."""
    return export_rows(files).select("file", "row", *[number(F.col(n)).alias(n) if n in NUMBERS else F.col(n) for n in ALIASES])


def read_search_dump(files: DataFrame) -> DataFrame:
    """file, row, page, query, date, clicks, impressions, ctr, position of dumps: raw rows with keys, flat rows, or tables.

    Keys are named by the dump's own dimensions or by what they hold: dates, addresses (over half of the first twenty) or queries.
    """
    text = F.ltrim("content")
    is_json = text.startswith("{") | text.startswith("[")
    v = F.try_parse_json("content")
    rows = F.coalesce(*[F.try_variant_get(v, path, "array<variant>") for path in ("$.rows", "$.data", "$.results", "$.records", "$")])
    dumps = files.where(is_json).select("file", rows.alias("rows"), F.try_variant_get(v, "$.dimensions", "array<string>").alias("dimensions")).where("rows is not null")
    dumps = dumps.withColumn("keys", F.transform("rows", lambda r: F.try_variant_get(r, "$.keys", "array<string>")))
    dumps = dumps.withColumn("width", F.coalesce(F.array_max(F.transform("keys", lambda k: F.size(k))), F.lit(0)))

    def inferred(i: int) -> Column:
        head = F.slice(F.filter(F.transform(F.slice("keys", 1, 200), lambda k: F.try_element_at(k, F.lit(i + 1))), lambda x: x.isNotNull() & (x != "")), 1, 20)
        addresses = F.size(F.filter(head, lambda x: x.startswith("http")))
        return F.when((F.size(head) > 0) & F.forall(head, lambda x: x.rlike(r"^\d{4}-\d{2}-\d{2}$")), "date").when(addresses > F.size(head) * 0.5, "page").otherwise("query")

    own = F.coalesce(F.size("dimensions") == F.col("width"), F.lit(False))
    names = F.when(own, F.transform("dimensions", lambda d: F.coalesce(_name(d), F.lower(d)))).otherwise(F.transform(F.sequence(F.lit(0), F.greatest("width", F.lit(1)) - 1), inferred))
    one = dumps.select("file", names.alias("names"), F.posexplode("rows").alias("row", "r")).withColumn("k", F.try_variant_get("r", "$.keys", "array<string>"))
    flat = lambda n: F.coalesce(*[F.try_variant_get("r", f"$['{a}']", "string") for a in dict.fromkeys([n, *ALIASES[n], n.capitalize()])])
    key = lambda n: F.when(F.col("k").isNotNull(), F.when(F.array_position("names", n) > 0, F.try_element_at("k", F.array_position("names", n).cast("int")))).otherwise(flat(n)).alias(n)
    order = ["page", "query", "date", *NUMBERS]
    parsed = one.select("file", "row", key("page"), key("query"), key("date"), *[number(flat(n)).alias(n) for n in NUMBERS])
    tables = read_flex_csv(files.where(~is_json)).select("file", "row", *order)
    return parsed.unionByName(tables)


def read_period_export(files: DataFrame) -> DataFrame:
    """file, key, clicks, impressions, position, ctr of exports with one key column (a known one, else the first); ctr is computed."""
    cut = _lines(files).withColumn("head", _cells(F.element_at("lines", 1), F.lit(",")))
    lower = F.transform("head", lambda c: F.lower(c))
    at = F.coalesce(*[F.nullif(F.array_position(lower, k), F.lit(0)) for k in KEYS], F.lit(1))
    rows = cut.select("file", lower.alias("names"), at.cast("int").alias("at"), F.posexplode(F.expr("slice(lines, 2, size(lines))")).alias("row", "line")).withColumn("cells", _cells(F.col("line"), F.lit(",")))
    get = lambda n: F.when(F.array_position("names", n) > 0, F.try_element_at("cells", F.array_position("names", n).cast("int")).try_cast("double")).alias(n)
    found = rows.select("file", F.trim(F.element_at("cells", F.col("at"))).alias("key"), get("clicks"), get("impressions"), get("position"))
    return found.where("key is not null and key != '' and lower(key) != 'nan'").withColumn("ctr", F.when(F.col("impressions") > 0, F.col("clicks") / F.col("impressions")))


def read_ip_ranges(lists: DataFrame, fallback: list[tuple[str, str, str]] = ()) -> DataFrame:
    """list_order, class, agent, cidr, lo, hi of providers' network lists (list_order, class, agent, doc) and a fixed fallback (class, agent, cidr).

    A list holds objects with a prefix or an address, or plain strings, at its top or under prefixes or ips. IPv6 networks have no lo and hi; ``verify_bot_ip`` reads their cidr.
    """
    v = F.try_parse_json("doc")
    items = F.flatten(F.filter(F.array(*[F.coalesce(F.try_variant_get(v, p, "array<variant>"), F.array().cast("array<variant>")) for p in ("$.prefixes", "$.ips", "$")]), lambda a: F.size(a) > 0))
    pick = lambda *names: F.coalesce(*[F.try_variant_get("i", f"$.{n}", "string") for n in names])
    address = pick("ip", "ip_address")
    single = F.when(address.contains(":"), F.concat(address, F.lit("/128"))).otherwise(F.concat(address, F.lit("/32")))
    text = F.when(F.schema_of_variant("i") == "STRING", F.try_variant_get("i", "$", "string"))
    found = lists.select("list_order", "class", "agent", F.explode(items).alias("i")).select("list_order", "class", "agent", F.coalesce(pick("ipv4Prefix", "ipv6Prefix", "prefix"), single, text).alias("cidr"))
    if fallback:
        spark = lists.sparkSession
        rows = [(1_000_000 + i, *row) for i, row in enumerate(fallback)]
        found = found.unionByName(spark.createDataFrame(rows, "list_order int, class string, agent string, cidr string"))
    parts = F.split(F.substring_index("cidr", "/", 1), r"\.")
    four = F.col("cidr").rlike(r"^\d{1,3}(\.\d{1,3}){3}/\d{1,2}$")
    start = sum((parts[i].cast("bigint") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0))
    size = F.expr("shiftleft(1L, 32 - cast(substring_index(cidr, '/', -1) as int))")
    lo = F.when(four, start - F.pmod(start, size))
    return found.where("cidr is not null").withColumn("lo", lo).withColumn("hi", F.when(four, F.col("lo") + size - 1))


def unescaped(source: str) -> str:
    """The text with its character references decoded; one without a semicolon, or of a name that is none, stays."""
    return REFERENCE.sub(lambda m: html.unescape(m[0]) if m[1].startswith("#") else html.entities.html5.get(f"{m[1]};", m[0]), source)


def read_page_snapshots(files: DataFrame) -> DataFrame:
    """file, url, html of saved pages: the address stands in a crawl marker or else in the file's name; escaped sources are unescaped."""
    marker = r"<!--\s*crawled:\s*(\S+)\s*-->"
    head = F.substring("content", 1, 4000)
    marked = F.regexp_extract(head, marker, 1)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.substring_index("file", "/", -1), r"\.[^.]*$", ""), r"(?i)^view-source[_-]?", ""), r"^https?[_:]+/*", "")
    parts = F.filter(F.split(stem, "_"), lambda p: p != "")
    named = F.concat(F.lit("https://"), F.rtrim(F.array_join(parts, "/"), F.lit("/")), F.lit("/"))
    body = F.when(marked != "", F.expr(f"substring(content, length(split(content, r'{marker}', 2)[0]) + length(regexp_extract(substring(content, 1, 4000), r'{marker}', 0)) + 1)")).otherwise(F.col("content"))
    probe = F.substring(F.regexp_replace("html", r"<!--\s*saved from url[^>]*-->", ""), 1, 20_000)
    count = lambda t: F.regexp_count(probe, F.lit(t))

    @F.pandas_udf("string")
    def unescape(column: pd.Series) -> pd.Series:
        return column.map(unescaped, na_action="ignore")

    found = files.select("file", F.when(marked != "", marked).otherwise(named).alias("url"), body.alias("html")).withColumn("escaped", (count("&lt;") > 20) & (count("&lt;") > count("<") * 5))
    plain, escaped = found.where("not escaped"), found.where("escaped").withColumn("html", unescape("html"))
    return plain.unionByName(escaped).drop("escaped")


def read_behaviour_export(files: DataFrame) -> DataFrame:
    """file, metric, header (map), columns, row, cells of exports with a block of keys and values, a metric line and a table."""
    rows = F.transform(F.split("content", r"\r?\n"), lambda x: _cells(x, F.lit(",")))
    cut = files.select("file", rows.alias("rows")).withColumn("at", F.array_position(F.transform("rows", lambda r: r[0]), "Metric").cast("int")).where("at > 0")
    pairs = F.filter(F.slice("rows", 1, F.col("at") - 1), lambda r: (F.size(r) == 2) & (r[0] != ""))
    cut = cut.select("file", F.try_element_at(F.element_at("rows", F.col("at")), F.lit(2)).alias("metric"), F.transform(pairs, lambda r: F.struct(r[0].alias("k"), r[1].alias("v"))).alias("pairs"), F.filter(F.expr("slice(rows, at + 1, size(rows))"), lambda r: F.exists(r, lambda c: c != "")).alias("table"))
    header = F.map_from_entries(F.filter("pairs", lambda p, i: ~F.exists(F.slice("pairs", i + 2, F.size("pairs")), lambda q: q["k"] == p["k"])))
    return cut.where(F.size("table") > 0).select("file", "metric", header.alias("header"), F.element_at("table", 1).alias("columns"), F.posexplode(F.expr("slice(table, 2, size(table))")).alias("row", "cells"))


def write_tables(tables: dict[str, DataFrame], folder: str, run_date: str, formats: tuple[str, ...] = ("parquet",)) -> None:
    """Each table in each format (parquet, json, csv, tsv) under folder/name.format/run_date=..., overwriting that date's files only."""
    for name, table in tables.items():
        for kind in formats:
            writer = table.write.mode("overwrite").option("header", True)
            path = f"{folder}/{name}.{kind}/run_date={run_date}"
            (writer.option("sep", "\t").csv(path) if kind == "tsv" else writer.format(kind).save(path))
