"""Stored pages as trees: elements with nested intervals, heaviest blocks, structure, and rules that are rows of data.

One pass over a page gives a row an element. Elements are numbered in page order and know the last number below them, so
an element's subtree is an interval, and everything after the pass is DataFrame work.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ELEMENTS = "node int, parent int, last int, depth int, tag string, class string, begin int, finish int, words int, label string, text string, placement string, attributes map<string,string>"
#: Attributes that are kept.
KEPT = frozenset("alt lang href rel name property content role type datetime src aria-label".split())
# What is around a page's main content.
AROUND, AROUND_CLASS = ("nav", "header", "footer"), r"(?i)\b(nav|header|footer|menu|sidebar|widget)\b"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements counted as landmarks, and limits of a tree's size: nodes, depth, children.
LANDMARKS = "header nav main aside footer section article form".split()
GOOD_NODES, GOOD_DEPTH, GOOD_CHILDREN, MOST_NODES = 800, 32, 60, 1500
_KIND = [pa.int32()] * 4 + [pa.string()] * 2 + [pa.int32()] * 3 + [pa.string()] * 3 + [pa.map_(pa.string(), pa.string())]


chrome = re.compile(AROUND_CLASS).search


class _Tree(HTMLParser):
    """Elements as lists in the order of ELEMENTS. One that is not closed ends where its parent does."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.text: dict[int, list[str]] = {}
        self.lines = [0]
        for line in page.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.feed(page)
        self.close()
        while self.open:
            self._end(len(page))

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        held = {k: v or "" for k, v in attrs}
        node = len(self.rows)
        around = self.rows[self.open[-1]] if self.open else None
        place = "main" if around is None else around[4] if around[4] in AROUND else "chrome" if around[5] and chrome(around[5]) else around[11]
        self.rows.append([node, self.open[-1] if self.open else None, node, len(self.open) + 1, tag, held.get("class", ""), self._at(), self._at() + len(self.get_starttag_text() or ""), 0, None, None, place, [(k, v) for k, v in held.items() if k in KEPT]])
        if tag not in VOID:
            self.open.append(node)
            if tag in ("a", "h1", "h2", "h3"):
                self.text[node] = []

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._end(self._at() + len(self.get_starttag_text()))

    def handle_endtag(self, tag):
        if any(self.rows[i][4] == tag for i in reversed(self.open)):
            at = self._at()
            while self.rows[self.open[-1]][4] != tag:
                self._end(at)
            self._end(at + len(tag) + 3)

    def _end(self, at: int) -> None:
        row = self.rows[self.open.pop()]
        row[2], row[7] = len(self.rows) - 1, at
        if self.open:
            self.rows[self.open[-1]][8] += row[8]
        if row[0] not in self.text:
            return
        text = row[10] = " ".join("".join(self.text.pop(row[0])).split())
        if text and row[4] != "a":
            for i in reversed(self.open):
                if self.rows[i][9] is not None:
                    break
                self.rows[i][9] = text

    def handle_data(self, data):
        if self.open and self.rows[self.open[-1]][4] not in ("script", "style"):
            self.rows[self.open[-1]][8] += len(data.split())
            for parts in self.text.values():
                parts.append(data)


def page_elements(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """key and ELEMENTS of each element, in page order. words and label (the first heading's text) are those of the
    subtree; text is that of links and headings; placement is nav, header, footer or chrome by the nearest ancestor that says so, else main.

    Null and empty pages give no row, and markup that the parser gives up on gives what it had read of the page.
    """

    def run(batches):
        for batch in batches:
            for own, page in zip(batch.column(0), batch.column(1).to_pylist()):
                rows = _Tree(page).rows if page else []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([own.as_py()] * len(rows), own.type), *[pa.array(column, kind) for column, kind in zip(zip(*rows), _KIND)]], [key, *names])

    names = [part.split()[0] for part in ELEMENTS.replace("map<string,string>", "map").split(", ")]
    source = pages.select(key, F.col(html).alias("html"))
    return source.mapInArrow(run, f"{key} {source.schema[0].dataType.simpleString()}, {ELEMENTS}")


def page_sections(elements: DataFrame, key: str = "page_id", top: int = 12, least_nodes: int = 5) -> DataFrame:
    """Per page its heaviest blocks, by nodes: key, rank, label, class, nodes, words, kb. A block is a child of body, or of the root where there is none.

    A label is the first heading in the block, or else its first class, or else its tag; equal blocks stand in page order.
    """
    body = elements.where("tag = 'body'").groupBy(key).agg(F.min("node").alias("body"))
    nodes = F.col("last") - F.col("node") + 1
    first_class = F.nullif(F.element_at(F.split(F.trim("class"), r"\s+"), 1), F.lit(""))
    top_level = elements.where(nodes >= least_nodes).where("depth <= 3 and tag not in ('script', 'style')")
    blocks = top_level.join(body, key, "left").where(F.coalesce(F.col("parent"), F.lit(-1)) == F.coalesce("body", F.lit(-1)))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("nodes"), "node"))
    kb = F.round(F.greatest(F.col("finish") - F.col("begin"), F.lit(0)) / 1024, 1)
    out = blocks.select(key, "node", F.substring(F.coalesce("label", first_class, "tag"), 1, 60).alias("label"), F.substring("class", 1, 60).alias("class"), nodes.alias("nodes"), "words", kb.alias("kb"))
    return out.withColumn("rank", rank).where(F.col("rank") <= top).select(key, "rank", "label", "class", "nodes", "words", "kb")


def dom_metrics(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """Per page: nodes, depth, children (most of one element), verdict, headings h1 to h6, landmarks, images with and without alt, inputs, labels."""
    tag = F.col("tag")
    alt = F.map_contains_key("attributes", "alt")
    counts = {f"n_{t}": F.count_if(tag == t) for t in ["h1", "h2", "h3", "h4", "h5", "h6", *LANDMARKS]} | {"images_with_alt": F.count_if((tag == "img") & alt), "images_without_alt": F.count_if((tag == "img") & ~alt), "inputs": F.count_if(tag == "input"), "labels": F.count_if(tag == "label")}
    counts |= {"has_lang": F.count_if((tag == "html") & (F.trim(F.coalesce(F.col("attributes")["lang"], F.lit(""))) != "")), "titles": F.count_if(tag == "title"), "unnamed_main": F.count_if((tag == "main") & F.col("label").isNull())}
    # One row a parent, then one a page: both are combined in the task that has read the page.
    by_parent = elements.groupBy(key, "parent").agg(F.count("*").alias("nodes"), F.max("depth").alias("depth"), *[c.alias(n) for n, c in counts.items()])
    children = F.max(F.when(F.col("parent").isNotNull(), F.col("nodes")).otherwise(0))
    whole = by_parent.groupBy(key).agg(children.alias("children"), F.sum("nodes").alias("nodes"), F.max("depth").alias("depth"), *[F.sum(n).alias(n) for n in counts])
    verdict = F.when((F.col("nodes") <= GOOD_NODES) & (F.col("depth") <= GOOD_DEPTH) & (F.col("children") <= GOOD_CHILDREN), "pass").when(F.col("nodes") <= MOST_NODES, "warn").otherwise("fail")
    return whole.select(key, "nodes", "depth", "children", verdict.alias("verdict"), *counts)


def page_anchors(elements: DataFrame, key: str = "page_id", most_chars: int = 120) -> DataFrame:
    """key, node, href, text (its first 120 characters), rel (null where there is none), placement of every link in page order."""
    a = F.col("attributes")
    return elements.where((F.col("tag") == "a") & F.map_contains_key("attributes", "href")).select(key, "node", F.trim(a["href"]).alias("href"), F.substring("text", 1, most_chars).alias("text"), a["rel"].alias("rel"), "placement")


def missing_alt(elements: DataFrame, key: str = "page_id") -> DataFrame:
    """key, node, src of every image without an alternative text; an empty one says that the image is decoration."""
    return elements.where((F.col("tag") == "img") & ~F.map_contains_key("attributes", "alt")).select(key, "node", F.col("attributes")["src"].alias("src"))


def long_features(features: DataFrame, key: str = "page_id") -> DataFrame:
    """key, metric, value of every number or boolean column."""
    kinds = ("int", "bigint", "double", "boolean", "float", "smallint")
    names = [c for c, kind in features.dtypes if c != key and kind in kinds]
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])
    return features.select(key, F.explode(pairs).alias("x")).select(key, "x.metric", "x.value")


def rule_catalogue_check(features: DataFrame, rules: DataFrame, key: str = "page_id") -> DataFrame:
    """key, rule_id, severity, metric, value, status of each rule on each page.

    rules: rule_id, severity, metric, operator, low, high. Rules are data: an operator is one of =, !=, >=, <=, >, <, between, in
    (low is then a list of numbers, as text); features are rows of key, metric, value, so a new rule or metric is a row.
    A value that is null, or a bound that is no number, gives "not measured". Rules without a metric that any page has, or with
    an unknown operator, are for people to check: one row each, without a page, "needs review".
    """
    low, high, value, op = F.col("low").try_cast("double"), F.col("high").try_cast("double"), F.col("value"), F.col("operator")
    numbers = F.filter(F.transform(F.split("low", ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    listed = F.when(F.size(numbers) > 0, F.array_contains(numbers, value))
    known = ("=", "!=", ">=", "<=", ">", "<", "between", "in")
    holds = F.when(op == "=", value == low).when(op == "!=", value != low).when(op == ">=", value >= low).when(op == "<=", value <= low)
    holds = holds.when(op == ">", value > low).when(op == "<", value < low).when(op == "between", (value >= low) & (value <= high)).when(op == "in", listed)
    measured = F.broadcast(features.select("metric").distinct())
    checkable = F.col("metric").isNotNull() & F.coalesce(op.isin(*known), F.lit(False))
    checked = rules.where(checkable)
    status = F.when(value.isNull() | holds.isNull(), "not measured").when(holds, "pass").otherwise("fail")
    met = features.join(F.broadcast(checked) if checked.count() <= 10_000 else checked, "metric").select(key, "rule_id", "severity", "metric", "value", status.alias("status"))
    rest = rules.where(~checkable).unionByName(checked.join(measured, "metric", "left_anti").select(rules.columns))
    none = F.lit(None).cast(features.schema[key].dataType).alias(key)
    return met.unionByName(rest.select(none, "rule_id", "severity", "metric", F.lit(None).cast("double").alias("value"), F.lit("needs review").alias("status")))
