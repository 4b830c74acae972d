"""Who stands behind a page: authors, reviews, dates and policies, from the graph of its structured data and its links.

Every node of a page's JSON-LD becomes a row, however deep it is nested, with the property that holds it. An author is then
found by joins: the node nested in an article, or the node of the page that the article's reference names, through references
to references too.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODES = "node int, parent int, property string, id string, types array<string>, name string, same_as int, published string, modified string, is_reference boolean"
_KIND = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_()]
# Types of articles, bylines that name nobody, and words that show a policy page in a link.
ARTICLES = ["Article", "BlogPosting", "NewsArticle"]
NOBODY = r"(?i)^(admin|administrator|webmaster|staff|team|user\d+|[a-z]+\d{4,})$"
POLICIES = {"privacy": ["privacy"], "terms": ["terms", "tos"], "contact": ["contact"], "about": ["about", "our-story", "our story"]}
BLOCKS = r"""(?is)<script\b[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>(.*?)</script\s*>"""


def nodes_of(blocks: list[str]) -> list[tuple]:
    """Rows of NODES of JSON texts, in the order in which their objects begin; broken texts are skipped."""
    out: list[list] = []
    text = lambda v: v if isinstance(v, str) else None
    for block in blocks:
        try:
            todo = [(json.loads(block), None, None)]
        except (ValueError, RecursionError):
            continue
        while todo:
            value, parent, prop = todo.pop()
            if isinstance(value, list):
                todo += [(v, parent, prop) for v in reversed(value)]
            elif isinstance(value, dict):
                kinds, same = value.get("@type"), value.get("sameAs")
                kinds = [kinds] if isinstance(kinds, str) else [k for k in kinds if isinstance(k, str)] if isinstance(kinds, list) else []
                same = 1 if isinstance(same, str) else len(same) if isinstance(same, list) else 0
                node = len(out)
                out.append([node, parent, prop, text(value.get("@id")), kinds, text(value.get("name")), same, text(value.get("datePublished")), text(value.get("dateModified")), set(value) == {"@id"}])
                # A graph is no property: its nodes stand beside what holds it.
                todo += [(v, parent, prop) if k == "@graph" else (v, node, k) for k, v in reversed(value.items()) if isinstance(v, (dict, list))]
    return [tuple(row) for row in out]


def jsonld_nodes(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """key and NODES of each object in a page's JSON-LD; property is what holds it in its parent, null at the top."""

    def run(batches):
        for batch in batches:
            for own, blocks in zip(batch.column(0), batch.column(1).to_pylist()):
                rows = nodes_of(blocks or [])
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([own.as_py()] * len(rows), own.type), *[pa.array(column, kind) for column, kind in zip(zip(*rows), _KIND)]], [key, *names])

    names = [part.split()[0] for part in NODES.split(", ")]
    source = pages.select(key, F.regexp_extract_all(html, F.lit(BLOCKS), F.lit(1)).alias("blocks"))
    return source.mapInArrow(run, f"{key} {source.schema[0].dataType.simpleString()}, {NODES}")


def jsonld_types(nodes: DataFrame, key: str = "page_id") -> DataFrame:
    """type, pages and nodes that have it, over all pages."""
    return nodes.select(key, F.explode("types").alias("type")).groupBy("type").agg(F.countDistinct(key).alias("pages"), F.count("*").alias("nodes"))


def resolved(nodes: DataFrame, key: str = "page_id", hops: int = 3) -> DataFrame:
    """key, node, target: the node that each one stands for. A bare reference stands for the first full node of its page with that
    id; where references lead to references, ``hops`` of them are followed. One that leads nowhere stands for itself."""
    full = nodes.where("id is not null and not is_reference").groupBy(key, "id").agg(F.min("node").alias("target"))
    bare = nodes.where("is_reference").select(key, "node", "id")
    alias = nodes.where("id is not null and not is_reference and size(types) = 0 and name is null")
    # A node that only says "the same as" another leads on.
    onward = alias.alias("a").join(nodes.where("property = 'sameAs' and is_reference").select(key, F.col("parent").alias("node"), F.col("id").alias("next")), [key, "node"]).select(key, F.col("id"), "next")
    for _ in range(hops - 1):
        moved = bare.join(onward, [key, "id"], "left").select(key, "node", F.coalesce("next", "id").alias("id"))
        bare = moved
    found = bare.join(full, [key, "id"], "left").select(key, "node", "target")
    return nodes.select(key, "node").join(found, [key, "node"], "left").select(key, "node", F.coalesce("target", "node").alias("target"))


def _has(*types: str) -> Column:
    return F.arrays_overlap("types", F.array(*map(F.lit, types)))


def _any_says(said, words: list[str]) -> Column:
    """Whether an anchor's address or text has one of the words."""
    return F.exists("anchors", lambda a: said(a).rlike("|".join(words)))


def trust_signals(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Per page: blocks, article type, author (its type, name, profiles), byline and whether it names nobody, persons, reviews and ratings,
    dates, links to policies and to the author. The author is the article's, nested or referenced, or else the page's first person.

    A page without any of it has nulls, zeros and false; a link that was not followed is never called broken.
    """
    nodes = jsonld_nodes(pages, html, key)
    targets = resolved(nodes, key)
    article = nodes.where(_has(*ARTICLES)).groupBy(key).agg(F.min_by(F.struct("node", "types", "published", "modified"), "node").alias("a"))
    article = article.select(key, "a.*").withColumn("article_type", F.element_at(F.filter("types", lambda t: t.isin(*ARTICLES)), 1)).drop("types")
    held = nodes.where("property = 'author'").select(key, F.col("parent").alias("article"), "node")
    first = Window.partitionBy(key).orderBy("node")
    named = held.join(article.select(key, F.col("node").alias("article")), [key, "article"]).join(targets, [key, "node"]).withColumn("r", F.row_number().over(first)).where("r = 1").select(key, "target")
    person = nodes.where(_has("Person")).groupBy(key).agg(F.min("node").alias("person"), F.count("*").alias("persons"))
    kinds = nodes.groupBy(key).agg(F.count_if(_has("Review")).alias("reviews"), F.count_if(_has("AggregateRating")).alias("ratings"))
    chosen = kinds.join(person, key, "left").join(named, key, "left").withColumn("node", F.coalesce("target", "person"))
    author = chosen.join(nodes.select(key, "node", F.element_at(F.concat("types", F.array(F.lit(None).cast("string"))), 1).alias("author_type"), F.col("name").alias("author_name"), "same_as"), [key, "node"], "left").drop("node", "target", "person")

    h = F.col(html)
    grab = lambda pattern: F.nullif(F.trim(F.regexp_extract(h, pattern, 1)), F.lit(""))
    printed = F.coalesce(grab(r"""(?i)class="[^"]*\bauthor\b[^"]*"[^>]*>\s*([^<]{2,60})<"""), grab(r"""(?i)rel=["']author["'][^>]*>\s*([^<]{2,60})<"""))
    when = lambda name: grab(rf"""(?i)property=["']article:{name}_time["']\s+content=["']([^"']+)""")
    anchors = F.regexp_extract_all(h, F.lit(r"(?is)(<a\b[^>]*>.*?)</a\s*>"), F.lit(1))
    address = lambda a: F.regexp_extract(a, r"""(?is)\bhref\s*=\s*["']?([^"'\s>]*)""", 1)
    said = lambda a: F.lower(F.concat(address(a), F.regexp_replace(a, r"<[^>]*>", "")))
    policy = [_any_says(said, words).alias(f"links_{name}") for name, words in POLICIES.items()]
    to_author = F.filter("anchors", lambda a: a.rlike(r"""(?i)^<a\b[^>]*\brel\s*=\s*["']?[^"'>]*\bauthor\b""") | address(a).rlike("(?i)/author/|/about/|/team/"))
    shown = pages.select(key, F.size(F.regexp_extract_all(h, F.lit(BLOCKS), F.lit(1))).alias("blocks"), printed.alias("printed"), when("published").alias("meta_published"), when("modified").alias("meta_modified"), anchors.alias("anchors"))
    out = shown.join(article.drop("node"), key, "left").join(author, key, "left")
    byline = F.coalesce("printed", "author_name")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select(
        key, zero("blocks"), "article_type", "author_type", F.coalesce(F.col("author_type") == "Person", F.lit(False)).alias("author_is_person"), byline.alias("byline"),
        F.coalesce(byline.rlike(NOBODY), F.lit(False)).alias("names_nobody"), zero("persons"), zero("same_as"), zero("reviews"), zero("ratings"),
        F.coalesce("published", "meta_published").alias("published"), F.coalesce("modified", "meta_modified").alias("modified"), *[F.coalesce(p, F.lit(False)).alias(f"links_{n}") for p, n in zip(policy, POLICIES)],
        F.try_element_at(F.transform(to_author, address), F.lit(1)).alias("author_link"),
    )
