"""Corpus jobs over stored pages: extracted signals, raw against rendered, templates, links and text."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIGNALS = "title string, description string, robots string, canonical string, h1 array<string>, h2 array<string>, h3 array<string>, links array<string>, images array<string>, images_without_alt array<string>, jsonld_types array<string>, n_nodes int, depth int, n_words int, failed boolean"


class _Page(HTMLParser):
    """One tolerant pass over a page; whatever the markup, it ends with a full set of signals."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: dict = {k: [] for k in ("h1", "h2", "h3", "links", "images", "images_without_alt", "jsonld_types")} | {"title": None, "description": None, "robots": None, "canonical": None}
        self.stack: list[str] = []
        self.nodes = self.depth = self.words = 0
        self.into: list[tuple[str, list]] = []
        self.raw: str | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        self.nodes += 1
        if tag not in self.VOID:
            self.stack.append(tag)
            self.depth = max(self.depth, len(self.stack))
        if tag in ("title", "h1", "h2", "h3"):
            self.into.append((tag, []))
        elif tag == "a" and a.get("href"):
            self.out["links"].append(a["href"])
        elif tag == "img":
            self.out["images"].append(a.get("src", ""))
            if not a.get("alt", "").strip():
                self.out["images_without_alt"].append(a.get("src", ""))
        elif tag == "meta" and a.get("name", "").lower() in ("description", "robots"):
            self.out[a["name"].lower()] = a.get("content")
        elif tag == "link" and "canonical" in a.get("rel", "").lower():
            self.out["canonical"] = a.get("href")
        elif tag in ("script", "style"):
            self.raw = a.get("type", "") if tag == "script" else ""

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass
        for i in range(len(self.into) - 1, -1, -1):
            if self.into[i][0] == tag:
                self._take(i)
                break
        if tag in ("script", "style"):
            self.raw = None

    def _take(self, i):
        tag, parts = self.into.pop(i)
        text = " ".join("".join(parts).split())
        if tag == "title":
            self.out["title"] = self.out["title"] or text
        elif text:
            self.out[tag].append(text)

    def handle_data(self, data):
        if self.raw is None:
            self.words += len(data.split())
            for _, parts in self.into:
                parts.append(data)
        elif "ld+json" in self.raw:
            self._types(data)

    def _types(self, data):
        import json

        try:
            todo = [json.loads(data)]
        except ValueError:
            return
        while todo:
            node = todo.pop()
            if isinstance(node, dict):
                kind = node.get("@type")
                self.out["jsonld_types"] += [kind] if isinstance(kind, str) else [k for k in kind or () if isinstance(k, str)]
                todo += node.values()
            elif isinstance(node, list):
                todo += node

    def signals(self) -> dict:
        while self.into:
            self._take(-1)
        return self.out | {"n_nodes": self.nodes, "depth": self.depth, "n_words": self.words}


def signals_of(page: str | None) -> dict:
    parser = _Page()
    failed = False
    try:
        parser.feed(page or "")
        parser.close()
    except Exception:  # broken markup must not end the job; the row says so
        failed = True
    return parser.signals() | {"failed": failed}


def page_signals(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """key and one struct of signals a page, flattened. Null pages have empty signals; broken markup gives what can be read."""

    def run(batches):
        for batch in batches:
            rows = [signals_of(p) for p in batch.column(1).to_pylist()]
            kinds = {"failed": pa.bool_(), "n_nodes": pa.int32(), "depth": pa.int32(), "n_words": pa.int32()} | {k: pa.string() for k in ("title", "description", "robots", "canonical")}
            names = [part.split()[0] for part in SIGNALS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[n] for r in rows], kinds.get(n, pa.list_(pa.string()))) for n in names]], [key, *names])

    source = pages.select(key, F.col(html).alias("html"))
    return source.mapInArrow(run, f"{key} {source.schema[0].dataType.simpleString()}, {SIGNALS}")


def text_gap(raw: Column, rendered: Column) -> Column:
    """none, low, medium or high: how much of the rendered amount is missing from the raw page."""
    gap = F.coalesce(F.try_divide((rendered - raw) * 100, rendered), F.lit(0.0))
    return F.when(gap < 10, "none").when(gap < 30, "low").when(gap < 60, "medium").otherwise("high")


def snapshot_diff(snapshots: DataFrame) -> DataFrame:
    """Per page (page_id, raw_html, rendered_html): what only the rendered page has, and grades of the gaps."""
    side = lambda s: page_signals(snapshots, f"{s}_html").select("page_id", *[F.col(c).alias(f"{c}_{s}") for c in ("title", "h1", "h2", "links", "images", "n_words")])
    both = side("raw").join(side("rendered"), "page_id")
    only = lambda c: F.array_except(f"{c}_rendered", f"{c}_raw")
    return both.select("page_id", F.size(only("links")).alias("js_only_links"), F.size(only("images")).alias("js_only_images"), F.size(only("h2")).alias("js_only_h2"), F.col("title_raw").eqNullSafe(F.col("title_rendered")).alias("same_title"), text_gap(F.col("n_words_raw"), F.col("n_words_rendered")).alias("text_gap"), text_gap(F.size("links_raw"), F.size("links_rendered")).alias("link_gap"))


def _item(kind: str):
    return lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item"))


def js_only_items(snapshots: DataFrame) -> DataFrame:
    """page_id, kind (link, image, h2), item: each thing that only the rendered page has, once a page."""
    side = lambda s: page_signals(snapshots, f"{s}_html").select("page_id", *[F.col(c).alias(f"{c}_{s}") for c in ("links", "images", "h2")])
    both = side("raw").join(side("rendered"), "page_id")
    items = F.flatten(F.array(*[F.transform(F.array_except(f"{c}_rendered", f"{c}_raw"), _item(kind)) for c, kind in (("links", "link"), ("images", "image"), ("h2", "h2"))]))
    return both.select("page_id", F.explode(items).alias("x")).select("page_id", "x.kind", "x.item")


def page_text(html: Column) -> Column:
    """The page's text without scripts, styles and tags, with common character references decoded and white space squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("copy", "©"), ("middot", "·"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{name};"), F.lit(char))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def templated_ratio(texts: DataFrame, least_chars: int = 40) -> DataFrame:
    """Per page of (grp, page, text): share of its sentences that at least half its peers have, and how many are its own.

    Sentences are hashed before the shuffle, so it moves no text.
    """
    sentences = texts.select("grp", "page", F.explode(F.split("text", r"(?<=[.!?])\s+|\n")).alias("s")).where(F.length(F.trim("s")) > least_chars).select("grp", "page", F.xxhash64(F.trim("s")).alias("h"))
    per = sentences.groupBy("grp", "h", "page").agg(F.count("*").alias("n"))
    spread = per.groupBy("grp", "h").agg(F.count("*").alias("pages"))
    size = texts.groupBy("grp").agg(F.countDistinct("page").alias("peers"))
    joined = per.join(spread, ["grp", "h"]).join(size, "grp")
    common = (F.col("peers") > 1) & (F.col("pages") - 1 >= (F.col("peers") - 1) / 2)
    return joined.groupBy("grp", "page").agg((F.sum(F.when(common, F.col("n")).otherwise(0)) / F.sum("n")).alias("templated"), F.count_if(F.col("pages") == 1).alias("own_sentences"), F.sum("n").alias("sentences"))


def doorway_verdict(ratio: DataFrame) -> DataFrame:
    verdict = F.when((F.col("templated") >= 0.8) & (F.col("own_sentences") < 3), "doorway risk").when(F.col("templated") >= 0.5, "thin").otherwise("distinct")
    return ratio.withColumn("verdict", verdict)


def parse_robots(lines: DataFrame, compat: bool = False) -> DataFrame:
    """host, agent (lower case), allow, path of robots files given as host, line (number), value.

    User-agent lines that follow each other name one group, and its rules hold for each of them. With ``compat`` a line
    replaces the one before, so of agents that follow each other only the last has rules. Rules before any agent, and lines of other
    directives, are left out. A file is a few hundred lines; files are spread by host.
    """
    clean = F.trim(F.regexp_replace("value", "#.*$", ""))
    name, rest = F.lower(F.trim(F.substring_index(clean, ":", 1))), F.trim(F.expr("substring(clean, instr(clean, ':') + 1)"))
    rows = lines.withColumn("clean", clean).where(F.col("clean").contains(":")).select("host", "line", name.alias("name"), rest.alias("rest")).where(F.col("name").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("line")
    agent = F.col("name") == "user-agent"
    begins = agent if compat else agent & (F.coalesce(F.lag("name").over(order), F.lit("")) != "user-agent")
    rows = rows.withColumn("begins", begins.cast("int")).withColumn("group", F.sum("begins").over(order))
    agents = rows.where(agent).select("host", "group", F.lower("rest").alias("agent")).distinct()
    return rows.where(~agent).join(agents, ["host", "group"]).select("host", "agent", (F.col("name") == "allow").alias("allow"), F.col("rest").alias("path"))


def robots_access(rules: DataFrame, requests: DataFrame, compat: bool = False) -> DataFrame:
    """host, path, bot, allowed: the longest matching rule decides, the group that names the bot before *, and an empty Disallow allows.

    rules: host, agent (lower case), allow, path; requests: host, path, bot. With ``compat`` the rules of * hold beside the
    bot's own and an empty Disallow blocks everything. A path meets the rules by its prefixes of the lengths that the host's
    rules have, so the join is on host, agent and prefix; null paths count as empty.
    """
    named = rules.select("host", "agent").distinct()
    asked = requests.select("host", "path", "bot").distinct().withColumn("agent", F.lower("bot"))
    if compat:
        own = asked.withColumn("agent", F.explode(F.array_distinct(F.array("agent", F.lit("*")))))
    else:
        own = asked.join(named.withColumn("named", F.lit(True)), ["host", "agent"], "left").withColumn("agent", F.when(F.col("named"), F.col("agent")).otherwise("*")).drop("named")
    counted = rules.where(F.lit(True) if compat else F.col("path") != "").select("host", "agent", F.coalesce("path", F.lit("")).alias("rule"), "allow").groupBy("host", "agent", "rule").agg(F.max("allow").alias("allow"))
    lengths = counted.groupBy("host", "agent").agg(F.collect_set(F.length("rule")).alias("lengths"))
    path = F.coalesce("path", F.lit(""))
    tried = own.join(lengths, ["host", "agent"]).select("host", "agent", "path", "bot", F.explode(F.filter("lengths", lambda n: n <= F.length(path))).alias("n")).withColumn("rule", F.substring(path, F.lit(1), F.col("n")))
    found = tried.join(counted, ["host", "agent", "rule"])
    best = found.groupBy("host", "path", "bot").agg(F.max_by("allow", F.struct("n", F.col("allow"))).alias("allow"))
    both = requests.join(best.withColumnRenamed("host", "h").withColumnRenamed("path", "p").withColumnRenamed("bot", "b"), F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")) & F.col("bot").eqNullSafe(F.col("b")), "left")
    return both.select("host", "path", "bot", F.coalesce("allow", F.lit(True)).alias("allowed"))
