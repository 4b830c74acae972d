"""Audits of stored pages by column expressions: landmarks, titles, pagers, filters, the organisation that a page declares, shared templates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlight.storage import written

PAGER = r'(?is)<(?:div|nav|ul)\b[^>]*(?:class|id)="[^"]*(?:pager|pagination)[^"]*"[^>]*>(.*?)</(?:div|nav|ul)>'
FILTER = r'(?is)<input\b[^>]*type="checkbox"[^>]*data-(tax|group)='
# Types of an organisation.
ORGANISATIONS = ["organization", "localbusiness", "store", "corporation", "onlinestore"]
#: Most pages and lines of a block, on average, and most places in which lines meet at a time.
BLOCK_PAGES, BLOCK_LINES, MEETINGS = 1024, 1 << 20, 1 << 22


def page_audit(pages: DataFrame) -> DataFrame:
    """page_id, check, severity: pagination, landmarks, title and first heading, filters. OK rows say that a check was passed."""
    h = F.coalesce("html", F.lit(""))
    plain = lambda tag: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(h, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), "<[^>]*>", ""), r"\s+", " "))
    rows = pages.select("page_id", h.alias("h"), plain("title").alias("title"), plain("h1").alias("h1"), F.regexp_extract_all(h, F.lit(PAGER), F.lit(1)).alias("pagers"))
    h, mains = F.col("h"), F.regexp_count("h", F.lit(r"(?i)<main\b"))
    linked = F.exists("pagers", lambda p: p.rlike(r"(?i)<a\b[^>]*href="))
    dead = F.exists("pagers", lambda p: p.rlike(r"(?i)<button\b[^>]*(data-page|class=\"[^\"]*page)") & ~p.rlike(r"(?i)<a\b[^>]*href="))
    nested = F.exists(F.split(h, "(?i)</main"), lambda p: F.regexp_count(p, F.lit(r"(?i)<main\b")) > 1)
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0)))
    thin = (F.length("h1") < 25) & (F.size(F.array_except(words("title"), words("h1"))) >= 2)
    checks = {
        "pagination": F.when(F.size("pagers") == 0, "LOW").when(dead, "CRITICAL").when(linked, "OK"),
        "landmarks": F.when(mains == 0, "MEDIUM").when(mains == 1, "OK").when(nested, "HIGH").otherwise("MEDIUM"),
        "title": F.when(F.col("title") == "", "MEDIUM"),
        "heading": F.when(F.col("h1") == "", "HIGH").when((F.col("title") != "") & thin, "MEDIUM").when(F.col("title") != "", "OK"),
        "filters": F.when(h.rlike(FILTER), "LOW"),
    }
    found = F.explode(F.array(*[F.struct(F.lit(name).alias("check"), severity.alias("severity")) for name, severity in checks.items()]))
    return rows.select("page_id", found.alias("f")).select("page_id", "f.check", "f.severity").where("severity is not null")


def entity_signals(pages: DataFrame) -> DataFrame:
    """page_id, blocks, has_organisation, what it declares, perfect_rating and what the page's text adds, from JSON-LD."""
    h = F.coalesce("html", F.lit(""))
    blocks = F.regexp_extract_all(h, F.lit(r"""(?is)<script\b[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    parsed = F.transform(blocks, lambda b: F.try_parse_json(b))
    own = lambda v: F.coalesce(F.try_variant_get(v, "$['@graph']", "array<variant>"), F.try_variant_get(v, "$", "array<variant>"), F.array(v))
    nodes = F.flatten(F.transform(F.filter(parsed, lambda v: v.isNotNull()), own))
    kinds = lambda n: F.transform(F.coalesce(F.try_variant_get(n, "$['@type']", "array<string>"), F.array(F.try_variant_get(n, "$['@type']", "string"))), lambda t: F.lower(t))
    organisation = F.filter(nodes, lambda n: F.coalesce(F.exists(kinds(n), lambda t: t.isin(ORGANISATIONS) | t.contains("business")), F.lit(False)))
    rows = pages.select("page_id", h.alias("h"), F.size(blocks).alias("blocks"), F.try_element_at(organisation, F.lit(1)).alias("o"))
    has = lambda *names: F.coalesce(*[F.try_variant_get("o", f"$.{n}", "string") for n in names]).isNotNull()
    rating = F.try_variant_get("o", "$.aggregateRating.ratingValue", "string")
    return rows.select("page_id", "blocks", F.col("o").isNotNull().alias("has_organisation"), has("name").alias("name"), has("sameAs").alias("same_as"), has("logo").alias("logo"), has("founder", "founders").alias("founder"), has("address").alias("address"), has("telephone", "contactPoint").alias("telephone"), F.coalesce(rating.isin("5", "5.0"), F.lit(False)).alias("perfect_rating"), F.col("h").rlike(r"""(?i)href=["'][^"']*about""").alias("about_link"), F.col("h").rlike(r"(?i)\b(founded|established|since)\b\s*\d{4}").alias("founded"))


def _lines() -> Column:
    """The hashes of a page's lines; lines end at line feeds and between tags."""
    lines = F.filter(F.transform(F.split("html", r"\r?\n|(?<=>)(?=<)"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_distinct(F.transform(lines, lambda x: F.xxhash64(x)))


def page_lines(pages: DataFrame, group: str) -> DataFrame:
    """group, page_id, line: the hash of each distinct line of a page."""
    return pages.select(group, "page_id", F.explode(_lines()).alias("line"))


def common_lines(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """How many lines each page of a has in common with each page of b. A side is its pages' numbers and lines, a place a line."""
    counts = np.zeros(shape, np.int32)
    both = np.intersect1d(a[1], b[1])
    sides = []
    for page, line in (a, b):
        code = np.searchsorted(both, line)
        held = code < len(both)
        held[held] = both[code[held]] == line[held]
        order = np.argsort(code[held], kind="stable")
        sides.append((page[held][order], np.bincount(code[held], minlength=len(both))))
    (pa_, na), (pb, nb) = sides
    at, bt = np.cumsum(na) - na, np.cumsum(nb) - nb
    often = na * nb > 1024
    for i in np.flatnonzero(often):
        counts[np.ix_(pa_[at[i] : at[i] + na[i]], pb[bt[i] : bt[i] + nb[i]])] += 1
    # Lines on few pages: each place in a, repeated for all in b that have its line.
    code = np.repeat(np.arange(len(both)), na)
    rare = np.flatnonzero(~often[code])
    times = nb[code[rare]]
    cuts = np.flatnonzero(np.diff(np.cumsum(times) // MEETINGS)) + 1
    for part, n in zip(np.split(rare, cuts), np.split(times, cuts)):
        first = np.repeat(bt[code[part]] - (np.cumsum(n) - n), n)
        counts += np.bincount(np.repeat(pa_[part], n) * shape[1] + pb[first + np.arange(n.sum())], minlength=counts.size).reshape(shape).astype(np.int32)
    return counts


def alike_in_blocks(sets: DataFrame, group: str, parts: int, least: float) -> DataFrame:
    """a, b, common, total (of both pages' lines) of the pairs in a group with 2 x common / total above ``least``. sets: group, page_id, n, lines, blocks.

    A group's pages are dealt out to its number of blocks, and each two blocks meet in one task: a page's lines move once a block,
    and of pairs only those above the limit leave the task.
    """

    def alike(found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        block, low, high = found["block"].to_numpy(), found["low"][0].as_py(), found["high"][0].as_py()
        pages, sizes, sides = [], [], []
        for x in (low, high):
            rows = found.filter(pa.array(block == x))
            lines = rows["lines"].combine_chunks()
            pages.append(rows["page_id"])
            sizes.append(rows["n"].to_numpy())
            sides.append((np.repeat(np.arange(len(rows)), lines.value_lengths().to_numpy()), lines.flatten().to_numpy()))
        counts = common_lines(*sides, (len(pages[0]), len(pages[1])))
        total = sizes[0][:, None] + sizes[1][None, :]
        good = 2 * counts / np.maximum(total, 1) > least
        x, y = np.nonzero(np.triu(good & (counts > 0), 1) if low == high else good & (counts > 0))
        return pa.table({"x": pages[0].take(pa.array(x)), "y": pages[1].take(pa.array(y)), "common": pa.array(counts[x, y], pa.int64()), "total": pa.array(total[x, y], pa.int64())})

    kind = sets.schema["page_id"].dataType.simpleString()
    dealt = sets.withColumn("block", F.pmod(F.xxhash64("page_id", F.lit(1)), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = dealt.select(group, F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "page_id", "n", "lines")
    met = placed.repartition(parts, group, "low", "high").groupBy(group, "low", "high").applyInArrow(alike, f"x {kind}, y {kind}, common bigint, total bigint")
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "common", "total")


def _banded(lines: DataFrame, group: str, bands: int) -> DataFrame:
    """group, page_id, band, key: two smallest hashes of a page's lines in each band."""
    signed = lines.groupBy(group, "page_id").agg(*[F.min(F.xxhash64("line", F.lit(i))).alias(f"m{i}") for i in range(2 * bands)])
    keys = F.posexplode(F.array(*[F.xxhash64(f"m{2 * i}", f"m{2 * i + 1}") for i in range(bands)]))
    return signed.select(group, "page_id", keys.alias("band", "key"))


def alike_candidates(lines: DataFrame, group: str, bands: int = 32) -> DataFrame:
    """group, a, b: pages of a group that may share a third of their lines, by two smallest hashes in any of ``bands`` bands.

    Pages with a share s of their lines in common meet with 1 - (1 - s^2)^bands: 0.98 at a third, 0.27 at a tenth. A line that
    all pages have costs as many rows as it has places, whatever their number.
    """
    banded = _banded(lines, group, bands)
    a, b = banded.withColumnRenamed("page_id", "a"), banded.withColumnRenamed("page_id", "b")
    return a.join(b, [group, "band", "key"]).where("a < b").select(group, "a", "b").distinct()


def template_similarity(pages: DataFrame, group: str, least: float = 0.5, most_pages: float = 1.0, bands: int = 0) -> DataFrame:
    """a, b, lines in common, similarity (2 x common / all, each line once), label of pages of a group that share lines; very high above 0.85, substantial above ``least``.

    Pages meet by the hashes of their lines. ``most_pages`` leaves out lines on too large a share of a group's pages, where one wants that.
    With ``bands``, pages meet as ``alike_candidates`` instead, and only their lines are compared: lines on very many pages are no
    cost then, and about a fiftieth of the pairs just above the limit may be missed.
    In groups where so many pairs would meet that this moves more than all pages against all, they are compared in blocks, all of them.
    """
    one = pages.where(F.col(group).isNotNull() & F.col("page_id").isNotNull()).select(group, "page_id", _lines().alias("lines"))
    one = one.groupBy(group, "page_id").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines")).withColumn("n", F.size("lines").cast("bigint"))
    sets = written(one.where("n > 0"))
    if most_pages < 1:
        total = sets.groupBy(group).agg(F.count("*").alias("pages"))
        lines = sets.select(group, "page_id", "n", F.explode("lines").alias("line"))
        often = lines.groupBy(group, "line").agg(F.count("*").alias("k")).join(total, group).where(F.col("k") > F.col("pages") * most_pages)
        left = lines.join(often.select(group, "line"), [group, "line"], "left_anti")
        sets = written(left.groupBy(group, "page_id", "n").agg(F.collect_list("line").alias("lines")))
    lines = sets.select(group, "page_id", "n", F.explode("lines").alias("line"))
    places = _banded(lines, group, bands).groupBy(group, "band", "key") if bands else lines.groupBy(group, "line")
    pairs = places.agg(F.count("*").cast("double").alias("k")).groupBy(group).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("pairs"))
    size = sets.groupBy(group).agg(F.count("*").alias("pages"), F.sum(F.size("lines")).alias("places"))
    blocks = F.ceil(F.greatest(F.col("pages") / BLOCK_PAGES, F.col("places") / BLOCK_LINES))
    plan = written(pairs.join(size, group).withColumn("blocks", blocks).select(group, F.when(F.col("pairs") > F.col("places") * F.col("blocks"), F.col("blocks")).alias("blocks")))
    groups, meetings = plan.agg(F.count("*"), F.coalesce(F.sum(F.col("blocks") * (F.col("blocks") + 1) / 2), F.lit(0))).first()
    small = F.broadcast(plan) if groups <= 10_000 else plan
    dense, sparse = sets.join(small.where("blocks is not null"), group), lines.join(small.where("blocks is null").select(group), group)
    a, b = (sparse.select(group, F.col("page_id").alias(s), "line", F.col("n").alias(f"n_{s}")) for s in "ab")
    if bands:
        met = alike_candidates(sparse, group, bands).join(a, [group, "a"]).join(b, [group, "b", "line"])
    else:
        met = a.join(b, [group, "line"]).where("a < b")
    few = met.groupBy(group, "a", "b").agg(F.count("*").alias("common"), F.first(F.col("n_a") + F.col("n_b")).alias("total")).drop(group)
    # Some blocks a task, as many tasks as there are pairs of blocks at most.
    many = alike_in_blocks(dense, group, max(1, min(20_000, math.ceil(meetings / 2))), least)
    joined = few.unionByName(many).withColumn("similarity", 2 * F.col("common") / F.col("total"))
    label = F.when(F.col("similarity") > 0.85, "very high").otherwise("substantial")
    return joined.where(F.col("similarity") > least).select("a", "b", "common", "similarity", label.alias("label"))
