"""How the vocabulary of each source of a language diverges from that of its other sources.

A term is a run of letters A to Z or of characters beyond ASCII, in lower case (A to Z only). A task indexes its
documents in one pass: a block in memory holds postings (how often each source has a term) and in how many documents
a term stands; a full block leaves the task as a run sorted by term. Spark deals the runs out to hash shards and merges
them there with its external sort, and one pass over a shard adds up equal neighbours. What is left, one row a kept
term, is written; nothing after it reads a text.

Pairs of sources are compared over all kept terms without listing them: terms that a source lacks have one value, so
they are counted by frequency, and only terms that both sources have are corrected, a stream of postings at a time.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchlight.llm.common import new_folder, slices

#: Lower-cases A to Z, keeps a to z and all bytes of characters beyond ASCII, and turns the rest into blanks.
TERM_BYTES = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256)).lower()
#: Entries (term, source) of a block, about 200 bytes each.
BLOCK = 400_000
#: Bytes of a text that are cut into terms at once, and pairs of postings that are corrected at once.
PIECE, PAIRS = 1 << 22, 1 << 21
SCALE = 1_000_000_000
POSTINGS = "lang string, term string, n_docs bigint, postings array<struct<source: string, n: bigint>>"


def pieces(raw: bytes, most: int = PIECE):
    """A text's terms as slices of bytes, cut at blanks."""
    clean = raw.translate(TERM_BYTES)
    start = 0
    while len(clean) - start > most:
        end = clean.find(b" ", start + most)
        if end < 0:
            break
        yield clean[start:end]
        start = end
    yield clean[start:] if start else clean


class Block:
    """Postings in memory: for each language and source, occurrences and documents by term."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
        self.size = 0

    def add(self, lang: str, source: str, raw: bytes) -> None:
        occurrences, documents = self.groups[lang, source]
        before, own = len(documents), set()
        for piece in pieces(raw):
            terms = piece.split()
            occurrences.update(terms)
            own.update(terms)
        documents.update(own)
        self.size += len(documents) - before

    def run(self, rows: int = 1 << 14):
        """The block as record batches sorted by language and term; the block is empty afterwards."""
        by_lang: dict[str, list[tuple[str, Counter, Counter]]] = defaultdict(list)
        for (lang, source), counted in sorted(self.groups.items()):
            by_lang[lang].append((source, *counted))
        self.__init__()
        for lang, held in sorted(by_lang.items()):
            terms = pa.array([term for _, occurrences, _ in held for term in occurrences], pa.binary())
            if not len(terms):
                continue
            order = pc.array_sort_indices(terms)  # stable: a term's sources stay in their order
            terms = terms.take(order)
            n = pa.array([n for _, occurrences, _ in held for n in occurrences.values()], pa.int64()).take(order)
            n_docs = np.array([x for _, occurrences, documents in held for x in map(documents.__getitem__, occurrences)], np.int64)[order.to_numpy()]
            source = pa.array(np.repeat(np.arange(len(held)), [len(occurrences) for _, occurrences, _ in held])).take(order)
            apart = pc.not_equal(terms.slice(1), terms.slice(0, len(terms) - 1)).to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.flatnonzero(apart) + 1])
            inner = pa.StructArray.from_arrays([pa.array([s for s, _, _ in held], pa.string()).take(source), n], ["source", "n"])
            postings = pa.ListArray.from_arrays(np.append(starts, len(terms)).astype(np.int32), inner)
            whole = pa.RecordBatch.from_arrays([pa.array([lang], pa.string()).take(pa.array(np.zeros(len(starts), np.int64))), terms.take(pa.array(starts)).cast(pa.string()), pa.array(np.add.reduceat(n_docs, starts)), postings], ["lang", "term", "n_docs", "postings"])
            for at in range(0, len(starts), rows):
                yield whole.slice(at, rows)


def unpacked(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Rows of POSTINGS as terms (lang, term, n_docs, number of postings) and their postings (source, n), one after the other."""
    held = batch.column(3)
    terms = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), held.value_lengths().cast(pa.int64())], ["lang", "term", "n_docs", "size"])
    return terms, pa.RecordBatch.from_arrays(held.flatten().flatten(), ["source", "n"])


def packed(terms: pa.RecordBatch, postings: pa.RecordBatch) -> pa.RecordBatch:
    """What ``unpacked`` took apart."""
    offsets = np.concatenate([[0], np.cumsum(terms.column(3).to_numpy())]).astype(np.int32)
    inner = pa.StructArray.from_arrays(postings.columns, ["source", "n"])
    return pa.RecordBatch.from_arrays([*terms.columns[:3], pa.ListArray.from_arrays(offsets, inner)], ["lang", "term", "n_docs", "postings"])


def first_of_each(batch: pa.RecordBatch) -> np.ndarray:
    """Where each term begins in rows sorted by language and term."""
    n = batch.num_rows
    apart = [pc.not_equal(batch.column(i).slice(1), batch.column(i).slice(0, n - 1)).to_numpy(zero_copy_only=False) for i in (0, 1)]
    return np.concatenate([[0], np.flatnonzero(apart[0] | apart[1]) + 1])


def added_up(terms: pa.RecordBatch, postings: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """One row a term of rows sorted by language and term; its postings by source, each source once."""
    starts = first_of_each(terms)
    of_row = np.repeat(np.arange(len(starts)), np.diff([*starts, terms.num_rows]))
    names = postings.column(0).dictionary_encode()
    order = pc.array_sort_indices(names.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    code = np.repeat(of_row, terms.column(3).to_numpy()) * len(order) + rank[names.indices.to_numpy()]
    by_code = np.argsort(code, kind="stable")
    code = code[by_code]
    first = np.flatnonzero(np.diff(code, prepend=-1))
    of_term, source = np.divmod(code[first], max(len(order), 1))
    size = np.bincount(of_term, minlength=len(starts))
    places = pa.array(starts)
    terms = pa.RecordBatch.from_arrays([terms.column(0).take(places), terms.column(1).take(places), pa.array(np.add.reduceat(terms.column(2).to_numpy(), starts)), pa.array(size, pa.int64())], terms.schema.names)
    return terms, pa.RecordBatch.from_arrays([names.dictionary.take(pa.array(order[source])), pa.array(np.add.reduceat(postings.column(1).to_numpy()[by_code], first))], ["source", "n"])


def chosen(terms: pa.RecordBatch, postings: pa.RecordBatch, which: np.ndarray) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    return terms.filter(pa.array(which)), postings.filter(pa.array(np.repeat(which, terms.column(3).to_numpy())))


def index_runs(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Sorted runs of postings, one or more a task."""

    def run(batches):
        held = Block()
        for batch in (own for b in batches for own in slices(b, 2)):
            for lang, source, text in zip(*(column.to_pylist() for column in batch.columns)):
                held.add(lang, source, text)
                if held.size >= block:
                    yield from held.run()
        yield from held.run()

    return docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(run, POSTINGS)


def merge_runs(runs: DataFrame, least_docs: int) -> DataFrame:
    """One row a term that stands in ``least_docs`` documents of its language; postings in the order of sources.

    Rows of a term are as many as runs that hold it: common terms meet as often in every shard. Of terms that lie within a
    batch, those in too few documents are left out first; the rest of a batch is added up as arrays.
    """

    def likely(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of the first and the last term, which neighbouring batches may have too, and of terms in enough documents."""
        if batch.num_rows < 3:
            return batch
        starts = first_of_each(batch)
        enough = np.add.reduceat(batch.column(2).to_numpy(), starts) >= least_docs
        enough[[0, -1]] = True
        return batch.filter(pa.array(np.repeat(enough, np.diff([*starts, batch.num_rows]))))

    def run(batches):
        held = None  # the last term, which may go on in the next batch
        for batch in map(likely, batches):
            if not batch.num_rows:
                continue
            rows = unpacked(batch)
            terms, postings = added_up(*(map(pa.concat_batches, zip(held, rows)) if held else rows))
            last = np.arange(terms.num_rows) == terms.num_rows - 1
            held = chosen(terms, postings, last)
            whole = chosen(terms, postings, ~last & (terms.column(2).to_numpy() >= least_docs))
            if whole[0].num_rows:
                yield packed(*whole)
        if held and held[0].column(2)[0].as_py() >= least_docs:
            yield packed(*held)

    return runs.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(run, POSTINGS)


def share(n: Column, total: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / total) in long arithmetic: SCALE is three digits of 1000, so no product overflows below 9e15."""
    whole, rest = F.lit(0).cast("bigint"), n + 1
    divide = lambda a, b: F.call_function("div", a, b)
    whole, rest = divide(rest, total), rest % total
    for _ in range(3):
        whole, rest = whole * 1000 + divide(rest * 1000, total), (rest * 1000) % total
    return whole + 1


def gap(p, q):
    """floor((p - q)^2 / q), of columns or arrays of longs."""
    return F.call_function("div", (p - q) * (p - q), q) if isinstance(p, Column) else (p - q) * (p - q) // q


def corrections(posted: DataFrame) -> DataFrame:
    """lang, source, other, value: over the terms that both have, what their own values add to those with one side at zero.

    ``posted`` has a term's postings with p (the source's value) and p0 (its value of terms it lacks). Pairs are made and summed in
    slices of PAIRS in a task; only sums by pair leave it.
    """

    def run(batches):
        for batch in batches:
            held = batch.column(1)
            starts = held.offsets.to_numpy().astype(np.int64)
            first = int(starts[0])
            values = held.values.slice(first, int(starts[-1]) - first)
            starts = starts - first
            names = values.field(0).dictionary_encode()
            p, p0 = (values.field(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            lengths = np.diff(starts)
            langs = batch.column(0).dictionary_encode()
            of_term = np.repeat(np.arange(len(lengths)), lengths)
            lang, name, size = np.asarray(langs.indices)[of_term].astype(np.int64), np.asarray(names.indices).astype(np.int64), lengths[of_term]
            edges = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // PAIRS)) + 1).tolist(), len(size)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                left = np.repeat(np.arange(a, b), size[a:b])
                ends = np.cumsum(size[a:b])
                right = np.repeat(starts[:-1][of_term[a:b]], size[a:b]) + np.arange(len(left)) - np.repeat(ends - size[a:b], size[a:b])
                apart = left != right
                left, right = left[apart], right[apart]
                value = gap(p[left], p[right]) - gap(p[left], p0[right]) - gap(p0[left], p[right]) + gap(p0[left], p0[right])
                code = (lang[left] * len(names.dictionary) + name[left]) * len(names.dictionary) + name[right]
                pairs, place = np.unique(code, return_inverse=True)
                sums = np.zeros(len(pairs), np.int64)
                np.add.at(sums, place, value)
                rest, other = np.divmod(pairs, len(names.dictionary))
                of_lang, own = np.divmod(rest, len(names.dictionary))
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(of_lang)), names.dictionary.take(pa.array(own)), names.dictionary.take(pa.array(other)), pa.array(sums)], ["lang", "source", "other", "value"])

    return posted.select("lang", "postings").mapInArrow(run, "lang string, source string, other string, value bigint")


def source_divergence(docs: DataFrame, *, least_docs: int = 3, top: int = 200, block: int = BLOCK) -> DataFrame:
    """Per language and source: ``pair`` rows (each other source, ranked by the sum over all kept terms of floor((p-q)^2/q)) and
    ``term`` rows (its ``top`` terms above the language's share): lang, source, part, item, value, rank.

    Null text, lang and source are ''. A repeated row is another document. A group without kept terms has the share of terms
    at zero; a language without kept terms gives pairs of value 0. Ties go by item, in UTF-8 order. An empty table gives no row.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    folder = new_folder(spark, "divergence-terms")
    merge_runs(index_runs(docs, block), least_docs).write.parquet(folder)
    kept = spark.read.schema(POSTINGS).parquet(folder)

    # One row a group or language from here on.
    groups = docs.select("lang", "source").distinct()
    by_source = kept.select("lang", "term", F.aggregate("postings", F.lit(0).cast("bigint"), lambda t, x: t + x["n"]).alias("n_lang"), F.explode("postings").alias("x")).select("lang", "term", "n_lang", "x.source", "x.n")
    sums = by_source.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("used"))
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum(F.aggregate("postings", F.lit(0).cast("bigint"), lambda t, x: t + x["n"])).alias("lang_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    known = groups.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left").select("lang", "source", *(zero(c) for c in ("total", "used", "v", "lang_total")))
    folder = new_folder(spark, "divergence-groups")
    known.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0).cast("bigint"), F.col("total") + F.col("v")))).write.parquet(folder)
    known = spark.read.schema("lang string, source string, total bigint, used bigint, v bigint, lang_total bigint, p0 bigint").parquet(folder)

    valued = by_source.join(known, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total") + F.col("v")))
    q = share(F.col("n_lang"), F.col("lang_total") + F.col("v"))
    above = valued.withColumn("q", q).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))

    # How many terms of a source have each value; of p0 those that it lacks.
    levels = valued.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("m"))
    lacking = known.where("v > 0").select("lang", "source", F.col("p0").alias("p"), "p0", (F.col("v") - F.col("used")).alias("m"))
    other = known.select("lang", F.col("source").alias("other"), F.col("p0").alias("o0"))
    met = levels.unionByName(lacking).join(other, "lang").where("source != other")
    forth = met.select("lang", "source", "other", (F.col("m") * gap(F.col("p"), F.col("o0"))).alias("value"))
    met = levels.join(other, "lang").where("source != other")
    back = met.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), (F.col("m") * (gap(F.col("o0"), F.col("p")) - gap(F.col("o0"), F.col("p0")))).alias("value"))
    posted = valued.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("postings"))
    every = known.join(other, "lang").where("source != other").select("lang", "source", "other", F.lit(0).cast("bigint").alias("value"))
    pairs = every.unionByName(forth).unionByName(back).unionByName(corrections(posted)).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    return ranked(pairs).unionByName(ranked(above).where(F.col("rank") <= top))


#: The same by dense tables of all terms and groups of a language.
SQL = """
WITH d AS (SELECT coalesce(lang, '') lang, coalesce(source, '') source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') terms FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) term FROM d) GROUP BY 1, 2 HAVING count(*) >= 3),
counted AS (SELECT lang, source, term, count(*) n FROM (SELECT lang, source, unnest(terms) term FROM d) GROUP BY 1, 2, 3),
groups AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) n FROM groups g JOIN kept k ON k.lang = g.lang
    LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::HUGEINT p FROM dense),
whole AS (SELECT lang, term, sum(n) n FROM dense GROUP BY 1, 2),
q AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT q FROM whole),
pairs AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(v, 0)::BIGINT AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source != b.source
    LEFT JOIN (SELECT x.lang, x.source, y.source other, sum(((x.p - y.p) * (x.p - y.p)) // y.p) v FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY 1, 2, 3) s
    ON s.lang = a.lang AND s.source = a.source AND s.other = b.source),
terms AS (SELECT p.lang, source, 'term' part, p.term item, (((p - q) * (p - q)) // q)::BIGINT AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p > q)
SELECT lang, source, part, item, value, rank FROM (
    SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
"""
