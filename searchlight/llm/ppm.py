"""Language-model scores by prediction by partial matching (PPM), pretrained on the corpus.

A text is read as its words in lower case with one blank between them and an end. The model is a trie of byte
contexts: each byte is predicted from up to ``order`` bytes before it, across words and back to the text's
beginning. Escapes follow method C (the escape counts as often as a context has different successors), and a symbol
that a longer context knows is excluded from the shorter ones. A text's score is the log10 probability of all
its bytes.

A gram is a context with its symbol, as one number. Each task adds its grams up before one shuffle sums them. If the
trie has at most ``max_model`` counts it is broadcast. Else it stays a table: each task's texts are cut into chunks
of at most ``CHUNK`` bytes, the chunks' distinct grams are scored by one join an order, and each chunk meets its
scores. The base score's unigrams are counted and looked up alike: the ``table_size`` most frequent words are
broadcast, the others of a text go through a join.
"""

from __future__ import annotations

from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from searchlight.llm.common import materialised, slices

END = b"\n"
ORDER = 5
#: Distinct words, and grams, that a task holds before it passes them on; bytes of the texts of a chunk, and of those scored at once.
MOST_WORDS, MOST_GRAMS, CHUNK, SLICE = 400_000, 2_000_000, 16 << 20, 1 << 20
#: Where a gram has its order (the bytes of its context); its bytes stand below, the symbol lowest.
TOP = np.uint64(56)


def events(texts: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The longest gram of every predicted byte, text after text, and how many each text has.

    A text begins with its END byte as context and is closed by it.
    """
    parts = [END + b" ".join(text.lower().split()) + END for text in texts]
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    begins = np.cumsum(sizes) - sizes
    # Every eight bytes as a number, the last one lowest.
    codes = np.ndarray(int(sizes.sum()), ">u8", bytes(7) + b"".join(parts), strides=(1,)).astype(np.uint64)
    codes &= np.uint64((1 << 8 * (order + 1)) - 1)
    codes |= np.uint64(order) << TOP
    for j in range(order):
        at = begins[sizes > j] + j
        codes[at] = codes[at] & np.uint64((1 << 8 * (j + 1)) - 1) | np.uint64(j) << TOP
    return np.delete(codes, begins), sizes - 1


def shorter(codes: np.ndarray) -> np.ndarray:
    """The grams without their oldest context byte (order 1 or more)."""
    order = (codes >> TOP) - np.uint64(1)
    return (codes & ((np.uint64(1) << (np.uint64(8) * (order + np.uint64(1)))) - np.uint64(1))) | order << TOP


def context(codes: np.ndarray) -> np.ndarray:
    """A number for the context of each gram."""
    low = (np.uint64(1) << TOP) - np.uint64(1)
    return (codes & ~low) | (codes & low) >> np.uint64(8)


def summed(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, distinct = pd.factorize(codes)
    return distinct, np.bincount(at, counts, len(distinct)).astype(np.int64)


def all_orders(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams and all their shorter ones, with their counts."""
    parts = [(codes, counts)]
    while len(codes):
        keep = codes >> TOP > 0
        codes, counts = summed(shorter(codes[keep]), counts[keep])
        parts.append((codes, counts))
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


class Trie:
    """The counts of grams (in ascending order) with what the escapes need: for each context its total, its number of symbols and
    the total that its symbols have in the next shorter context."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        at = np.argsort(codes)
        self.codes, self.counts = codes[at], counts[at]
        self.contexts, index = np.unique(context(self.codes), return_inverse=True)
        self.total = np.bincount(index, self.counts, len(self.contexts))
        self.symbols = np.bincount(index, minlength=len(self.contexts)).astype(float)
        self.below = np.zeros(len(self.contexts))
        deep = self.codes >> TOP > 0
        np.add.at(self.below, index[deep], self.find(shorter(self.codes[deep])))

    def find(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes))
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.counts[at], 0)

    def log10(self, codes: np.ndarray) -> np.ndarray:
        """The log10 probability of each gram's symbol after its context."""
        out = np.zeros(len(codes))
        todo = np.argsort(codes)  # neighbours in the trie are looked up one after the other
        codes = codes[todo]
        less_total, less_symbols = np.zeros(len(codes)), np.zeros(len(codes))
        while len(todo):
            c = context(codes)
            at = np.minimum(np.searchsorted(self.contexts, c), max(len(self.contexts) - 1, 0))
            known = self.contexts[at] == c if len(self.contexts) else np.zeros(len(c), bool)
            total = np.where(known, self.total[at] if len(self.contexts) else 0, 0) - np.where(known, less_total, 0)
            symbols = np.where(known, self.symbols[at] if len(self.contexts) else 0, 0) - np.where(known, less_symbols, 0)
            count = np.where(known, self.find(codes), 0)
            open_ = known & (total + symbols > 0)
            seen = count > 0
            share = np.where(seen, count, symbols)[open_] / (total + symbols)[open_]
            out[todo[open_]] += np.log10(share)
            less_total = np.where(known, self.below[at] if len(self.contexts) else 0, less_total)
            less_symbols = np.where(known, self.symbols[at] if len(self.contexts) else 0, less_symbols)
            left = ~seen
            final = left & (codes >> TOP == 0)
            out[todo[final]] -= np.log10(np.maximum(256 - less_symbols[final], 1))
            left &= ~final
            codes, todo, less_total, less_symbols = shorter(codes[left]), todo[left], less_total[left], less_symbols[left]
        return out


def text_scores(texts: list[bytes], log10, order: int = ORDER) -> np.ndarray:
    """The score of each text; ``log10`` gives those of distinct grams."""
    codes, sizes = events(texts, order)
    at, distinct = pd.factorize(codes)
    return np.bincount(np.repeat(np.arange(len(texts)), sizes), log10(distinct)[at], len(texts))


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, text as bytes, held_out (crc32 of the id as text leaves 2 modulo 7; false for a null id)."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), held.alias("held_out"))


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n_train, n) over all texts of ``marked`` documents; the end of a text counts as the word ``END``."""

    def give(train: Counter, rest: Counter):
        words = list(train.keys() | rest.keys())
        return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()), pa.array([train[w] + rest[w] for w in words], pa.int64())], ["word", "n_train", "n"])

    def run(batches):
        train: Counter = Counter()
        rest: Counter = Counter()
        for batch in batches:
            for value, held in zip(batch.column(0), batch.column(1).to_pylist()):
                into = rest if held else train
                into.update(value.as_py().lower().split())
                into[END] += 1
                if len(train) + len(rest) > MOST_WORDS:
                    yield give(train, rest)
                    train.clear()
                    rest.clear()
        yield give(train, rest)

    parts = docs.select("text", "held_out").mapInArrow(run, "word binary, n_train bigint, n bigint")
    return parts.groupBy("word").agg(F.sum("n_train").alias("n_train"), F.sum("n").alias("n"))


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, n): the trie's counts from the texts of ``marked`` documents that are not held out."""

    def run(batches):
        held: list[tuple] = []

        def merged():
            codes, counts = summed(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held.clear()
            return codes, counts

        give = lambda codes, counts: pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(counts)], ["code", "n"])
        size = 0
        for batch in (own for batch in batches for own in slices(batch, 0, SLICE)):
            held.append(np.unique(events(batch.column(0).to_pylist(), order)[0], return_counts=True))
            size += len(held[-1][0])
            if size > MOST_GRAMS:
                held.append(merged())
                size = len(held[0][0])
            if size > MOST_GRAMS // 2:
                yield give(*held.pop())
                size = 0
        if held:
            yield give(*merged())

    longest = docs.where("not held_out").select("text").mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))
    parts = F.expr("transform(sequence(0L, shiftrightunsigned(code, 56)), j -> (code & ((1L << cast(8 * (j + 1) as int)) - 1)) | (j << 56))")
    return longest.select(F.explode(parts).alias("code"), "n").groupBy("code").agg(F.sum("n").alias("n"))


def _order(code: str) -> Column:
    return F.shiftrightunsigned(code, 56)


def _context(code: str) -> Column:
    return F.expr(f"(shiftrightunsigned({code}, 56) << 56) | shiftrightunsigned({code} & {(1 << 56) - 1}L, 8)")


def _shorter(code: str) -> Column:
    return F.expr(f"((shiftrightunsigned({code}, 56) - 1) << 56) | ({code} & ((1L << cast(8 * shiftrightunsigned({code}, 56) as int)) - 1))")


def score_grams(codes: DataFrame, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """(code, p) for the distinct grams in column code: what ``Trie.log10`` gives, by one pair of joins an order."""
    lower = grams.select(F.col("code").alias("short"), F.col("n").alias("below"))
    stats = grams.withColumns({"context": _context("code"), "short": F.when(_order("code") > 0, _shorter("code"))}).join(lower, "short", "left")
    stats = materialised(stats.groupBy("context").agg(F.sum("n").cast("double").alias("total"), F.count("*").cast("double").alias("symbols"), F.coalesce(F.sum("below"), F.lit(0)).cast("double").alias("below")))
    todo = codes.select("code", F.col("code").alias("at"), F.lit(0.0).alias("p"), F.lit(0.0).alias("less_total"), F.lit(0.0).alias("less_symbols"))
    done = None
    for k in range(order, -1, -1):
        now = todo.where(_order("at") == k).withColumn("context", _context("at")).join(stats, "context", "left").join(grams.select(F.col("code").alias("at"), "n"), "at", "left")
        known, total, symbols = F.col("total").isNotNull(), F.col("total") - F.col("less_total"), F.col("symbols") - F.col("less_symbols")
        share = F.coalesce(F.when(total + symbols > 0, F.log10(F.coalesce("n", symbols) / (total + symbols))), F.lit(0.0))
        now = now.select("code", "at", (F.col("p") + share).alias("p"), F.when(known, F.col("below")).otherwise(F.col("less_total")).alias("less_total"), F.when(known, F.col("symbols")).otherwise(F.col("less_symbols")).alias("less_symbols"), F.col("n").isNotNull().alias("seen"))
        now = materialised(now)
        last = F.when(F.col("seen"), F.col("p")).otherwise(F.col("p") - F.log10(F.greatest(256 - F.col("less_symbols"), F.lit(1.0))))
        ended = now.where("seen").select("code", "p") if k else now.select("code", last.alias("p"))
        done = ended if done is None else done.unionByName(ended)
        todo = todo.where(_order("at") < k).unionByName(now.where("not seen").withColumn("at", _shorter("at")).drop("seen")) if k else None
        todo = materialised(todo) if k else None
    return done


def add_scores_apart(rows: DataFrame, grams: DataFrame, order: int = ORDER) -> DataFrame:
    """rows (with the column text, which goes) with the column score, without a broadcast trie: chunks of texts give their distinct grams and get the scores of these."""
    names = [f.name for f in rows.schema if f.name != "text"]
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", score double"

    def cut(batches):
        own = number = 0
        for batch in (own for batch in batches for own in slices(batch, batch.schema.get_field_index("text"))):
            number, own = (number + 1, 0) if own > CHUNK else (number, own + batch.nbytes)
            yield batch.append_column("number", pa.array(np.full(batch.num_rows, number)))

    chunks = rows.mapInArrow(cut, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", number bigint")
    chunks = materialised(chunks.withColumn("chunk", F.spark_partition_id() * F.lit(1 << 32) + F.col("number")).drop("number"))

    def give(batches):
        for batch in (own for batch in batches for own in slices(batch, 1, SLICE)):
            chunk = batch.column(0).to_numpy()
            for c in np.unique(chunk):
                codes = np.unique(events(batch.column(1).filter(pa.array(chunk == c)).to_pylist(), order)[0])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), c)), pa.array(codes.view(np.int64))], ["chunk", "code"])

    wanted = materialised(chunks.select("chunk", "text").mapInArrow(give, "chunk bigint, code bigint").distinct())
    scored = wanted.join(score_grams(wanted.select("code").distinct(), grams, order), "code")

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        codes, p = known["code"].to_numpy().view(np.uint64), known["p"].to_numpy()
        at = np.argsort(codes)
        codes, p = codes[at], p[at]
        found = text_scores(texts["text"].to_pylist(), lambda c: p[np.searchsorted(codes, c)], order) if texts.num_rows else np.zeros(0)
        return texts.select(names).append_column("score", pa.array(found))

    return chunks.groupBy("chunk").cogroup(scored.groupBy("chunk")).applyInArrow(score, types)


def frequent(words: DataFrame, most: int) -> DataFrame:
    """The most frequent words, at most ``most``: those from a frequency on that a histogram of frequencies gives, without a sort."""
    steps = words.groupBy(F.floor(F.log2("n") * 16).alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()  # at most 16 rows a doubling
    total, least = 0, None
    for step, n in steps:
        total += n
        if total > most:
            break
        least = step
    return words.where(F.lit(False)) if least is None else words.where(F.floor(F.log2("n") * 16) >= least)


def score_documents(docs: DataFrame, *, order: int = ORDER, table_size: int = 200_000, longest: int = 64, max_model: int = 6_000_000) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words in lower case (ASCII) and one end; null and empty texts have only the end. base_score is the
    add-one unigram score, score the PPM model's log10 probability of the words with a blank between them and the end.
    An empty training part makes every token unknown. Equal rows are scored alike; other columns are ignored. The
    broadcast table holds words of at most ``longest`` bytes, which bounds its size.
    """
    spark = docs.sparkSession
    source = marked(docs)
    words = materialised(count_words(source))
    n, v = words.where("n_train > 0").agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count("*")).first()
    table = spark.sparkContext.broadcast(frequent(words.where(F.octet_length("word") <= longest), table_size).select("word", "n_train").toArrow().to_pydict())
    scale = float(np.log10(n + v + 1))
    grams = materialised(count_grams(source, order))
    model = None
    if grams.count() <= max_model:
        found = grams.toArrow()
        model = spark.sparkContext.broadcast((found["code"].to_numpy().astype(np.int64).view(np.uint64), found["n"].to_numpy().astype(np.int64)))
        del found

    def run(batches):
        number = {w: i for i, w in enumerate(table.value["word"])}
        counts = np.array(table.value["n_train"], float)
        base, known = np.log10(counts + 1), counts > 0
        trie = Trie(*model.value) if model else None
        for batch in (own for batch in batches for own in slices(batch, 1, SLICE)):
            rows, texts = [], batch.column(1).to_pylist()
            for text in texts:
                tokens = text.lower().split()
                tokens.append(END)
                ids = np.fromiter(map(number.get, tokens, repeat(-1)), np.int64, len(tokens))
                found = ids[ids >= 0]
                rare = Counter(tokens[i] for i in np.flatnonzero(ids < 0)) if len(found) < len(ids) else {}
                rows.append((len(tokens), int(known[found].sum()), float(base[found].sum()) - scale * len(tokens), [{"word": w, "times": t} for w, t in rare.items()]))
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("times", pa.int64())])))
            last = pa.array(text_scores(texts, trie.log10, order)) if model else batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *map(pa.array, columns, kinds), last], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "rare", "score" if model else "text"])

    rows = source.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, rare array<struct<word:binary,times:bigint>>, " + ("score double" if model else "text binary"))
    if not model:
        rows = add_scores_apart(materialised(rows), grams, order)
    rows = materialised(rows.withColumn("row", F.monotonically_increasing_id()))
    rare = rows.select("row", F.inline("rare")).join(words.select("word", "n_train"), "word")
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("n_train") > 0, F.col("times")).otherwise(0)).alias("k"), F.sum(F.col("times") * F.log10(F.col("n_train") + 1.0)).alias("b"))
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return rows.join(more, "row", "left").select("doc_id", "held_out", "n_tokens", plus("n_known", "k"), F.lit(n).cast("bigint").alias("train_tokens"), plus("base_score", "b"), "score")
