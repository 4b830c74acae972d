"""Quality rules: counts by fixed rules, and an n-gram log-likelihood ratio between two multinomials.

Words and word pairs are hashed to ``buckets`` buckets. One multinomial is estimated from all documents,
the other from trusted documents (all that are labelled good and not toxic). A document's score is the mean, over its n-grams, of the log ratio of the two
probabilities, and it is kept if the score reaches a threshold: the same text always gets the same
verdict. Half the trusted documents make the multinomial and the other half, which it has not seen, the
threshold: ``deviations`` standard deviations below their mean score. Each task adds its n-grams up before anything is shuffled, and
the model has a fixed size.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlight.llm.common import materialised, slices, texts
from searchlight.llm.repeats import among, screened

BUCKET_BITS = 16
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Standard deviations of trusted documents' scores that a document may lie below their mean, and the places to which the threshold
#: is rounded (sums of floating-point numbers depend on their order in the last places).
DEVIATIONS, PLACES = 3.3, 6
#: N-grams that a task holds before it adds them up.
MOST_WAITING = 1 << 18
#: Odd multipliers of the hash of a pair; fixed values.
MULTIPLY_A, MULTIPLY_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """A number for each word, equal for equal words, and the distinct words in the order of their numbers."""
    distinct = list(dict.fromkeys(words))
    number = dict(zip(distinct, range(len(distinct))))
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words)), distinct


def ngram_buckets(ids: np.ndarray, distinct: list[bytes]) -> np.ndarray:
    """The buckets of all words and of all pairs of neighbours, in lower case."""
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(bytes.lower, distinct)), np.uint64, len(distinct))[ids]
    pairs = h[:-1] * MULTIPLY_A + h[1:]
    return (np.concatenate([h, pairs]) * MULTIPLY_B) >> np.uint64(64 - BUCKET_BITS)


def repeat_words(ids: np.ndarray, n_distinct: int) -> int:
    """How many words lie in a window of three words that occurs twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    if n_distinct < 1 << 20:
        codes = (ids[:-2] * n_distinct + ids[1:-1]) * n_distinct + ids[2:]
    else:
        codes = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)[1][:-1] * n_distinct + ids[2:]
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    again = np.zeros(n - 2, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= again
    return int(inside.sum())


def rule_counts(text: bytes, words: list[bytes], ids: np.ndarray, n_distinct: int) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    characters = sum(len(w) for w in words) if text.isascii() else len(b"".join(words).decode())
    lines = [line for line in text.split(b"\n") if line.split()] if b"\n" in text else ()
    return len(words), characters, len(text.translate(None, NOT_SYMBOLS)), len(lines) - len(set(lines)), repeat_words(ids, n_distinct)


class Model(NamedTuple):
    ratio: np.ndarray
    least_score: float


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The distinct ids (trusted_id) of all documents labelled quality 1 and not toxic 1, and their half (0 or 1)."""
    good = labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    ids = good.select(F.col("doc_id").cast("bigint").alias("trusted_id")).distinct()
    return ids.withColumn("half", F.pmod(F.crc32(F.col("trusted_id").cast("string").cast("binary")), F.lit(2)))


def marked(rows: DataFrame, ids: DataFrame, few: bool) -> DataFrame:
    """rows (doc_id, text) with ``trusted``: whether doc_id is in ids (trusted_id). Few ids are broadcast; else only rows that a screen of the ids hits are moved."""
    told = lambda df, ids: df.join(ids, F.col("doc_id") == F.col("trusted_id"), "left").select("doc_id", "text", F.col("trusted_id").isNotNull().alias("trusted"))
    if few:
        return told(rows, F.broadcast(ids))
    hits = screened(rows, ids.select(F.col("trusted_id").alias("doc_id")), "doc_id")
    return told(hits.where("hit"), ids).unionByName(hits.where("not hit").select("doc_id", "text", F.lit(False).alias("trusted")))


def fit_ratio(docs: DataFrame, trusted: DataFrame, few: bool, *, smoothing: float = 1.0) -> np.ndarray:
    """The log ratio of trusted over all documents for each bucket; zeros if there is no trusted document."""
    size = 1 << BUCKET_BITS

    def run(batches):
        sums = {False: np.zeros(size, np.int64), True: np.zeros(size, np.int64)}
        held: dict[bool, list] = {False: [], True: []}

        def add(trusted: bool) -> None:
            if held[trusted]:
                sums[trusted] += np.bincount(np.concatenate(held[trusted]).astype(np.int64), minlength=size)
                held[trusted].clear()

        waiting = 0
        for batch in (own for batch in batches for own in slices(batch, 1)):
            for value, trusted in zip(batch.column(1), batch.column(2).to_pylist()):
                held[trusted].append(ngram_buckets(*numbered(value.as_py().split())))
                waiting += len(held[trusted][-1])
                if waiting > MOST_WAITING:
                    add(False)
                    add(True)
                    waiting = 0
        add(False)
        add(True)
        every, good = sums[False] + sums[True], sums[True]
        used = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(every[used]), pa.array(good[used])], ["bucket", "n", "n_good"])

    rows = marked(texts(docs), trusted.where("half = 0"), few)
    sums = rows.mapInArrow(run, "bucket bigint, n bigint, n_good bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("n_good").alias("g")).toPandas()
    every, good = np.zeros(size), np.zeros(size)
    every[sums["bucket"]], good[sums["bucket"]] = sums["n"], sums["g"]
    if not good.sum():
        return np.zeros(size)
    return np.log((good + smoothing) / (good.sum() + smoothing * size)) - np.log((every + smoothing) / (every.sum() + smoothing * size))


def score_text(text: bytes, ratio: np.ndarray) -> tuple:
    """The rule counts, base_failed, the mean log ratio (0 without words) of one text."""
    words = text.split()
    ids, distinct = numbered(words)
    counts = rule_counts(text, words, ids, len(distinct))
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
    return *counts, failed, float(ratio[ngram_buckets(ids, distinct)].mean()) if words else 0.0


def fit(docs: DataFrame, labels: DataFrame, *, most_broadcast: int = 1_000_000, deviations: float = DEVIATIONS) -> Model:
    """The log ratios and the threshold; without trusted documents in the second half there is none and the rules alone decide.

    All trusted documents count. Up to ``most_broadcast`` ids of theirs are broadcast; more are joined, with the same result.
    """
    trusted = materialised(trusted_ids(labels))
    few = trusted.count() <= most_broadcast
    ratio = docs.sparkSession.sparkContext.broadcast(fit_ratio(docs, trusted, few))
    ids = trusted.where("half = 1").select(F.col("trusted_id").alias("doc_id"))
    others = texts(docs).join(F.broadcast(ids), "doc_id", "left_semi") if few else among(texts(docs), ids, "doc_id")
    mean, spread = _scored(others, ratio).where("not base_failed").agg(F.mean("score"), F.stddev_pop("score")).first()
    return Model(ratio.value, float("-inf") if mean is None else round(mean - deviations * spread, PLACES))


def _scored(rows: DataFrame, ratio) -> DataFrame:
    def run(batches):
        for batch in (own for batch in batches for own in slices(batch, 1)):
            found = [score_text(value.as_py(), ratio.value) for value in batch.column(1)]
            columns = list(zip(*found)) or [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns[:5]] + [pa.array(columns[5], pa.bool_()), pa.array(columns[6], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    Null texts have no words, so they fail; with no trusted document all scores are zero and the rules alone decide.
    Equal rows are judged alike; other columns are ignored.
    """
    model = fit(docs, labels, **how)
    scored = _scored(texts(docs), docs.sparkSession.sparkContext.broadcast(model.ratio))
    kept = ~F.col("base_failed") & (F.col("score") >= model.least_score)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of docs that quality_scores keeps, with all their columns: none with a null or empty text, equal rows alike."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **how))
    at = docs.columns.index("text")

    def run(batches):
        for batch in (own for batch in batches for own in slices(batch, at)):
            found = [score_text((value.as_py() or "").encode(), model.value.ratio) for value in batch.column(at)]
            yield batch.filter(pa.array([not failed and score >= model.value.least_score for *_, failed, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
