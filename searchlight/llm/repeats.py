"""Passages that repeat across documents, found by recompression.

A text is a sequence of words, each named by a digest. A round replaces, in all texts alike, each pair (x, y) of neighbours
with x on the left side and y on the right side by one symbol, then each run of equal symbols by one symbol; sides are a
bit of the name, another one each round. A symbol's name is a digest of what it stands for, so equal symbols have equal names
in every task. How far a symbol's making looked around is kept as its context: two occurrences of a passage have the same
symbols wherever the contexts lie within the passage.

Symbols are used twice. One that spans a window or more and stands in a smaller document reveals and proves a repeat of all
its words. And each window of words has an anchor, the longest symbol whose context lies in the window: windows that are equal
have the same anchor, so only windows with shared anchors are compared, by a digest of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlight.llm.common import materialised, new_folder, slices

#: What separates words.
BLANKS = bytes(0x20 if b in b"\x20\x09\x0a\x0b\x0c\x0d" else b for b in range(256))
#: Odd multipliers of the mixing steps.
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
#: Bytes of a part of a long text, and of the texts that are parsed together.
PART, SLICE = 1 << 20, 1 << 21
#: Places of a screen.
BITS = 1 << 27
#: Rounds end when no text has two symbols left, or after so many.
ROUNDS = 200


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def named(left: np.ndarray, right: np.ndarray, salt: int) -> np.ndarray:
    """Names (two lanes a row) of pairs; of runs, where right is the count."""
    out = np.empty_like(left)
    out[0] = mixed(left[0] * M1 + mixed(right[0] + np.uint64(2 * salt + 1)))
    out[1] = mixed(left[1] * M3 + mixed(right[1] * M1 + np.uint64(2 * salt)))
    return out


class Parsed:
    """Symbols of some parts of texts (lists of words): their words' names, and what the rounds make of them."""

    def __init__(self, parts: list[list[bytes]]):
        sizes = np.array([len(words) for words in parts], np.int64)
        digest = xxhash.xxh3_128_digest
        self.words = np.frombuffer(b"".join([digest(w) for words in parts for w in words]), "<u8").reshape(-1, 2).T.copy()
        ends = np.cumsum(sizes)
        #: For each word, its part, and the part's first word and end.
        self.part = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
        self.first, self.last = (np.repeat(x, sizes).astype(np.int32) for x in (ends - sizes, ends))

    def rounds(self, most_rounds: int = ROUNDS) -> Iterator[tuple]:
        """Yields the symbols that each round makes: (names, begin, end, low, high); words begin to end, context low to high."""
        n = len(self.part)
        name, begin = self.words, np.arange(n, dtype=np.int32)
        end = begin + 1
        low, high = begin, end
        first_word = self.words[0]
        for k in range(most_rounds):
            part = self.part[begin]
            near = part[1:] == part[:-1]
            if not near.any():
                return
            # Pairs. What merges depends on the two alone; a left symbol that stays looked right, a right one left, and at
            # the edge of a part there is nothing, which no window shows.
            right = (mixed(name[0] + np.uint64(k * int(M1) % (1 << 64))) & np.uint64(1)).astype(bool)
            joins = near & ~right[:-1] & right[1:]
            at = np.flatnonzero(joins)
            next_high = np.where(near, np.maximum(high[:-1], high[1:]), self.last[begin[:-1]] + 1)
            next_low = np.where(near, np.minimum(low[:-1], low[1:]), self.first[begin[1:]] - 1)
            new_high = np.where(right, high, np.append(next_high, self.last[-1] + 1))
            new_low = np.where(right, np.concatenate([[np.int32(-1)], next_low]), low)
            pair = named(name[:, at], name[:, at + 1], k), begin[at], end[at + 1], np.minimum(low[at], low[at + 1]), np.maximum(high[at], high[at + 1])
            if len(at):
                yield pair
            kept = np.ones(len(begin), bool)
            kept[at + 1] = False
            place = at - np.arange(len(at))
            name, begin, end, low, high = name[:, kept], begin[kept], end[kept], new_low[kept], new_high[kept]
            name[:, place], end[place], low[place], high[place] = pair[0], *pair[2:]
            # Runs. A symbol differs from its neighbour if the words that meet their counterparts do; only where these are equal
            # the whole neighbour counts as looked at.
            part = self.part[begin]
            near = part[1:] == part[:-1]
            like = near & (name[0, 1:] == name[0, :-1]) & (name[1, 1:] == name[1, :-1])
            meets_left = np.where(near, np.where(first_word[begin[1:] - 1] != first_word[end[1:] - 1], begin[1:] - 1, low[:-1]), self.first[begin[1:]] - 1)
            meets_right = np.where(near, np.where(first_word[begin[1:]] != first_word[begin[:-1]], begin[1:] + 1, high[1:]), self.last[begin[:-1]] + 1)
            low = np.minimum(low, np.concatenate([[np.int32(-1)], meets_left]))
            high = np.maximum(high, np.append(meets_right, np.int32(n + 1)))
            if like.any():
                head = np.flatnonzero(np.concatenate([[True], ~like]))
                count = np.diff(np.append(head, len(begin)))
                end, low, high = end[head + count - 1], np.minimum.reduceat(low, head), np.maximum.reduceat(high, head)
                name, begin = name[:, head].copy(), begin[head]
                runs = np.flatnonzero(count > 1)
                name[:, runs] = named(name[:, runs], np.vstack([count[runs]] * 2).astype(np.uint64), ROUNDS + k)
                yield name[:, runs], begin[runs], end[runs], low[runs], high[runs]

    def symbols(self, window: int) -> tuple[np.ndarray, np.ndarray, tuple]:
        """(windows, anchors, long): where windows start, the key of each one's anchor, and the symbols of a window's length or more.

        The anchor is the longest symbol whose context lies in the window, of equal ones the greatest name; its key holds both.
        """
        n = len(self.part)
        levels = max(1, int(window).bit_length())
        best = [np.zeros(n + window, np.uint64) for _ in range(levels)]

        def offer(name, begin, end, low, high):
            ok = np.flatnonzero((high - low <= window) & (low >= 0))
            begin, end, low, high = begin[ok], end[ok], low[ok].astype(np.int64), high[ok].astype(np.int64)
            value = (np.minimum(end - begin, 63).astype(np.uint64) << np.uint64(58)) | (name[0, ok] >> np.uint64(6))
            # Windows that start at high - window to low hold the context; two blocks of a power of two cover them.
            start = np.maximum(high - window, 0)
            level = np.frexp((low - start + 1).astype(np.float32))[1] - 1
            for q in np.unique(level).tolist():
                own = np.flatnonzero(level == q)
                np.maximum.at(best[q], start[own], value[own])
                np.maximum.at(best[q], low[own] + 1 - (1 << q), value[own])

        at = np.arange(n, dtype=np.int32)
        offer(self.words, at, at + 1, at, at + 1)
        long = []
        for event in self.rounds():
            if len(event[1]):
                offer(*event)
                wide = event[2] - event[1] >= window
                if wide.any():
                    long.append((event[0][:, wide], event[1][wide], event[2][wide]))
        for q in range(levels - 1, 0, -1):
            half = 1 << (q - 1)
            np.maximum(best[q - 1], best[q], out=best[q - 1])
            np.maximum(best[q - 1][half:], best[q][:-half], out=best[q - 1][half:])
        windows = np.flatnonzero(at + window <= self.last)
        found = tuple(np.concatenate([e[i] for e in long], axis=-1) for i in range(3)) if long else (np.zeros((2, 0), np.uint64), *[np.zeros(0, np.int32)] * 2)
        return windows, best[0][windows], found

    def digests(self, size: int) -> np.ndarray:
        """Two lanes for each word: the digest of the ``size`` words from there on (of what follows, where a part ends)."""
        power, total, done, width = self.words, None, 0, 1
        shifted = lambda x, by: np.concatenate([x[:, by:], np.zeros((2, min(by, x.shape[1])), np.uint64)], axis=1)
        while width <= size:
            if size & width:
                total = power if total is None else named(total, shifted(power, done), width)
                done += width
            power, width = named(power, shifted(power, width), ROUNDS * 2 + width), width * 2
        return total


def parts_of(raw: bytes, window: int, most: int = PART) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first word, words) of parts of a text that overlap by all but one word of a window, so each window is in one part."""
    clean, start, number, words = raw.translate(BLANKS), 0, 0, []
    while True:
        end = clean.find(b" ", start + most) if len(clean) - start > most else -1
        words += clean[start:end].split() if end >= 0 else clean[start:].split()
        if end < 0 or len(words) > window:
            yield number, words
        if end < 0:
            return
        start = end
        if len(words) > window:
            number += len(words) - window + 1
            words = words[len(words) - window + 1 :]


def parsed(batches, window: int, column: int = 1, part: int = PART):
    """(rows, offsets, Parsed): for groups of parts of the texts in that column, each part's row in the batch and first word."""
    for batch in (own for b in batches for own in slices(b, column, SLICE)):
        rows, offsets, parts, size = [], [], [], 0
        for i, raw in enumerate(batch.column(column)):
            for number, words in parts_of(raw.as_py(), window, part):
                rows.append(i)
                offsets.append(number)
                parts.append(words)
                size += len(words)
                if size * 6 > SLICE:
                    yield batch, np.array(rows), np.array(offsets), Parsed(parts)
                    rows, offsets, parts, size = [], [], [], 0
        if size:
            yield batch, np.array(rows), np.array(offsets), Parsed(parts)


def screened(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """df with ``hit``: false only if the row's ``column`` is not in ``ids``.

    The ids mark places in a bitmap of BITS bits, which is always as large (16 MB) and broadcast. Among n ids a share of about
    n / BITS of other rows is hit too; so what follows holds hits against the ids, and only moves fewer rows.
    """
    place = F.pmod(F.xxhash64(column), F.lit(BITS))
    bucket = lambda p: F.shiftright(p, 15)
    marks = ids.select(place.alias("p")).groupBy(bucket(F.col("p")).alias("__bucket")).agg(F.bitmap_construct_agg(F.pmod("p", F.lit(1 << 15))).alias("__bitmap"))
    rows = df.withColumn("__place", place).withColumn("__bucket", bucket(F.col("__place"))).join(F.broadcast(marks), "__bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(__bitmap, cast(shiftright(__place % 32768, 3) as int) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (F.col("__place") % 8).cast("int")) == 1, F.lit(False))
    return rows.withColumn("hit", hit).drop("__place", "__bucket", "__bitmap")


def among(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose ``column`` is in ``ids`` (distinct, written)."""
    return screened(df, ids, column).where("hit").drop("hit").join(ids, column, "left_semi")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def keys(docs: DataFrame, window: int, part: int = PART) -> DataFrame:
    """k1, k2, doc_id: anchors of windows (k2 is 0), and symbols of a window's length or more."""

    def run(batches):
        for batch, rows, _, parse in parsed(batches, window, 1, part):
            windows, anchors, (name, begin, _) = parse.symbols(window)
            row = rows[parse.part]
            own = row[windows]
            new = np.flatnonzero(np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (own[1:] != own[:-1])])[: len(windows)])
            ids = np.concatenate([own[new], row[begin]])
            yield pa.RecordBatch.from_arrays([signed(np.concatenate([anchors[new], name[0]])), signed(np.concatenate([np.zeros(len(new), np.uint64), name[1] | np.uint64(1)])), batch.column(0).take(pa.array(ids))], ["k1", "k2", "doc_id"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, "k1 bigint, k2 bigint, doc_id bigint")


def findings(docs: DataFrame, window: int, part: int = PART) -> DataFrame:
    """For docs with ``shared`` (keys that other documents have too) and ``less`` (those of symbols that a smaller document has):
    doc_id, crc, begin, end, h1, h2: spans that are repeats for certain (h1 null), and windows to compare.

    A window within such a span is left out: the smallest document that has it will bring it.
    """

    def run(batches):
        for batch, rows, offsets, parse in parsed(batches, window, 2, part):
            windows, anchors, (name, begin, end) = parse.symbols(window)
            n = len(parse.part)
            row = rows[parse.part]
            shared, less = ([np.asarray(c.values)[a:b].view(np.uint64) for a, b in zip(c.offsets.to_pylist(), c.offsets.to_pylist()[1:])] for c in (batch.column(3), batch.column(4)))
            # All keys are digests, so one set does for the rows of a group if it tells rows apart.
            tag = mixed(np.arange(batch.num_rows, dtype=np.uint64) + np.uint64(1))
            mine = lambda found, used: np.concatenate([found[i] ^ tag[i] for i in used] or [np.zeros(0, np.uint64)])
            used = np.unique(rows)
            known = np.isin((name[0] ^ mixed(name[1] | np.uint64(1))) ^ tag[row[begin]], mine(less, used))
            begin, end = begin[known], end[known]
            reach = np.zeros(n, np.int64)
            np.maximum.at(reach, begin, end)
            reach = np.maximum.accumulate(reach)
            open_ = (reach[windows] < windows + window) & np.isin(anchors ^ tag[row[windows]], mine(shared, used))
            windows = windows[open_]
            digest = parse.digests(window)[:, windows] if len(windows) else np.zeros((2, 0), np.uint64)
            at = np.concatenate([begin, windows]).astype(np.int64)
            shift = offsets[parse.part[at]] - parse.first[at]
            none = np.arange(len(at)) < len(begin)
            lane = lambda i: pa.array(np.concatenate([np.zeros(len(begin), np.int64), digest[i].view(np.int64)]), mask=none)
            own = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(own), batch.column(1).take(own), pa.array(at + shift), pa.array(np.concatenate([end, windows + window]).astype(np.int64) + shift), lane(0), lane(1)], ["doc_id", "crc", "begin", "end", "h1", "h2"])

    return docs.select("doc_id", "crc", "text", "shared", "less").mapInArrow(run, "doc_id bigint, crc bigint, begin bigint, end bigint, h1 bigint, h2 bigint")


def finished(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of docs with ``spans``, arrays of begins and ends in any order, or null."""

    def run(batches):
        for batch in (own for b in batches for own in slices(b, 1, SLICE)):
            out: list = []
            for raw, spans in zip(batch.column(1), batch.column(2)):
                words = raw.as_py().translate(BLANKS).split()
                n, removed = len(words), 0
                if spans.is_valid:
                    kept, at = [], 0
                    for begin, end in sorted((s["begin"], s["end"]) for s in spans.as_py()):
                        if begin > at:
                            kept += words[at:begin]
                        if end > at:
                            removed += end - max(begin, at)
                            at = end
                    words = kept + words[at:]
                out.append((n, removed, hashlib.sha256(b" ".join(words)).hexdigest()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, window: int = 50, part: int = PART) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256. A word goes if a window of ``window`` words covers it that also starts in
    a document with a smaller doc_id; what goes is decided on the input. Null texts have no words;
    texts of over ``part`` bytes are parsed in overlapping parts. A null doc_id is neither
    smaller nor larger than another, so such rows keep all; rows of one doc_id take nothing from each other.

    Names and digests have 128 bits, and a repeat counts as proven where these are equal.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    folder = new_folder(spark, "repeats-keys")
    keys(docs, window, part).write.parquet(folder)
    named_in = spark.read.schema("k1 bigint, k2 bigint, doc_id bigint").parquet(folder)
    # Keys by 64 bits are enough to leave out what only one document has.
    shared = materialised(named_in.groupBy("k1").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("k1"))
    found = materialised(among(named_in, shared, "k1").distinct())
    least = materialised(found.where("k2 != 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("a")))
    anchors = found.where("k2 = 0").select("doc_id", F.col("k1").alias("shared"), F.lit(None).cast("bigint").alias("less"))
    symbols = found.where("k2 != 0").join(least, ["k1", "k2"]).where("a < doc_id").select("doc_id", F.lit(None).cast("bigint").alias("shared"), "k1", "k2")
    symbols = symbols.mapInArrow(_one_number, "doc_id bigint, shared bigint, less bigint")
    lists = anchors.unionByName(symbols).groupBy("doc_id").agg(F.collect_list("shared").alias("shared"), F.collect_list("less").alias("less"))
    keyed = docs.withColumn("crc", F.xxhash64("text"))
    folder = new_folder(spark, "repeats-findings")
    findings(among(keyed, materialised(found.select("doc_id").distinct()), "doc_id").join(lists, "doc_id"), window, part).write.parquet(folder)
    told = spark.read.schema("doc_id bigint, crc bigint, begin bigint, end bigint, h1 bigint, h2 bigint").parquet(folder)
    windows = told.where("h1 is not null").select("h1", "h2", "doc_id", "crc", "begin")
    first = materialised(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h1", "h2", "a"))
    again = among(windows, materialised(first.select("h1").distinct()), "h1").join(first, ["h1", "h2"]).where("a < doc_id").select("doc_id", "crc", "begin", (F.col("begin") + window).alias("end"))
    spans = told.where("h1 is null").select("doc_id", "crc", "begin", "end").unionByName(again)
    spans = materialised(spans.groupBy("doc_id", "crc").agg(F.collect_set(F.struct("begin", "end")).alias("spans")))
    told_of = screened(keyed, spans, "doc_id")
    some = told_of.where("hit").join(spans, ["doc_id", "crc"], "left")
    none = F.lit(None).cast("array<struct<begin: bigint, end: bigint>>").alias("spans")
    return finished(some.select("doc_id", "text", "spans")).unionByName(finished(told_of.where("not hit").select("doc_id", "text", none)))


def _one_number(batches):
    """Both lanes of a symbol's name as one, as findings() makes it."""
    for batch in batches:
        k1, k2 = (np.asarray(batch.column(i)).view(np.uint64) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), signed(k1 ^ mixed(k2))], ["doc_id", "shared", "less"])
