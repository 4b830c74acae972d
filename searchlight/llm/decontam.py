"""Benchmark decontamination: passages of documents within a word edit distance of a benchmark item.

Edit distance is hard to hash, so item-sized windows and items go through the CGK embedding: a random walk
copies symbols to a string three times as long, stepping on or staying by a random bit of (step, symbol).
A few edits change few places of the result, so Hamming distance stands for edit distance, and sampled
places are locality-sensitive keys. The keys of all items are one index; a window whose key is in it is a
candidate for the items that have the key. ``walks`` walks with ``bands`` samples of ``places`` places each
find what is to be found with a recall near one (measured in the tests, with and without the prefilter); an
exact edit distance then decides.

``prefilter`` spares most windows the walk: an item of n words with at most k edits keeps one of k + 1 pieces
whole, so windows are embedded only around a piece of some item of their size. That loses nothing, and says
nothing about which item it is. Items are few against documents; they are dealt out to blocks of about
``block_bytes`` of text, each broadcast as it is and held against all documents in one pass without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlight.llm.common import materialised, slices

SIMILARITY, BLOCK_BYTES = 0.8, 8 << 20
#: Bytes that separate words besides white space: ASCII punctuation.
TO_BLANKS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
PAD = -1


def words_of(text: bytes) -> list[bytes]:
    """Words in lower case without ASCII punctuation."""
    return text.lower().translate(TO_BLANKS).split()


def mixed(*parts) -> np.ndarray:
    """A 64-bit hash of integers, the same everywhere."""
    h = np.array([0x243F6A8885A308D3], np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p, np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h * np.uint64(0xBF58476D1CE4E5B9)


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """The least edit distance of the item to any part of the region, and where the first such part begins.

    A cell is the distance above 32 bits that tell where its part begins; insertions are a running minimum along the row.
    """
    one, at = np.int64(1 << 32), np.arange(len(region) + 1)
    row = at.copy()
    for i, word in enumerate(item, 1):
        best = np.minimum(row[:-1] + one * (region != word), row[1:] + one)
        row = np.concatenate([[i * one], best]) - at * one
        row = np.minimum.accumulate(row) + at * one
    return divmod(int(row.min()), int(one))


class Items:
    """The benchmark items of one block, ready to be found."""

    def __init__(self, items: list[tuple[int, bytes]], similarity: float = SIMILARITY, walks: int = 4, bands: int = 12, places: int = 3, prefilter: bool = True):
        self.number: dict[bytes, int] = {}
        self.similarity, self.walks, self.prefilter = similarity, walks, prefilter
        self.items = []  # (item_id, word numbers, most edits)
        seeds: dict[int, dict[int, set]] = defaultdict(lambda: defaultdict(set))
        rng = np.random.default_rng(20240229)
        self.samples = np.sort(rng.random((walks, bands, places)), axis=2)
        keys: dict[int, list] = defaultdict(list)
        same_size: dict[int, list] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words])
            n = len(ids)
            k = int((1 - similarity) * n + 1e-9)
            size = n // (k + 1)
            rolled = self.rolled(ids, size)
            for piece in range(k + 1):
                at = piece * n // (k + 1)
                seeds[size][int(rolled[at])].add((n, at, k))
            same_size[n].append(len(self.items))
            self.items.append((item_id, ids, k))
        for n, own in same_size.items():
            embedded = self.band_keys(np.concatenate([self.items[i][1] for i in own]), np.arange(len(own)) * n, n)
            for index, found in zip(own, embedded.tolist()):
                for key in set(found):
                    keys[key].append(index)
        self.seeds = {size: {code: tuple(places) for code, places in found.items()} for size, found in seeds.items()}
        self.sorted = {size: np.sort(np.fromiter(found, np.uint64, len(found))) for size, found in self.seeds.items()}
        self.keys = {key: tuple(found) for key, found in keys.items()}
        self.sorted_keys = np.sort(np.fromiter(self.keys, np.uint64, len(self.keys)))
        self.sizes = {(len(ids), k) for _, ids, k in self.items}

    @staticmethod
    def rolled(ids: np.ndarray, size: int) -> np.ndarray:
        """A hash of each run of ``size`` ids."""
        h = np.zeros(max(len(ids) - size + 1, 0), np.uint64)
        for j in range(size):
            h = h * np.uint64(0x100000001B3) + ids[j : j + len(h)].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return h

    def band_keys(self, ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        """The keys (window, walk x band) of the windows of n words at ``starts``, by the CGK embedding."""
        padded = np.concatenate([ids, np.full(n, PAD)])
        window = padded[starts[:, None] + np.arange(n)]
        window = np.concatenate([window, np.full((len(starts), 1), PAD)], axis=1)  # beyond the end a walk writes PAD
        window = np.repeat(window[:, None], self.walks, axis=1).reshape(-1, n + 1)
        line, walk = np.arange(len(window)), np.tile(np.arange(self.walks), len(starts))
        at, out = np.zeros(len(window), np.int64), np.empty((len(window), 3 * n), np.int64)
        for step in range(3 * n):
            symbol = out[:, step] = window[line, at]
            at = np.minimum(at + (mixed(step, symbol, walk) >> np.uint64(63)).astype(np.int64), n)
        places = (self.samples * 2 * n).astype(np.int64)  # by two n steps most walks have ended
        out = out.reshape(len(starts), self.walks, 3 * n)
        walks, bands = self.samples.shape[:2]
        chosen = [out[:, np.arange(walks)[:, None], places[:, :, p]] for p in range(places.shape[2])]
        return mixed(np.full_like(chosen[0], n), np.broadcast_to(np.arange(walks)[:, None] * bands + np.arange(bands), chosen[0].shape), *chosen).reshape(len(starts), -1)

    def windows(self, ids: np.ndarray) -> dict[int, np.ndarray]:
        """Window size -> starts of the windows to embed."""
        if not self.prefilter:
            return {n: np.arange(len(ids)) for n, _ in self.sizes}
        found: dict[int, list] = defaultdict(list)
        for size, seeds in self.seeds.items():
            if len(ids) < size:
                continue
            inside = ids > 0
            runs = inside[: len(ids) - size + 1].copy()
            for j in range(1, size):
                runs &= inside[j : len(runs) + j]
            at = np.flatnonzero(runs)
            if not len(at):
                continue
            codes = self.rolled(ids, size)[at]
            hit = is_in(codes, self.sorted[size])
            for pos, code in zip(at[hit].tolist(), codes[hit].tolist()):
                for n, offset, k in seeds[code]:
                    first = pos - offset
                    found[n].append(np.arange(max(first - k, 0), max(min(first + k, len(ids) - 1), 0) + 1))
        return {n: np.unique(np.concatenate(starts)) for n, starts in found.items()}

    def candidates(self, ids: np.ndarray) -> dict[int, list[int]]:
        """Item index -> starts of the windows that share a key with it, ascending."""
        found: dict[int, list[int]] = defaultdict(list)
        for n, starts in self.windows(ids).items():
            for i in range(0, len(starts), 1024):
                part = starts[i : i + 1024]
                keys = self.band_keys(ids, part, n)
                at, band = np.nonzero(is_in(keys, self.sorted_keys))
                for start, key in dict.fromkeys(zip(part[at].tolist(), keys[at, band].tolist())):
                    for index in self.keys[key]:
                        found[index].append(start)
        return found

    def find(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item_id, words of the item, edit distance, first word) for each item in the text."""
        words = words_of(text)
        ids = np.fromiter(map(self.number.get, words, (0,) * len(words)), np.int64, len(words))
        out = []
        for index, starts in self.candidates(ids).items():
            item_id, item, k = self.items[index]
            n, best, beyond = len(item), (len(item) + 1, 0), -1
            for start in sorted(set(starts)):
                if start < beyond or best[0] == 0:
                    continue
                a, beyond = max(start - k, 0), start + k + 1
                d, at = edit_distance(item, ids[a : start + n + 2 * k + 1])
                best = min(best, (d, a + at))
            if best[0] <= k:
                out.append((item_id, n, *best))
        return out


def is_in(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which codes are in a sorted table."""
    return table[np.minimum(np.searchsorted(table, codes), len(table) - 1)] == codes if len(table) else np.zeros(codes.shape, bool)


def blocks(benchmark: DataFrame, block_bytes: int):
    """The benchmark as broadcasts of (item_id, text) lists, each of about block_bytes of text, one after the other. Null and wordless items match nothing."""
    text = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("binary").alias("text"))
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-total // block_bytes)
    for i in range(parts):
        own = text.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i) if parts > 1 else text
        yield benchmark.sparkSession.sparkContext.broadcast([(r.item_id, bytes(r.text)) for r in own.orderBy("item_id", "text").collect()])


def contaminations(docs: DataFrame, benchmark: DataFrame, *, block_bytes: int = BLOCK_BYTES, **how) -> DataFrame:
    """A row for each document and item it holds: doc_id, item_id, item_words, edit_distance, similarity, first_word.

    Similarity is 1 - edit distance / words of the item, over the best passage, the first of equally good ones. Null and
    empty texts hold nothing, an empty benchmark gives no rows, equal documents each have their own rows.
    """

    def search(block):
        def run(batches):
            items = Items(block.value, **how)
            for batch in (own for batch in batches for own in slices(batch, 1)):
                rows = []
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                    rows += [(key, *found) for found in items.find((value.as_py() or "").encode())]
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "item_words", "edit_distance", "first_word"])

        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, item_id bigint, item_words bigint, edit_distance bigint, first_word bigint")

    out = None
    for block in blocks(benchmark, block_bytes):
        out = search(block) if out is None else out.unionByName(search(block))
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, item_words bigint, edit_distance bigint, first_word bigint")
    return out.select("doc_id", "item_id", "item_words", "edit_distance", (1 - F.col("edit_distance") / F.col("item_words")).alias("similarity"), "first_word")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, block_bytes: int = BLOCK_BYTES, **how) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns; null and empty texts stay, equal rows share their fate.

    After each block but the last the rows left are written, so tasks hold one block and the driver's plan stays short.
    """
    at = docs.columns.index("text")

    def clean(block):
        def run(batches):
            items = Items(block.value, **how)
            for batch in (own for batch in batches for own in slices(batch, at)):
                yield batch.filter(pa.array([not items.find((value.as_py() or "").encode()) for value in batch.column(at)], pa.bool_()))

        return run

    waiting = None
    for block in blocks(benchmark, block_bytes):
        if waiting:
            docs = materialised(docs.mapInArrow(clean(waiting), docs.schema))
            waiting.destroy()
        waiting = block
    return docs.mapInArrow(clean(waiting), docs.schema) if waiting else docs
