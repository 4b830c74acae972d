"""SimHash near-duplicates: fingerprints, all links within a Hamming distance, and components.

Rows of a fingerprint are collapsed first, so exact copies cost one entry. Upper nodes of the index are
masked bit patterns: with three masks that split the 64 bits, two fingerprints that differ in at most
two bits share the pattern of at least one mask, so a link is never lost. A node with more members than
``node_size`` is divided alike: the bits that its pattern leaves free are split by three masks again, and a link
inside it shares the pattern of one of them. Under a node the members are sorted by Gray rank, which puts
codes with few differing bits side by side, and factored into a hierarchy: each group keeps the bits that all
its members share. A search adds up the differences between the query's bits and a group's shared bits and
leaves out the whole group once they exceed the distance.

``near_copies`` joins texts by the share of five-word shingles that they have in common. At a share of 0.8
fingerprints differ in 15 % of their bits, however long they are, so masked patterns that such a pair shares are
shared by much that is unlike. There the upper nodes are bands of min-hashes instead, wide fingerprints in
Gray order prune what is compared below them, and the shingle sets themselves decide.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlight.llm.common import materialised, slices, texts
from searchlight.llm.components import components
from searchlight.llm.repeats import among

#: Free bits of a node that can have so few members that it needs no division.
FEW_BITS = 8


@lru_cache(4096)
def divided(fixed: int) -> tuple[int, int, int]:
    """A node's fixed bits and, added to them, each of three parts of its free bits."""
    free = [1 << i for i in range(64) if not fixed >> i & 1]
    size = -(-len(free) // 3)
    return tuple(fixed | sum(free[i * size : (i + 1) * size]) for i in range(3))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """SimHash over word shingles, repeats included: a bit is set if over half the shingles' XXH64 (seed 42) have it."""
    words = text.lower().split()  # bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return 0
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if n <= words_per_shingle:
        hashes = [h(joined, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        begins = np.concatenate([[0], ends[: n - words_per_shingle]]).tolist()
        hashes = [h(joined[a:b], 42) for a, b in zip(begins, (ends[words_per_shingle - 1 :] - 1).tolist())]
    codes = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(codes), 1 << 14):
        bits = np.unpackbits(codes[i : i + (1 << 14)].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(codes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp) per row; text_hash tells rows with the same key apart."""

    def run(batches):
        for batch in (own for batch in batches for own in slices(batch, 1)):
            values = batch.column(1)
            fp = [_signed(fingerprint(v.as_py(), words_per_shingle)) for v in values]
            own = [_signed(xxhash.xxh64_intdigest(v.as_py(), 42)) for v in values]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "text_hash", "fp"])

    return texts(docs).mapInArrow(run, "doc_id bigint, text_hash bigint, fp bigint")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The position of each code in the reflected Gray order."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A hierarchy over codes of one or more 64-bit words in Gray order; each group keeps the bits that its members share."""

    def __init__(self, codes: np.ndarray, fan_out: int = 8):
        codes = codes.reshape(len(codes), -1)
        self.order = np.lexsort(gray_rank(codes).T[::-1])
        self.codes = codes[self.order]
        self.fan_out, self.levels = fan_out, []  # bottom up: (bits that all members share, their values)
        same, ones = np.full_like(self.codes, ~np.uint64(0)), self.codes
        while len(ones) > fan_out:
            at = np.arange(0, len(ones), fan_out)
            differ = np.bitwise_or.reduceat((ones ^ np.repeat(ones[at], np.diff([*at, len(ones)]), axis=0)) | ~same, at, axis=0)
            same, ones = ~differ, ones[at] & ~differ
            self.levels.append((same, ones))

    def near(self, queries: np.ndarray, distance: int, pairs: int = 1 << 20):
        """Pairs (number of a query, position in ``codes``) within the distance, by blocks of queries."""
        n, widths = len(self.codes), np.arange(self.fan_out)
        bits = lambda x: np.bitwise_count(x).sum(axis=1)
        block = max(pairs // n, 1)
        for begin in range(0, len(queries), block):
            query = np.arange(begin, min(len(queries), begin + block))
            top = len(self.levels[-1][0]) if self.levels else n
            q, group = np.repeat(query, top), np.tile(np.arange(top), len(query))
            for level in range(len(self.levels) - 1, -1, -1):
                same, ones = self.levels[level]
                keep = bits((queries[q] ^ ones[group]) & same[group]) <= distance
                q, group = q[keep], group[keep]
                below = len(self.levels[level - 1][0]) if level else n
                q, group = np.repeat(q, self.fan_out), (group[:, None] * self.fan_out + widths).ravel()
                keep = group < below
                q, group = q[keep], group[keep]
            keep = bits(queries[q] ^ self.codes[group]) <= distance
            yield q[keep], group[keep]

    def links(self, distance: int, pairs: int = 1 << 20):
        """Pairs of positions in ``codes`` within the distance, each once, by blocks."""
        for q, group in self.near(self.codes, distance, pairs):
            keep = group > q
            yield q[keep], group[keep]


def spanning_links(codes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (number of a code, number of a code that it reaches) that connect the codes just as all pairs within the distance do."""
    index = GrayIndex(codes)
    parent = list(range(len(codes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in index.links(distance):
        for x, y in zip(a.tolist(), b.tolist()):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    roots = np.array([root(x) for x in range(len(codes))], np.int64)
    linked = roots != np.arange(len(codes))
    return index.order[linked], index.order[roots[linked]]


def fingerprint_links(distinct: DataFrame, distance: int = 2, node_size: int = 256) -> DataFrame:
    """Edges (a, b) that connect the distinct codes in column fp as all pairs within ``distance`` (0 to 2) bits do."""
    if not 0 <= distance <= 2:
        raise ValueError("the masks are made for a distance of at most 2")

    def divide(batches):
        for batch in batches:
            codes, fixed = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy().view(np.uint64)
            known, at = np.unique(fixed, return_inverse=True)
            masks = np.array([divided(int(f)) for f in known], np.uint64).reshape(-1, 3)[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(codes, 3).view(np.int64)), pa.array(masks.ravel().view(np.int64))], ["fp", "fixed"])

    def search(batches):
        for batch in batches:
            a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
            for codes in batch.column(0):
                own = codes.values.to_numpy().view(np.uint64)
                x, y = spanning_links(own, distance)
                a.append(own[x])
                b.append(own[y])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).view(np.int64)) for v in (a, b)], ["a", "b"])

    links, nodes = None, distinct.select("fp", F.lit(0).cast("bigint").alias("fixed"))
    while True:
        nodes = nodes.mapInArrow(divide, "fp bigint, fixed bigint").withColumn("bits", F.col("fp").bitwiseAND(F.col("fixed")))
        sizes = nodes.groupBy("fixed", "bits").count().where("count > 1")
        members = materialised(nodes.join(materialised(sizes), ["fixed", "bits"]))
        large = (F.col("count") > node_size) & (F.bit_count("fixed") < 64 - FEW_BITS)
        groups = members.where(~large).groupBy("fixed", "bits").agg(F.collect_list("fp").alias("codes"))
        found = groups.select("codes").mapInArrow(search, "a bigint, b bigint")
        links = found if links is None else links.unionByName(found)
        nodes = members.where(large).select("fp", "fixed")
        if nodes.isEmpty():
            return links


def near_duplicates(docs: DataFrame, *, words_per_shingle: int = 3, distance: int = 2) -> DataFrame:
    """(doc_id, text_hash, fp, fingerprint, component, component_id) for every row.

    Null and empty texts have fingerprint zero and are linked like any other. component is the smallest fingerprint (as a
    signed number) that the row's fingerprint reaches, component_id the smallest doc_id of those rows (null if none has one).
    """
    rows = materialised(fingerprints(docs, words_per_shingle))
    ids = materialised(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = components(fingerprint_links(ids.select("fp"), distance))
    placed = ids.join(labels.select(F.col("node").alias("fp"), "label"), "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("component"))
    placed = materialised(placed)
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    placed = materialised(placed.join(least, "component").select("fp", "component", "component_id"))
    return rows.join(placed, "fp").select("doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component", "component_id")


#: Wide fingerprints: words of 64 bits, and how many bits may differ. Texts that share 0.8 of their shingles differ in 39
#: on average, and in more than this about once in 100 000 times.
LANES, WIDE_DISTANCE = 4, 64
#: Min-hash bands: two texts that share 0.8 have one of them in common with a probability of 0.9996.
BANDS, BAND_ROWS = 20, 5
MULTIPLIERS, OFFSETS = np.random.default_rng(64).integers(1, 1 << 63, (2, BANDS * BAND_ROWS), np.uint64) | np.uint64(1)


def shingle_set(text: bytes, words_per_shingle: int = 5) -> np.ndarray:
    """The hashes of a text's word shingles, sorted, each once; a text with fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    hashes = {xxhash.xxh64_intdigest(b" ".join(words[i : i + words_per_shingle]), 42) for i in range(max(len(words) - words_per_shingle + 1, 1))} if words else ()
    return np.sort(np.fromiter(hashes, np.uint64, len(hashes)))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of 256 bits over a shingle set (four words): each hash is mixed into four."""
    ones = np.zeros(64 * LANES, np.int64)
    for i in range(0, len(hashes), 4096):
        z = hashes[i : i + 4096, None] + np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        ones += np.unpackbits(np.ascontiguousarray(z).view(np.uint8), bitorder="little").reshape(-1, 64 * LANES).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a shingle set's min-hash bands; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    least = np.full(len(MULTIPLIERS), ~np.uint64(0))
    for i in range(0, len(hashes), 4096):
        z = (hashes[i : i + 4096, None] ^ OFFSETS) * MULTIPLIERS
        least = np.minimum(least, (z ^ (z >> np.uint64(32))).min(axis=0))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, BAND_ROWS).T:
        keys = (keys ^ row) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(29)
    return keys


def alike(one: np.ndarray, two: np.ndarray, least_share: float) -> bool:
    common = len(np.intersect1d(one, two, assume_unique=True))
    return common >= least_share * (len(one) + len(two) - common) - 1e-9


def bridges(members: DataFrame, sets: DataFrame, least_share: float, block_bytes: int = 4 << 20) -> DataFrame:
    """Edges (a, b) between the labels of members (node, name, fp, label) that connect them as all alike pairs of a node do.

    Pairs of one label need no comparison. So a node's members outside its largest label are held against all members, in
    pairs of blocks of about ``block_bytes`` of shingle sets: a large group that has one label already costs a count, and
    one node's pairs of blocks are dealt out to all tasks. In a pair of blocks the Gray-order index of wide
    fingerprints leaves out what differs too much, and the sets (name, shingles) decide.
    """
    many = members.groupBy("node", "label").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    open_ = many.groupBy("node").agg(F.max(F.struct("n", "label", "bytes")).alias("most"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.count("*").alias("labels")).where("labels > 1 and n > 2")
    count = lambda size: F.ceil((size + 1) / block_bytes)
    open_ = materialised(open_.select("node", F.col("most.label").alias("largest"), count(F.col("bytes") - F.col("most.bytes")).alias("rest"), count(F.col("most.bytes")).alias("blocks")))
    rest = F.col("label") != F.col("largest")
    dealt = members.join(open_, "node").select("node", "rest", "blocks", rest.alias("minor"), F.pmod(F.xxhash64("name"), F.when(rest, F.col("rest")).otherwise(F.col("blocks"))).alias("block"), "name", "fp", "label")
    dealt = dealt.join(sets.select("name", "shingles"), "name").select("node", "rest", "blocks", "minor", "block", F.struct("shingles", "fp", "label").alias("member"))
    dealt = materialised(dealt.groupBy("node", "minor", "block").agg(F.first("rest").alias("rest"), F.first("blocks").alias("blocks"), F.collect_list("member").alias("members")))
    against = F.expr("concat(transform(sequence(block, rest - 1), i -> struct(true as minor, i as block)), transform(sequence(0L, blocks - 1), i -> struct(false as minor, i as block)))")
    left = dealt.where("minor").select("node", F.col("members").alias("a"), F.explode(against).alias("to")).select("node", "to.minor", "to.block", "a")
    pairs = left.join(dealt.select("node", "minor", "block", F.col("members").alias("b")), ["node", "minor", "block"]).select("a", "b")

    def compare(batches):
        for batch in (batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)):
            x, y = batch.column(0)[0].values, batch.column(1)[0].values
            names = pa.concat_arrays([x.field("label"), y.field("label")]).dictionary_encode()
            number = names.indices.to_numpy()
            one, two = number[: len(x)], number[len(x) :]
            parent, links = list(range(len(names.dictionary))), []

            def root(p: int) -> int:
                while parent[p] != p:
                    p = parent[p]
                return p

            codes = [np.frombuffer(b"".join(v.field("fp").to_pylist()), np.uint64).reshape(-1, LANES) for v in (x, y)]
            index = GrayIndex(codes[1])
            values = [[np.frombuffer(s, np.uint64) for s in v.field("shingles").to_pylist()] for v in (x, y)]
            for i, j in index.near(codes[0], WIDE_DISTANCE):
                j = index.order[j]
                differ = one[i] != two[j]
                for p, q in zip(i[differ].tolist(), j[differ].tolist()):
                    first, second = root(one[p]), root(two[q])
                    if first != second and alike(values[0][p], values[1][q], least_share):
                        parent[max(first, second)] = min(first, second)
                        links.append((names.dictionary[first].as_py(), names.dictionary[second].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([link[k] for link in links], pa.binary()) for k in (0, 1)], ["a", "b"])

    return pairs.mapInArrow(compare, "a binary, b binary")


def joined_labels(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels (node, label) after ``edges`` have joined labels; nodes without one that an edge names get one."""
    edges = materialised(edges)
    if edges.isEmpty():
        return labels
    over = materialised(components(edges).select(F.col("node").alias("label"), F.col("label").alias("over")))
    moved = labels.join(over, "label", "left").select("node", F.coalesce("over", "label").alias("label"))
    alone = over.join(labels.select(F.col("node").alias("label")), "label", "left_anti").select(F.col("label").alias("node"), F.col("over").alias("label"))
    return materialised(moved.unionByName(alone))


def near_copies(docs: DataFrame, *, words_per_set: int = 5, least_share: float = 0.8, block_bytes: int = 4 << 20, most_broadcast: int = 1_000_000) -> DataFrame:
    """(doc_id, text_hash, component) for every row: groups of texts joined by pairs that share ``least_share`` of their five-word shingles.

    Texts with one shingle set are one entry; null texts and those without words have the empty one. Entries meet in
    min-hash bands. Each is first held against its bands' least entries, which costs as many comparisons as there are
    entries; ``bridges`` then compares what shares a band and is not joined yet. Wide fingerprints that differ in more
    than ``WIDE_DISTANCE`` bits are left out of either, and the shingle sets decide: what is joined is alike.
    """

    def sketch(batches):
        for batch in (own for batch in batches for own in slices(batch, 1)):
            own, name, fp, bands, size = [], [], [], [], []
            for value in batch.column(1).to_pylist():
                hashes = shingle_set(value, words_per_set)
                own.append(_signed(xxhash.xxh64_intdigest(value, 42)))
                name.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                fp.append(wide_fingerprint(hashes).tobytes())
                bands.append(band_keys(hashes).view(np.int64))
                size.append(hashes.nbytes)
            arrays = [batch.column(0), pa.array(own, pa.int64()), pa.array(name, pa.binary()), pa.array(fp, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "name", "fp", "bands", "size"])

    rows = materialised(texts(docs).mapInArrow(sketch, "doc_id bigint, text_hash bigint, name binary, fp binary, bands array<bigint>, size bigint"))
    entries = rows.groupBy("name").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("size").alias("size"), F.min("text_hash").alias("text_hash"))
    # Most bands have one entry: they are counted by their keys alone, and only entries of shared ones are moved.
    entries = materialised(entries)
    shared = materialised(entries.select(F.explode("bands").alias("node")).groupBy("node").count().where("count > 1").select("node"))
    nodes = materialised(among(entries.select("name", "fp", "size", "text_hash", F.explode("bands").alias("node")), shared, "node"))
    least = nodes.groupBy("node").agg(F.min(F.struct("name", "fp")).alias("least"))
    nodes = materialised(nodes.join(materialised(least), "node"))

    def read(batches):
        seen: set[bytes] = set()
        for batch in (own for batch in batches for own in slices(batch, 1)):
            names, sets = [], []
            for name, value in zip(*(c.to_pylist() for c in batch.columns)):
                if name in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(name)
                names.append(name)
                sets.append(shingle_set(value, words_per_set).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(sets, pa.binary())], ["name", "shingles"])

    # One text of each entry that shares a band is read again.
    wanted = materialised(nodes.select("text_hash", "name").distinct())
    wanted = F.broadcast(wanted) if wanted.limit(most_broadcast + 1).count() <= most_broadcast else wanted
    text = F.coalesce("text", F.lit(""))
    sets = docs.select(F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text")).join(wanted, "text_hash").select("name", "text")
    sets = materialised(sets.mapInArrow(read, "name binary, shingles binary").groupBy("name").agg(F.first("shingles").alias("shingles")))

    def compare_fingerprints(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, LANES) for c in ("fa", "fb"))
            yield batch.select(["a", "b"]).filter(pa.array(np.bitwise_count(a ^ b).sum(axis=1) <= WIDE_DISTANCE))

    def compare_sets(batches):
        for batch in (own for batch in batches for own in slices(batch, 2)):
            pairs = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())
            yield batch.select(["a", "b"]).filter(pa.array([alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least_share) for x, y in pairs], pa.bool_()))

    stars = nodes.where("name != least.name").select(F.col("name").alias("a"), F.col("least.name").alias("b"), F.col("fp").alias("fa"), F.col("least.fp").alias("fb")).distinct()
    stars = stars.mapInArrow(compare_fingerprints, "a binary, b binary")
    stars = stars.join(sets.select(F.col("name").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("name").alias("b"), F.col("shingles").alias("y")), "b")
    labels = materialised(components(stars.select("a", "b", "x", "y").mapInArrow(compare_sets, "a binary, b binary")))
    members = nodes.join(labels.select(F.col("node").alias("name"), "label"), "name", "left").select("node", "name", "fp", "size", F.coalesce("label", "name").alias("label"))
    labels = joined_labels(labels, bridges(materialised(members), sets, least_share, block_bytes))
    return rows.join(labels.select(F.col("node").alias("name"), "label"), "name", "left").select("doc_id", "text_hash", F.coalesce("label", "name").alias("component"))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs with one of each component (doc_id, text_hash, component): its smallest doc_id, of equal ids the smallest text hash; equal rows count once."""
    keep = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("k"))
    keep = materialised(keep.select(F.col("k.none").alias("__none"), F.coalesce("k.doc_id", F.lit(0)).alias("__id"), F.col("k.text_hash").alias("__own")).distinct())
    # Equal rows go first, by the columns of the join: so each text is moved once.
    key = {"__none": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "__own": F.xxhash64(F.coalesce("text", F.lit("")))}
    own = docs.withColumns(key).dropDuplicates(list(key))
    return own.join(keep, list(key), "left_semi").select(*docs.columns)
