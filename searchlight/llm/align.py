"""Which tokens of two tokenizers stand for the same bytes.

Where a token of A and one of B end at the same byte, both sequences can be cut; what lies between two cuts is a group,
and the two tokens are linked. A chunk of a text knows only the tokens of its own byte range, so it gives a fragment: what
comes before its first cut (open), the groups between its cuts (closed), and what comes after its last one (open). Fragments
of neighbouring chunks compose, whatever the order of composing, and those of a very long text do so in a tree of Spark tasks.

Chunks are cut where a tokenizer's own rules let nothing pass, so they give the tokens of the whole text: A at white space
after other characters and at stops after letters; B between characters that stand side by side in no piece. These are
different places, and so the tokens of A and B in a chunk need not cover the same bytes.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import re
import struct
import uuid
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlight.llm.common import WHITE_SPACE, materialised, new_folder, slices, texts
from searchlight.llm.segments import SegmentCache

#: Characters of a chunk; longer texts are composed of fragments.
CHUNK = 1 << 15
#: Fragments that a task of the tree composes.
FAN = 8
#: Pairs of ids that are broadcast, 17 bytes each.
MOST_PAIRS = 4_000_000
LOW = 0xFFFFFFFF
#: A link's code, (A's id << 32) + B's id, as bytes.
LINK = struct.Struct("<II")
find_cut_a = re.compile(f"(?<=[^{WHITE_SPACE}])[{WHITE_SPACE}]|(?<=[A-Za-z])[.,;:!?)\\]]").search


class Region:
    """Tokens of both sides without a closed group: ids, and the byte where each token ends."""

    __slots__ = ("a", "b", "ends_a", "ends_b")

    def __init__(self, a, ends_a, b, ends_b):
        self.a, self.ends_a, self.b, self.ends_b = a, ends_a, b, ends_b

    def __add__(self, other: Region) -> Region:
        return Region(self.a + other.a, self.ends_a + other.ends_a, self.b + other.b, self.ends_b + other.ends_b)

    def __eq__(self, other) -> bool:
        return (self.a, self.ends_a, self.b, self.ends_b) == (other.a, other.ends_a, other.b, other.ends_b)

    def text(self) -> bytes:
        """The region as a group: ``a1,a2|b1``."""
        return b",".join(map(b"%d".__mod__, self.a)) + b"|" + b",".join(map(b"%d".__mod__, self.b))

    def code(self) -> int:
        """The link of a region that ends with a cut."""
        return self.a[-1] << 32 | self.b[-1]


EMPTY = Region([], [], [], [])


class Fragment:
    """head: up to the first cut (if there is none, all); groups: bytes of each closed group after it; codes: links at all cuts but
    the first; tail: after the last cut. ``cut``: whether there is any."""

    __slots__ = ("codes", "cut", "groups", "head", "tail")

    def __init__(self, head=EMPTY, cut=False, groups=(), codes=(), tail=EMPTY):
        self.head, self.cut, self.groups, self.codes, self.tail = head, cut, list(groups), list(codes), tail

    def __eq__(self, other) -> bool:
        return all(getattr(self, k) == getattr(other, k) for k in self.__slots__)

    @classmethod
    def of(cls, r: Region) -> Fragment:
        """The fragment of some tokens: cut at each byte where tokens of both sides end."""
        cuts = sorted(set(r.ends_a) & set(r.ends_b))
        if not cuts:
            return cls(r)
        regions, i, j = [], 0, 0
        for cut in cuts:
            m, n = r.ends_a.index(cut, i) + 1, r.ends_b.index(cut, j) + 1
            regions.append(Region(r.a[i:m], r.ends_a[i:m], r.b[j:n], r.ends_b[j:n]))
            i, j = m, n
        return cls(regions[0], True, [x.text() for x in regions[1:]], [x.code() for x in regions[1:]], Region(r.a[i:], r.ends_a[i:], r.b[j:], r.ends_b[j:]))

    def __add__(self, other: Fragment) -> Fragment:
        """Composition. It is associative, and the empty fragment changes nothing."""
        seam = Fragment.of((self.tail if self.cut else self.head) + other.head)
        if not self.cut:
            if not other.cut:
                return seam
            return Fragment(seam.head, True, seam.groups + other.groups, seam.codes + other.codes, other.tail)
        if not seam.cut:
            return Fragment(self.head, True, self.groups, self.codes, seam.head)
        closed = Fragment(self.head, True, [*self.groups, seam.head.text(), *seam.groups], [*self.codes, seam.head.code(), *seam.codes], seam.tail)
        if other.cut:
            closed.groups += other.groups
            closed.codes += other.codes
            closed.tail = other.tail
        return closed


class Aligner:
    """Both tokenizers, with the tokens' bytes, and a cache of aligned segments.

    A segment is white space with the other characters after it (and more, where a piece joins what stands there): both
    tokenizers treat it alike wherever it stands. B adds
    a blank before a text, so a segment that begins with one is given to it without; others stand behind a line feed, which joins nothing.
    """

    GUARD = "\n"

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer, pre_tokenizers

        self.a, self.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        byte_of = self._byte_alphabet(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))
        vocabulary = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = [*map(len, self.bytes_a)], [*map(len, self.bytes_b)]
        #: Characters that stand side by side in a piece.
        self.joined = {(x, y) for i, p in enumerate(pieces) if not self.b.is_byte(i) for x, y in zip(p.replace("▁", " "), p[1:].replace("▁", " "))}
        self.guard = self.b.encode(self.GUARD)
        if any(self.GUARD in pair for pair in self.joined) or self.b.encode(self.GUARD + "x")[: len(self.guard)] != self.guard:
            raise ValueError(f"{path_b}: a piece joins a line feed to something")
        white = re.compile(f"[{WHITE_SPACE}]").fullmatch
        # White space that a piece joins to other characters before it cuts nothing.
        glue = "".join(sorted({re.escape(y) for x, y in self.joined if white(y) and not white(x)}))
        rest = f"(?:[{glue}][{WHITE_SPACE}]*[^{WHITE_SPACE}]*)*" if glue else ""
        # A stop behind a word is a segment of its own, unless a piece joins it to the letter before.
        letters = "A-Za-zÀ-ÖØ-öø-ɏ"
        parted = lambda stop: "(?<![{0}])(?={1}(?:[{2}]|\\Z))".format("".join(re.escape(x) for x, y in sorted(self.joined) if y == stop) or "\n", re.escape(stop), WHITE_SPACE)
        word = f"[{WHITE_SPACE}]*[{letters}]+(?:{parted('.')}|{parted(',')})"
        self.segments_of = re.compile(f"{word}|[{WHITE_SPACE}]*[^{WHITE_SPACE}]+{rest}|[{WHITE_SPACE}]+").findall
        self.joint_cuts = re.compile(f"(?<=[^{WHITE_SPACE}])" + (f"(?![{glue}])" if glue else "") + f"[{WHITE_SPACE}]").finditer
        self.cache = SegmentCache(self._align)

    @staticmethod
    def _byte_alphabet(level) -> dict[str, int]:
        """The characters that stand for bytes; each byte is taken from a character that has it, at the same place."""
        out: dict[str, int] = {}
        for char in [*map(chr, range(0x800)), "ࠀ", "￿", *(chr(x) for x in range(0x1000, 0x110000, 0x1000) if not 0xD800 <= x < 0xE000)]:
            found = "".join(piece for piece, _ in level.pre_tokenize_str(char))
            out.update(zip(found, char.encode()))
        return out

    def ids_a(self, text: str) -> list[int]:
        return self.a.encode(text, add_special_tokens=False).ids

    def ids_b(self, text: str) -> list[int]:
        """B's tokens of a part of a text that it has put its blank before already."""
        return self.b.encode(text[1:], num_threads=1) if text[:1] == " " and len(text) > 1 else self.b.encode(self.GUARD + text, num_threads=1)[len(self.guard) :]

    def region(self, text_a: str, start_a: int, text_b: str, start_b: int) -> Region | None:
        """Tokens of a part for A and one for B, from these bytes on; None if they don't give back the parts' bytes."""
        a, b = self.ids_a(text_a) if text_a else [], self.ids_b(text_b) if text_b else []
        raw_a, raw_b = [self.bytes_a[i] for i in a], [self.bytes_b[i] for i in b]
        if b"".join(raw_a) != text_a.encode() or b"".join(raw_b) != text_b.encode():
            return None
        ends = lambda raw, start: (start + np.cumsum([len(x) for x in raw], dtype=np.int64)).tolist()
        return Region(a, ends(raw_a, start_a), b, ends(raw_b, start_b))

    def _align(self, segments: list[str]):
        """For each segment n_a, n_b, groups, links; None if its bytes are not its tokens'."""
        plain = [s[:1] == " " and len(s) > 1 for s in segments]
        found_a = self.a.encode_batch_fast(segments, add_special_tokens=False)
        found_b = self.b.encode([s[1:] if p else self.GUARD + s for s, p in zip(segments, plain)], num_threads=1)
        bytes_a, bytes_b, sizes_a, sizes_b, text = self.bytes_a, self.bytes_b, self.sizes_a, self.sizes_b, b"%d".__mod__
        for segment, p, a, b in zip(segments, plain, found_a, found_b):
            ids_a, ids_b = a.ids, b if p else b[len(self.guard) :]
            raw = segment.encode()
            if b"".join([bytes_b[i] for i in ids_b]) != raw or b"".join([bytes_a[i] for i in ids_a]) != raw:
                yield None
                continue
            ends_a, ends_b = list(accumulate([sizes_a[i] for i in ids_a])), list(accumulate([sizes_b[i] for i in ids_b]))
            cuts = set(ends_a).intersection(ends_b)
            groups, codes, i, j = [], b"", 0, 0
            for cut in sorted(cuts) if len(cuts) > 1 else cuts:
                m, n = (ends_a.index(cut, i) + 1, ends_b.index(cut, j) + 1) if len(cuts) > 1 else (len(ids_a), len(ids_b))
                groups.append(b",".join(map(text, ids_a[i:m])) + b"|" + b",".join(map(text, ids_b[j:n])))
                codes += LINK.pack(ids_b[n - 1], ids_a[m - 1])
                i, j = m, n
            yield len(ids_a), len(ids_b), b";".join(groups), codes

    def closed(self, texts_: list[str]):
        """For each text, which has no open tokens at its ends, its segments' values."""
        return self.cache.values(texts_, self.segments_of)

    def cuts(self, text: str, most: int) -> list[tuple[int, int]]:
        """(for A, for B) where chunks of about ``most`` characters begin, the end included."""
        out, a, b, n = [(0, 0)], 0, 0, len(text)
        for at in range(most, n, most):
            if a < at:
                found = find_cut_a(text, at)
                a = found.start() if found else n
            if b < at:
                b = next((i for i in range(at, n) if (text[i - 1], text[i]) not in self.joined), n)
            out.append((a, b))
        return [*out, (n, n)]


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def summary(fragment: Fragment | None) -> tuple:
    """n_a, n_b, n_groups, codes, counts, digest of a whole text."""
    if fragment is None or not fragment.cut or fragment.tail != EMPTY:
        return 0, 0, 0, [], [], ""
    groups = [fragment.head.text(), *fragment.groups]
    codes, counts = np.unique(np.array([fragment.head.code(), *fragment.codes], np.int64), return_counts=True)
    sides = [group.split(b"|") for part in groups for group in part.split(b";")]
    n_a, n_b = (sum(side[i].count(b",") + 1 for side in sides) for i in (0, 1))
    return n_a, n_b, len(sides), codes, counts, hashlib.sha256(b";".join(groups)).hexdigest()


ALIGNED = "doc_id bigint, uid string, part int, parts int, n_a bigint, n_b bigint, n_groups bigint, codes array<bigint>, counts array<bigint>, groups_sha256 string, chunk string, base bigint, from_a int, to_a int, from_b int, to_b int"


def align_texts(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """Rows of ALIGNED: whole texts with their summary, and chunks (part is not null) of texts over ``chunk`` characters."""
    names = [field.split()[0] for field in ALIGNED.split(", ")]

    def run(batches):
        own = aligner(path_a, path_b)
        for batch in (s for b in batches for s in slices(b, 1, 1 << 20)):
            ids, raw = batch.column(0).to_pylist(), [" " + x.decode() if x else "" for x in batch.column(1).to_pylist()]
            rows: list[dict] = []
            short = [i for i, text in enumerate(raw) if 0 < len(text) <= chunk]
            for i, values in zip(short, own.closed([raw[i] for i in short])):
                values = list(values)
                row = {"doc_id": ids[i], "uid": uuid.uuid4().hex, "n_a": 0, "n_b": 0, "n_groups": 0, "codes": [], "counts": [], "groups_sha256": ""}
                if None not in values:
                    n_a, n_b, groups, codes = zip(*values)
                    codes = np.frombuffer(b"".join(codes), "<i8")
                    pairs, counts = np.unique(codes, return_counts=True)
                    row |= {"n_a": sum(n_a), "n_b": sum(n_b), "n_groups": len(codes), "codes": pairs, "counts": counts, "groups_sha256": hashlib.sha256(b";".join(groups)).hexdigest()}
                rows.append(row)
            for i, text in enumerate(raw):
                if not text:
                    rows.append({"doc_id": ids[i], "uid": uuid.uuid4().hex, "n_a": 0, "n_b": 0, "n_groups": 0, "codes": [], "counts": [], "groups_sha256": ""})
                elif len(text) > chunk:
                    uid, cuts, base, before = uuid.uuid4().hex, own.cuts(text, chunk), 0, 0
                    for k, ((a, b), (next_a, next_b)) in enumerate(zip(cuts, cuts[1:])):
                        start = min(a, b)
                        base, before = base + len(text[before:start].encode()), start
                        piece = text[start : max(next_a, next_b)]
                        rows.append({"doc_id": ids[i], "uid": uid, "part": k, "parts": len(cuts) - 1, "chunk": piece, "base": base, "from_a": a - start, "to_a": next_a - start, "from_b": b - start, "to_b": next_b - start})
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], kind) for c, kind in zip(names, TYPES)], names)

    return texts(docs).mapInArrow(run, ALIGNED)


TYPES = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string(), pa.string(), pa.int64(), *[pa.int32()] * 4]


def chunk_fragment(own: Aligner, text: str, base: int, from_a: int, to_a: int, from_b: int, to_b: int) -> Fragment | None:
    """The fragment of a chunk; what lies between places that cut both sides comes from the cache of segments."""
    size = lambda i: base + len(text[:i].encode())
    inner = [m.start() for m in own.joint_cuts(text) if max(from_a, from_b) <= m.start() <= min(to_a, to_b)]
    if len(inner) < 2:
        region = own.region(text[from_a:to_a], size(from_a), text[from_b:to_b], size(from_b))
        return None if region is None else Fragment.of(region)
    begin, end = inner[0], inner[-1]
    values = list(next(iter(own.closed([text[begin:end]]))))
    head = own.region(text[from_a:begin], size(from_a), text[from_b:begin], size(from_b))
    tail = own.region(text[end:to_a], size(end), text[end:to_b], size(end))
    if head is None or tail is None or None in values:
        return None
    first, *rest = values[0][2].split(b";", 1)
    a, b = (list(map(int, side.split(b","))) for side in first.split(b"|"))
    ends = lambda ids, raw: (size(begin) + np.cumsum([len(raw[i]) for i in ids])).tolist()
    codes = np.frombuffer(b"".join(v[3] for v in values), "<i8").tolist()
    middle = Fragment(Region(a, ends(a, own.bytes_a), b, ends(b, own.bytes_b)), True, rest + [v[2] for v in values[1:]], codes[1:])
    return Fragment.of(head) + middle + Fragment.of(tail)


def compose_chunks(chunks: DataFrame, most_parts: int, path_a: str, path_b: str, fan: int = FAN) -> DataFrame:
    """doc_id, uid and summary of the texts that ``chunks`` are of: each chunk's fragment, composed ``fan`` at a time in each round.

    A fragment is null if its tokens don't give back its bytes; then so is what it is part of.
    """

    def packed(doc_id, uid, part, fragment):
        kinds = pa.int64(), pa.string(), pa.int32(), pa.binary()
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((doc_id, uid, part, pickle.dumps(fragment)), kinds)], ["doc_id", "uid", "part", "fragment"])

    def fragments(batches):
        own = aligner(path_a, path_b)
        for batch in batches:
            columns = batch.to_pydict()
            for row in zip(*(columns[c] for c in ("doc_id", "uid", "part", "chunk", "base", "from_a", "to_a", "from_b", "to_b"))):
                yield packed(*row[:3], chunk_fragment(own, *row[3:]))

    def composed(batches):
        key, held = None, None
        for batch in batches:
            columns = batch.to_pydict()
            for doc_id, uid, part, fragment in zip(*(columns[c] for c in ("doc_id", "uid", "part", "fragment"))):
                fragment, now = pickle.loads(fragment), (doc_id, uid, part // fan)
                if now == key:
                    held = None if held is None or fragment is None else held + fragment
                else:
                    if key is not None:
                        yield packed(*key, held)
                    key, held = now, fragment
        if key is not None:
            yield packed(*key, held)

    def ended(batches):
        for batch in batches:
            columns = batch.to_pydict()
            for doc_id, uid, fragment in zip(columns["doc_id"], columns["uid"], columns["fragment"]):
                n_a, n_b, n_groups, codes, counts, digest = summary(pickle.loads(fragment))
                yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((doc_id, uid, n_a, n_b, n_groups, codes, counts, digest), DONE)], ["doc_id", "uid", "n_a", "n_b", "n_groups", "codes", "counts", "groups_sha256"])

    schema = "doc_id bigint, uid string, part int, fragment binary"
    out = chunks.repartition("uid", "part").mapInArrow(fragments, schema)
    while most_parts > 1:
        group = F.expr(f"part div {fan}")
        out = out.repartition(F.col("uid"), group).sortWithinPartitions("uid", "part").mapInArrow(composed, schema)
        most_parts = -(-most_parts // fan)
    return out.mapInArrow(ended, SUMMARY)


SUMMARY = "doc_id bigint, uid string, n_a bigint, n_b bigint, n_groups bigint, codes array<bigint>, counts array<bigint>, groups_sha256 string"
DONE = [pa.int64(), pa.string(), *[pa.int64()] * 3, *[pa.list_(pa.int64())] * 2, pa.string()]


def add_counts(aligned: DataFrame, pairs: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """aligned with n_links, n_best and count_sum, given pairs (code, n, best). Up to ``most_pairs`` pairs are broadcast; more are joined."""
    spark = aligned.sparkSession
    kept = ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    if pairs.count() > most_pairs:
        links = aligned.select("uid", F.explode(F.arrays_zip("codes", "counts")).alias("x")).select("uid", F.col("x.codes").alias("code"), "x.counts")
        sums = links.join(pairs, "code").groupBy("uid").agg(F.sum("counts").alias("n_links"), F.sum(F.when(F.col("best"), F.col("counts")).otherwise(0)).alias("n_best"), F.sum(F.col("counts") * F.col("n")).alias("count_sum"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
        return aligned.join(sums, "uid", "left").select(*kept, zero("n_links"), zero("n_best"), zero("count_sum"))
    known = pairs.toArrow().sort_by("code")
    table = spark.sparkContext.broadcast(tuple(known[c].to_numpy() for c in ("code", "n", "best")))

    def run(batches):
        codes, n, best = table.value
        for batch in batches:
            held, counts = batch.column(len(kept)), batch.column(len(kept) + 1)
            edges = held.offsets.to_numpy()
            cut = lambda column: column.values.to_numpy(zero_copy_only=False)[edges[0] : edges[-1]]
            own, times = np.searchsorted(codes, cut(held)), cut(counts)
            total = lambda values: pa.array(np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.int64)])[edges - edges[0]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], total(times), total(times * best[own]), total(times * n[own])], [*kept, "n_links", "n_best", "count_sum"])

    return aligned.select(*kept, "codes", "counts").mapInArrow(run, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_links bigint, n_best bigint, count_sum bigint")


def align_tokenizers(docs: DataFrame, path_a: str, path_b: str, *, chunk: int = CHUNK, fan: int = FAN, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """Per row: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a blank and the text, B the text (it adds the blank itself). Null and empty texts, and those that the tokens of
    either don't give back, have zeros and an empty digest. Rows count one by one, repeated ones and those with null ids too.
    """
    spark = docs.sparkSession
    folder = new_folder(spark, "aligned")
    align_texts(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), path_a, path_b, chunk).write.parquet(folder)
    found = spark.read.schema(ALIGNED).parquet(folder)
    columns = [field.split()[0] for field in SUMMARY.split(", ")]
    whole = found.where("part is null").select(columns)
    most_parts = found.agg(F.max("parts")).first()[0]
    if most_parts:
        folder = new_folder(spark, "aligned-long")
        compose_chunks(found.where("part is not null"), most_parts, path_a, path_b, fan).write.parquet(folder)
        whole = whole.unionByName(spark.read.schema(SUMMARY).parquet(folder))
    links = whole.select(F.explode(F.arrays_zip("codes", "counts")).alias("x")).groupBy(F.col("x.codes").alias("code")).agg(F.sum("x.counts").alias("n"))
    links = materialised(links)
    most = links.groupBy(F.col("code").bitwiseAND(LOW).alias("b")).agg(F.max("n").alias("most"))
    pairs = materialised(links.join(most, F.col("code").bitwiseAND(LOW) == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best")))
    return add_counts(whole, pairs, most_pairs)
