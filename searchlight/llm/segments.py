"""Cuts of a text whose tokens do not depend on what stands around them, and a cache of those tokens.

The word pattern of the byte-level tokenizers never joins a non-space character with white space
after it, nor letters with a stop or comma (or other characters that are no letters) after them. So a word with the one space before it, or else
a run of white space together with the run of other characters that follows it, is encoded alike
wherever it stands, and a frequent one needs to be encoded only once a worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa

from searchlight.llm.common import WHITE_SPACE

segments_of = re.compile(f" ?[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[ .,\n]|\\Z)|[{WHITE_SPACE}]*[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+").findall

#: Entries of each of a worker's two generations (a short segment and a few bytes each: about 40 MB), and the longest segment kept.
MAX_ENTRIES, MAX_LENGTH = 250_000, 64
#: Characters of the texts that are looked up together.
GROUP = 1 << 20


#: Classes of bytes: white space, letters, and what cuts behind a letter (none of it stands in special tokens).
IS_SPACE, IS_LETTER, CUTS_LETTER = np.zeros((3, 256), bool)
IS_SPACE[[*b"\t\n\v\f\r "]] = True
IS_LETTER[[b for b in range(128) if chr(b).isalpha()]] = True
CUTS_LETTER[[*b".,;:!?$#&*%'\")"]] = True
#: The last byte of white space beyond ASCII, and the byte before it.
ODD_LAST, ODD_BEFORE = np.zeros((2, 256), bool)
for _c in map(str.encode, "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"):
    ODD_LAST[_c[-1]] = ODD_BEFORE[_c[-2]] = True
#: New segments that are encoded as one string.
JOINED = 500


def cut_places(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the bytes of texts (each from one of the ascending ``bounds`` to the next) are cut, 0 and the end included:
    between texts, before ASCII white space that follows other characters, and between a letter and what cuts behind it."""
    cut = np.zeros(len(raw) + 1, bool)
    if len(raw) > 1:
        cut[1:-1] = IS_SPACE[raw[1:]] & ~IS_SPACE[raw[:-1]]
        cut[1:-1] |= CUTS_LETTER[raw[1:]] & IS_LETTER[raw[:-1]]
    at = np.flatnonzero(cut[2:]) + 2
    cut[at[ODD_LAST[raw[at - 1]] & ODD_BEFORE[raw[at - 2]]]] = False
    cut[bounds] = True
    return np.flatnonzero(cut)


class PackedSegments:
    """Encodes columns of texts by a byte-level tokenizer: segments are cut, numbered and put together as arrays, and only distinct
    ones are looked up one by one.

    ``encode_all`` gives the ids of each of some strings. New segments that begin with white space and end without it are cuts of
    any text they are joined to, so they are encoded many in one string, and the ids are dealt out by the bytes they stand for
    (``lengths``, by id). Entries are forgotten as in ``SegmentCache``.
    """

    def __init__(self, encode_all: Callable[[list[str]], list[list[int]]], lengths: np.ndarray, kind: str):
        self.encode_all, self.lengths, self.kind = encode_all, lengths, np.dtype(kind)
        self.now: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}

    def _apart(self, new: list[bytes]) -> list[bytes]:
        return [np.array(ids, self.kind).tobytes() for ids in self.encode_all([s.decode() for s in new])]

    def _joined(self, new: list[bytes]) -> list[bytes]:
        ids = [np.array(found, self.kind) for found in self.encode_all([b"".join(new[i : i + JOINED]).decode() for i in range(0, len(new), JOINED)])]
        ids = np.concatenate([*ids, np.zeros(0, self.kind)])
        ends, wanted = np.cumsum(self.lengths[ids]), np.cumsum(np.fromiter(map(len, new), np.int64, len(new)))
        places = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or (ends[places] != wanted).any():
            return self._apart(new)  # tokens that do not stand for their bytes
        packed, edges = ids.tobytes(), ((places + 1) * self.kind.itemsize).tolist()
        return [packed[a:b] for a, b in zip([0, *edges], edges)]

    def found(self, segments: list[bytes]) -> list[bytes]:
        """The packed ids of distinct segments."""
        if len(self.now) > MAX_ENTRIES:
            self.before, self.now = self.now, {}
        out = list(map(self.now.get, segments))
        missing = [i for i, value in enumerate(out) if value is None]
        joined, apart = [], []
        for i in missing:
            segment = segments[i]
            out[i] = value = self.before.get(segment)
            if value is None:
                plain = len(segment) <= MAX_LENGTH and IS_SPACE[segment[0]] and segment[-1] < 0x80 and not IS_SPACE[segment[-1]]
                (joined if plain else apart).append(i)
        for chosen, encode in ((joined, self._joined), (apart, self._apart)):
            if chosen:
                for i, value in zip(chosen, encode([segments[i] for i in chosen])):
                    out[i] = value
        self.now.update((segments[i], out[i]) for i in missing if len(segments[i]) <= MAX_LENGTH)
        return out

    def encode_column(self, column: pa.Array) -> Iterator[bytes]:
        """The packed ids of each text of a column of UTF-8 bytes without nulls."""
        bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        whole = pa.py_buffer(column.buffers()[2] or b"")
        data = whole.slice(int(bounds[0]), int(bounds[-1] - bounds[0]))
        bounds -= bounds[0]
        at = cut_places(np.frombuffer(data, np.uint8), bounds)
        segments = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), data]).dictionary_encode()
        values = self.found(segments.dictionary.to_numpy(zero_copy_only=False).tolist())
        packed = pa.array(values, pa.large_binary()).take(segments.indices)
        ends = np.frombuffer(packed.buffers()[1], np.int64)[: len(packed) + 1] if len(packed) else np.zeros(1, np.int64)
        out = memoryview(packed.buffers()[2] or b"")
        edges = ends[np.searchsorted(at, bounds)].tolist()
        for a, b in zip(edges, edges[1:]):
            yield bytes(out[a:b])

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The packed ids of each text."""
        return self.encode_column(pa.array([text.encode() for text in texts], pa.binary()))


class SegmentCache:
    """segment -> what ``encode_all`` gives for it (packed token ids, or their number).

    ``encode_all`` gets the distinct segments that a group of texts lacks, so a library is called once a group. When a
    generation of entries is full, the one before it is forgotten; what is used again moves to the new one.
    """

    def __init__(self, encode_all: Callable[[list[str]], Iterable], table: Mapping | None = None):
        self.encode_all = encode_all
        self.table = table or {}  # known beforehand; never forgotten
        self.now: dict = {}
        self.before: dict = {}
        self.long: list[str] = []

    def found(self, cut: list[list[str]]) -> Mapping:
        """A mapping that has all the segments of a group, until the next call."""
        for segment in self.long:
            del self.now[segment]
        self.long.clear()
        if len(self.now) > MAX_ENTRIES:
            self.before, self.now = self.now, {}
        new = []
        for segment in set().union(*cut).difference(self.now):
            value = self.table.get(segment)
            if value is None:
                value = self.before.get(segment)
            if value is None:
                new.append(segment)
            else:
                self.now[segment] = value
        if new:
            self.now.update(zip(new, self.encode_all(new)))
            self.long += [segment for segment in new if len(segment) > MAX_LENGTH]
        return self.now

    def values(self, texts: list[str], cut: Callable[[str], list[str]] = segments_of):
        """For each text the values of its segments, in groups of texts so that memory stays bounded."""
        for a, b in groups_by_size(texts):
            parts = [cut(text) for text in texts[a:b]]
            get = self.found(parts).__getitem__
            for part in parts:
                yield map(get, part)

    def encode(self, texts: list[str]):
        """The packed ids of each text."""
        return map(b"".join, self.values(texts))


def groups_by_size(values: list, most: int = GROUP):
    """Slices of a list of strings with about ``most`` characters each, so that memory stays bounded in a batch of long texts."""
    start = total = 0
    for i, value in enumerate(values):
        total += len(value or "")
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(values):
        yield start, len(values)
