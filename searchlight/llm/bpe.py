"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The merges define which two tokens may stand side by side: a and b may, if encoding their joined
bytes gives back a, b. A sequence of tokens is the encoding of its bytes exactly when each two
neighbours may stand side by side. That makes a nondeterministic transducer over bytes: a state is
(last finished token, place in the byte trie of the token being read). ``Transducer`` determinises it
on demand: a deterministic state is the set of live alternatives, and a transition also gives the one
token that the encoding of the bytes read so far ends with. Tokens are certain once one alternative is
left; alternatives differ only inside the bytes of one longest token, so the lookahead is bounded, and a
piece of any length takes linear time. Decoding is a state machine over bytes whose state is the character begun.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from searchlight.llm.common import slices, texts
from searchlight.llm.segments import SegmentCache

ROOT = 0
NEVER = 1 << 30
#: Deterministic transitions and pair verdicts that a worker keeps (about 250 and 130 bytes each); beyond that it starts afresh.
MAX_TRANSITIONS, MAX_PAIRS = 500_000, 400_000
#: Bytes of a piece from which on tokens are emitted while the piece is read.
LONG = 4096
#: A transition is the number of the next state above these bits, and 1 + the token that ends here (or 0) in them.
TOKEN_BITS = 22
TOKEN = (1 << TOKEN_BITS) - 1
#: An alternative is the last finished token (-1 at the start) above these bits, and the place in the trie in them.
NODE_BITS = 32
NODE = (1 << NODE_BITS) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Transducer:
    """Encodes one piece of bytes at a time by the merges in ``ranks``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.child: dict[int, int] = {}
        self.token_at, self.is_leaf = [-1], [True]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.is_leaf[node] = False
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                    self.is_leaf.append(True)
                node = self.child[key]
            self.token_at[node] = rank
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self._reset()

    def _reset(self) -> None:
        self.states: list[tuple] = [(-1 << NODE_BITS | ROOT,)]  # a state's live alternatives by its number
        self.number = {self.states[0]: 0}
        self.moves: dict[int, int] = {}  # number of a state << 8 | byte -> transition
        self.beside: dict[int, bool] = {}
        self.spines: dict[int, tuple] = {}

    def merged(self, piece: bytes) -> list[int]:
        """The merges applied one after the other; for short pieces only."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == NEVER:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _spines(self, token: int) -> tuple[list, list, bool]:
        """What stood at the right end and at the left end of a token while it was merged: (bytes, rank of the merge that ended it) each."""
        found = self.spines.get(token)
        if found is None:
            whole = self.bytes_of[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            right, left, latest = [], [], -1
            while len(parts) > 1:
                rank, at = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank == NEVER:
                    break
                latest = max(latest, rank)
                if at == len(parts) - 2:
                    right.append((parts[-1], latest))
                if at == 0:
                    left.append((parts[0], latest))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            right.append((parts[-1], NEVER))
            left.append((parts[0], NEVER))
            found = self.spines[token] = (right, left, len(parts) == 1)
        return found

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the merges leave a and b as they are when they stand side by side (a is -1 at the start).

        They don't if, at some time, what stands left and right of the border has a merge that comes before both the
        merges that end them; of equal ranks the left one comes first.
        """
        pair = a << TOKEN_BITS | b
        found = self.beside.get(pair)
        if found is None:
            right, _, whole = self._spines(a) if a >= 0 else ([], [], True)
            _, left, also = self._spines(b)
            found, i, j = whole and also, 0, 0
            while found and i < len(right) and j < len(left):
                (x, x_ends), (y, y_ends) = right[i], left[j]
                rank = self.ranks.get(x + y, NEVER)
                found = not (rank < x_ends and rank <= y_ends and rank < NEVER)
                if x_ends <= y_ends:
                    i += 1
                else:
                    j += 1
            self.beside[pair] = found
        return found

    def _move(self, state: int, byte: int) -> int:
        """Determinises one transition."""
        alive, ended = [], 0
        child, beside, token_at, is_leaf = self.child.get, self.beside.get, self.token_at, self.is_leaf
        for way in self.states[state]:
            node = child((way & NODE) << 8 | byte)
            if node is None:
                continue
            last = way >> NODE_BITS
            if not is_leaf[node]:
                alive.append(last << NODE_BITS | node)
            token = token_at[node]
            if token >= 0:
                yes = beside(last << TOKEN_BITS | token)
                if yes is None:
                    yes = self.may_follow(last, token)
                if yes:
                    alive.append(token << NODE_BITS | ROOT)
                    ended = token + 1
        if not alive:
            raise ValueError(f"the vocabulary can't encode byte {byte}")
        key = tuple(alive)
        after = self.number.get(key)
        if after is None:
            after = self.number[key] = len(self.states)
            self.states.append(key)
        move = self.moves[state << 8 | byte] = after << TOKEN_BITS | ended
        return move

    def _emit(self, ended: list[int]) -> list[int]:
        """The tokens of the bytes read so far, followed back from the one that ends last."""
        out, at = [], len(ended)
        while at:
            token = ended[at - 1] - 1
            out.append(token)
            at -= len(self.bytes_of[token])
        out.reverse()
        return out

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.moves) > MAX_TRANSITIONS or len(self.beside) > MAX_PAIRS:
            self._reset()
        out: list[int] = []
        ended: list[int] = []
        state, known = 0, self.moves.get
        for byte in piece:
            move = known(state << 8 | byte) or self._move(state, byte)
            state = move >> TOKEN_BITS
            ended.append(move & TOKEN)
            if len(ended) >= LONG and move & TOKEN and len(self.states[state]) == 1:
                out += self._emit(ended)
                ended.clear()
        return out + self._emit(ended) if out else self._emit(ended)


#: The classes of bytes that the UTF-8 state machine tells apart, and its transitions: a state is what may follow. State 0
#: is between characters, 1 to 3 want as many more continuation bytes, the others want a narrower first one (to keep out
#: overlong forms, surrogates and what lies beyond U+10FFFF). No entry: the bytes are no UTF-8.
CLASS = bytes([0] * 0x80 + [1] * 0x10 + [2] * 0x10 + [3] * 0x20 + [4] * 2 + [5] * 30 + [6] + [7] * 12 + [8] + [7] * 2 + [9] + [10] * 3 + [11] + [4] * 11)
_AFTER_E0, _AFTER_ED, _AFTER_F0, _AFTER_F4 = 4, 5, 6, 7
UTF8 = {(0, 0): 0, (0, 5): 1, (0, 6): _AFTER_E0, (0, 7): 2, (0, 8): _AFTER_ED, (0, 9): _AFTER_F0, (0, 10): 3, (0, 11): _AFTER_F4}
UTF8 |= {(more, continuation): more - 1 for more in (1, 2, 3) for continuation in (1, 2, 3)}
UTF8 |= {(_AFTER_E0, 3): 1, (_AFTER_ED, 1): 1, (_AFTER_ED, 2): 1, (_AFTER_F0, 2): 2, (_AFTER_F0, 3): 2, (_AFTER_F4, 1): 2}


class Utf8Stream:
    """Decodes bytes that arrive in parts, by a state machine whose state outlives a part; bytes that are no UTF-8 become U+FFFD.

    The machine steps through the character that a part begins in and through the last one it has; whole characters
    between them are decoded at once.
    """

    def __init__(self) -> None:
        self.state, self.begun = 0, b""

    def _step(self, byte: int) -> str:
        """What is decided by one more byte."""
        after = UTF8.get((self.state, CLASS[byte]))
        if after is None:
            broken, self.state, self.begun = self.begun, 0, b""
            return "\ufffd" + self._step(byte) if broken else "\ufffd"
        self.state, self.begun = after, self.begun + bytes([byte])
        if after:
            return ""
        whole, self.begun = self.begun, b""
        return whole.decode()

    def feed(self, part: bytes) -> str:
        at, end, out = 0, len(part), []
        while at < end and self.state:
            out.append(self._step(part[at]))
            at += 1
        last = end
        while last > max(at, end - 4) and 1 <= CLASS[part[last - 1]] <= 3:
            last -= 1
        last = max(last - 1, at)  # the last byte that can begin a character
        out.append(part[at:last].decode("utf-8", "replace"))
        out += map(self._step, part[last:])
        return "".join(out)

    def finish(self) -> str:
        rest, self.state, self.begun = self.begun, 0, b""
        return "\ufffd" if rest else ""


class Codec:
    """Encodes and decodes whole texts with one vocabulary."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.cache = SegmentCache(lambda new: map(self._encode_segment, new))

    def _encode_segment(self, segment: str) -> bytes:
        encode = self.transducer.encode
        if segment.isalpha() or segment[0] == " " and segment[1:].isalpha():
            return array("I", encode(segment.encode())).tobytes()
        ids = array("I")
        for piece in self.pieces(segment):
            ids.extend(encode(piece.encode()))
        return ids.tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return next(self.cache.encode([text]))

    def decode_bytes(self, ids, step: int = 1 << 16):
        """The bytes of a sequence of ids, in parts."""
        of = self.transducer.bytes_of.__getitem__
        for i in range(0, len(ids), step):
            yield b"".join(map(of, ids[i : i + step]))

    def decode(self, ids) -> str:
        stream = Utf8Stream()
        return "".join([*map(stream.feed, self.decode_bytes(ids)), stream.finish()])


@lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def _unpack(packed: bytes) -> array:
    ids = array("I")
    ids.frombytes(packed)
    return ids


def encode_documents(docs: DataFrame, path: str, pattern: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<long>) for every text. Null is empty; repeated rows give repeated results; other columns are ignored."""

    def run(batches):
        c = codec(path, pattern)
        for batch in (own for batch in batches for own in slices(batch, 1)):
            ids = [_unpack(packed).tolist() for packed in c.cache.encode([t.decode() for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], [key, "ids"])

    source = texts(docs, key, text)
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, ids array<bigint>")


def decode_documents(encoded: DataFrame, path: str, pattern: str, *, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids). Bytes that are no UTF-8 become U+FFFD; null ids give an empty text."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            out = [c.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], [key, "text"])

    source = encoded.select(key, "ids")
    return source.mapInArrow(run, f"`{key}` {source.schema[0].dataType.simpleString()}, text string")


def encode_digests(docs: DataFrame, path: str, pattern: str, *, keep: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 (digests of the ids and of the bytes that they decode to).

    Null and empty texts have no tokens, equal rows equal results, null ids stay null; other columns are ignored.
    keep: workers keep the transducer and its caches for their next task. Where other stages share the workers' memory,
    each task can let go of them.
    """

    def run(batches):
        c = codec(path, pattern)
        for batch in (own for batch in batches for own in slices(batch, 1)):
            n, sha, back = [], [], []
            for packed in c.cache.encode([t.decode() for t in batch.column(1).to_pylist()]):
                digest, stream = hashlib.sha256(), Utf8Stream()
                for part in c.decode_bytes(_unpack(packed)):
                    digest.update(stream.feed(part).encode())
                digest.update(stream.finish().encode())
                n.append(len(packed) // 4)
                sha.append(hashlib.sha256(packed).hexdigest())
                back.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        if not keep:
            del c
            codec.cache_clear()
            gc.collect()

    return texts(docs).mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
