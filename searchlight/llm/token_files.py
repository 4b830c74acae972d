"""Token ids in files of independent zstandard frames, one a document, with a trailing seek table.

A file holds, in this order: a frame for each document (its ids, little-endian), one skippable frame
with the documents' keys, and the seek table of the seekable zstandard format, itself a skippable
frame: (compressed size, decompressed size, checksum) for each frame, then the footer. Any zstandard
reader can decompress the file; ``TokenFile`` reads the table and then only the frames it is asked for,
and holds each against its checksum (the low 32 bits of XXH64 of the decompressed bytes).

The table is written in ascending order of the key: a range partitioning deals the documents out, each
task sorts its share, encodes it and writes one file, and a small manifest says where each file begins.
A task that is repeated writes its file again under the same name, by a rename once it is complete.
"""

from __future__ import annotations

import os
import posixpath
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchlight.llm.common import materialised, slices, texts
from searchlight.llm.segments import PackedSegments

#: Fixed values of the zstandard seekable format.
SKIPPABLE_KEYS, SKIPPABLE_SEEK, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
#: Before the keys: bytes an id takes, and how many of the first keys are null.
HEAD = struct.Struct("<BQ")


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


class TokenFileWriter:
    """Adds documents to a stream; ``finish`` writes the keys and the seek table."""

    def __init__(self, out, width: int, level: int = 1):
        self.out, self.width = out, width
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.keys, self.entries, self.n_tokens, self.nulls = array("q"), [], 0, 0

    def add(self, key: int | None, ids: bytes) -> None:
        packed = self.compress(ids)
        self.out.write(packed)
        self.nulls += key is None  # sorted files have them first
        self.keys.append(key or 0)
        self.entries.append(ENTRY.pack(len(packed), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.n_tokens += len(ids) // self.width

    def finish(self) -> None:
        keys = HEAD.pack(self.width, self.nulls) + zlib.compress(self.keys.tobytes(), 1)
        self.out.write(struct.pack("<II", SKIPPABLE_KEYS, len(keys)) + keys)
        self.entries.append(ENTRY.pack(8 + len(keys), 0, 0))
        table = b"".join(self.entries)
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table) + FOOTER.size) + table + FOOTER.pack(len(self.entries), CHECKSUMS, SEEKABLE))


class TokenFile:
    """Reads chosen documents of one file. ``source`` is a seekable binary file."""

    def __init__(self, source, size: int):
        self.source = source
        n, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("this file has no seek table with checksums")
        start = size - FOOTER.size - n * ENTRY.size
        table = np.frombuffer(self._at(start, n * ENTRY.size), "<u4").reshape(n, 3)
        self.begins = np.concatenate([[0], np.cumsum(table[:, 0], dtype=np.int64)])
        self.sizes, self.sums = table[:-1, 1].astype(np.int64), table[:-1, 2]
        keys = self._at(int(self.begins[n - 1]) + 8, int(table[-1, 0]) - 8)
        self.width, nulls = HEAD.unpack_from(keys)
        own = np.frombuffer(zlib.decompress(keys[HEAD.size :]), "<i8")
        self.keys = pa.array(own, mask=np.arange(len(own)) < nulls)
        #: Tokens of the file before each document.
        self.starts = np.concatenate([[0], np.cumsum(self.sizes // self.width)])
        self.decompress = zstandard.ZstdDecompressor().decompress

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def __len__(self) -> int:
        return len(self.sizes)

    def ids(self, i: int) -> np.ndarray:
        """The ids of document number i, as unsigned 32-bit integers."""
        data = self.decompress(self._at(int(self.begins[i]), int(self.begins[i + 1] - self.begins[i])))
        if len(data) != self.sizes[i] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.sums[i]:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")


@lru_cache(2)
def id_cache(path: str) -> tuple[PackedSegments, int]:
    """The worker's cache of packed ids by segment, encoded by the tokenizers library, and the bytes an id takes."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    width = 2 if tokenizer.get_vocab_size() <= 1 << 16 else 4
    # A byte-level entry has a character a byte; added tokens stand as they are.
    lengths = np.zeros(max(tokenizer.get_vocab().values()) + 1, np.int64)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        lengths[i] = len(token)
    for i, token in tokenizer.get_added_tokens_decoder().items():
        lengths[i] = len(token.content.encode())
    return PackedSegments(lambda new: [found.ids for found in tokenizer.encode_batch_fast(new, add_special_tokens=False)], lengths, f"<u{width}"), width


def write_token_files(docs: DataFrame, path: str, folder: str, *, end_id: int = 0) -> DataFrame:
    """Writes the files to ``folder`` (shared) and returns their manifest: file, first_key, n_docs, n_tokens, start.

    Null texts are empty (only ``end_id``), null keys come first, rows with equal keys are ordered by their text's checksum.
    An empty table gives no file.
    """

    def run(batches):
        cache, width = id_cache(path)
        end = end_id.to_bytes(width, "little")
        store, where = open_fs(folder)
        store.create_dir(where, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}.tokens.zst"
        part = f"{where}/.{name}.{TaskContext.get().taskAttemptId()}"
        writer, out, first = None, None, None
        for batch in (own for batch in batches for own in slices(batch, 1)):
            keys = batch.column(0).to_pylist()
            if writer is None and keys:
                out, first = store.open_output_stream(part, compression=None), keys[0]
                writer = TokenFileWriter(out, width)
            for key, ids in zip(keys, cache.encode_column(batch.column(1))):
                writer.add(key, ids + end)
        if writer:
            writer.finish()
            out.close()
            store.move(part, f"{where}/{name}")
            yield pa.RecordBatch.from_pydict({"file": [posixpath.join(folder, name)], "first_key": pa.array([first], pa.int64()), "n_docs": [len(writer.entries) - 1], "n_tokens": [writer.n_tokens]})

    source = texts(docs)
    spread = source.withColumn("crc", F.crc32("text")).repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    files = materialised(spread.select("doc_id", "text").mapInArrow(run, "file string, first_key bigint, n_docs bigint, n_tokens bigint"))
    # One row a file; the names ascend with the keys.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the manifest's files; start counts all ids before it."""

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, where = open_fs(file)
                with store.open_input_file(where) as source:
                    f = TokenFile(source, source.size())
                    crc = [zlib.crc32(f.ids(i)) for i in range(len(f))]
                yield pa.RecordBatch.from_arrays([f.keys, pa.array(f.starts[:-1] + start), pa.array(f.sizes // f.width), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # A task a file: a number of partitions that is asked for is not coalesced, however small the manifest is.
    return manifest.select("file", "start").repartition(max(manifest.count(), 1), "file").mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
