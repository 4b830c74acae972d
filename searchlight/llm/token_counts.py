"""Token counts by a two-tier lookup, without shuffling a pre-token.

Tier one is a compact table (word -> number of tokens) of frequent words, made from a bounded sample of
documents and broadcast; its size is bounded by ``table_size``. Tier two is a cache in each worker:
words outside the table are encoded once and kept. The tables only save time: every word of every text
is counted, whatever the sample holds.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchlight.llm.common import WHITE_SPACE, slices, texts
from searchlight.llm.segments import MAX_LENGTH, SegmentCache

words_of = re.compile(f"[^{WHITE_SPACE}]+").findall
#: White space for Python that the tokenizer takes for other characters.
ODD_SPACE = re.compile("[\x1c-\x1f]").search


@lru_cache(2)
def word_counter(path: str) -> SegmentCache:
    """The worker's cache of token numbers by word (tier two), over the tokenizer file at ``path``.

    The tokenizer turns white space into one blank and drops it between words, so words are counted apart.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return SegmentCache(lambda new: map(len, tokenizer.encode_batch_fast(new, add_special_tokens=False)))


def words(text: str) -> list[str]:
    return words_of(text) if ODD_SPACE(text) else text.split()


def frequent_lengths(docs: DataFrame, path: str, *, sample_rows: int = 4096, table_size: int = 32768) -> dict[str, int]:
    """At most ``table_size`` of the most frequent words in at most ``sample_rows`` documents, with their token numbers."""

    def run(batches):
        from collections import Counter

        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(1):
                seen.update(w for w in words(value.as_py().decode()) if len(w) <= MAX_LENGTH)
        top = sorted(seen, key=lambda w: (-seen[w], w))[:table_size]
        yield pa.RecordBatch.from_arrays([pa.array(top, pa.string()), pa.array(list(word_counter(path).encode_all(top)) if top else [], pa.int64())], ["word", "n"])

    # A limit alone would move that many rows from each partition.
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = texts(docs) if share == 1 else texts(docs).sample(fraction=share, seed=7)
    return dict(sample.limit(sample_rows).coalesce(1).mapInArrow(run, "word string, n bigint").limit(table_size).collect())


def count_tokens(docs: DataFrame, path: str, *, limit: int = 2048, sample_rows: int = 4096, table_size: int = 32768) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit). Null is empty; each row counts by itself."""
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, sample_rows=sample_rows, table_size=table_size))

    def run(batches):
        count = word_counter(path)
        count.table = table.value
        for batch in (own for batch in batches for own in slices(batch, 1)):
            raw = batch.column(1).to_pylist()
            n_tokens = list(map(sum, count.values([value.decode() for value in raw], words)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array(n_tokens, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return texts(docs).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_tokens bigint").withColumn("over_limit", F.col("n_tokens") > limit)
