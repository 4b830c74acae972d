"""Operators against plain versions of what they compute."""

import functools
import hashlib
import itertools
import math
import random
import re
import struct
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.fs
import pytest
import tiktoken
import tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from searchlight.llm import bpe, components, decontam, html_extract, pii, ppm, quality, segments, sharding, simhash, token_counts, token_files
from searchlight.llm.common import new_folder

SF = "/root/testdata/sf0.001"
TIKTOKEN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", "a" * 5000, "  x  \n\n y", "   foo bar 'S's <|endoftext|> ", "日本語テキスト🙂🙂", "!'s ''s", "\t\t\tfoo\n bar\x1cq", "ab" * 3000, "0123456789" * 100, "x'.y a.b ,c .d word.\nThe don't, é,\x0bq ab. ''. x1, 1.5", "ñ́é" * 50, "Á İİ ΣΣ ς"]
TEXT = st.text(st.one_of(st.sampled_from(" \n\t.,'abcdeABC019é  \x1c日🙂́"), st.characters(exclude_categories=["Cs"])), max_size=60)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(TIKTOKEN), special_tokens={})


def ids_of(text):
    return list(memoryview(bpe.codec(TIKTOKEN, public_tokenizers.PATTERN).encode(text)).cast("I"))


def test_bpe_matches_the_library(spark, documents, texts, library):
    for row in bpe.encode_digests(documents, TIKTOKEN, public_tokenizers.PATTERN).collect():
        ids = library.encode_ordinary(texts[row.doc_id])
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(texts[row.doc_id].encode()).hexdigest()


@pytest.mark.parametrize("text", ODD)
def test_bpe_odd_texts(text, library):
    assert ids_of(text) == library.encode_ordinary(text)
    assert bpe.codec(TIKTOKEN, public_tokenizers.PATTERN).decode(ids_of(text)) == text


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_any_text(text):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(TIKTOKEN, public_tokenizers.PATTERN).transducer.ranks, special_tokens={})
    assert ids_of(text) == own.encode_ordinary(text)


def test_bpe_round_trip(spark, documents, texts):
    encoded = bpe.encode_documents(documents, TIKTOKEN, public_tokenizers.PATTERN)
    assert {r.doc_id: r.text for r in bpe.decode_documents(encoded, TIKTOKEN, public_tokenizers.PATTERN).collect()} == texts


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40), st.lists(st.integers(0, 40), max_size=5))
def test_utf8_stream_is_the_same_in_any_parts(data, cuts):
    stream, edges = bpe.Utf8Stream(), [0, *sorted(min(c, len(data)) for c in cuts), len(data)]
    out = "".join(stream.feed(data[a:b]) for a, b in itertools.pairwise(edges)) + stream.finish()
    assert out == data.decode("utf-8", "replace")


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_segments_join_to_the_text(text):
    assert "".join(segments.segments_of(text)) == text


def test_segment_cache_forgets(monkeypatch):
    monkeypatch.setattr(segments, "MAX_ENTRIES", 3)
    asked = []
    cache = segments.SegmentCache(lambda new: [asked.append(s) or s.encode() for s in new], {" known": b" known"})
    for text in ["a bb ccc dddd eeeee a", "a bb f g h i j", "a known " + "x" * 100, "a " + "x" * 100, "ccc k l m n o"]:
        assert list(cache.encode([text, text])) == [text.encode()] * 2
    assert asked.count("a") == 1 and asked.count(" ccc") == asked.count("ccc") == 1 and " known" not in asked
    cache.found([[]])
    assert len(cache.now) <= 3 + 6 and "x" * 100 not in cache.now


def count_of(text):
    return sum(next(token_counts.word_counter(public_tokenizers.path("word_bpe_49k.json")).values([text], token_counts.words)))


def test_token_counts_match_the_library(spark, documents, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = tokenizers.Tokenizer.from_file(path)
    rows = token_counts.count_tokens(documents, path, table_size=50).collect()
    for r in rows:
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 2048)
    for text in [*ODD, "a <|startoftext|>b<|endoftext|> c", "x\x1fy z"]:
        assert count_of(text) == len(t.encode(text, add_special_tokens=False).ids), text


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_token_counts_any_text(text):
    assert count_of(text) == len(_word_tokenizer().encode(text, add_special_tokens=False).ids)


_kept = {}


def _word_tokenizer():
    return _kept.setdefault("w", tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))


def test_token_files(spark, documents, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, folder = tokenizers.Tokenizer.from_file(path), new_folder(spark, "files")
    manifest = token_files.write_token_files(documents, path, folder)
    start = 0
    for r in sorted(token_files.read_token_files(manifest).collect(), key=lambda r: r.doc_id):
        ids = [*t.encode(texts[r.doc_id], add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    # One document alone, and damage is noticed.
    file = manifest.orderBy("file").first().file
    store, where = token_files.open_fs(file)
    with store.open_input_file(where) as source:
        data = bytearray(source.read())
    import io

    f = token_files.TokenFile(io.BytesIO(bytes(data)), len(data))
    i = len(f) // 2
    assert f.ids(i).tolist()[-1] == 0
    data[int(f.begins[i]) + (int(f.begins[i + 1] - f.begins[i])) // 2] ^= 0xFF
    with pytest.raises(Exception):
        token_files.TokenFile(io.BytesIO(bytes(data)), len(data)).ids(i)


def test_token_files_special_strings():
    cache, width = token_files.id_cache(public_tokenizers.path("byte_bpe_50k.json"))
    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in [*ODD, "a <|endoftext|> b", "x<|endoftext|>  y\n"]:
        assert np.frombuffer(next(cache.encode([text])), f"<u{width}").tolist() == t.encode(text, add_special_tokens=False).ids, text


def test_token_files_columns_of_odd_texts():
    """Texts of one column, cut as bytes, have the library's ids, whatever stands at their ends and however small the cache is."""
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(4)
    cache, width = token_files.id_cache(path)
    t = tokenizers.Tokenizer.from_file(path)
    parts = [*" \n\t\r\x0b\x1c\x85\xa0\u2009\u3000ab.,$#'_é日🙂1À", "  ", "   ", "the", " the", "'s", "<|endoftext|>", "<|", "|>", "ab" * 40]
    for _ in range(500):
        texts_ = ["".join(rng.choices(parts, k=rng.randrange(0, 40))) for _ in range(rng.randrange(0, 8))]
        assert [np.frombuffer(x, f"<u{width}").tolist() for x in cache.encode(texts_)] == [t.encode(x, add_special_tokens=False).ids for x in texts_]


def test_token_files_encode_new_words_in_less_time_than_the_library_apart():
    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(6)
    t, ratios = tokenizers.Tokenizer.from_file(path), []
    for _ in range(3):
        words = [" " + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(20_000)]
        cache, _ = token_files.id_cache(path)
        began = time.process_time()
        packed = b"".join(cache.encode(["x" + "".join(words)]))
        own = time.process_time()
        ids = [i for found in t.encode_batch_fast(["x", *words], add_special_tokens=False) for i in found.ids]
        ratios.append((own - began) / (time.process_time() - own))
        assert np.frombuffer(packed, "<u2").tolist() == ids
    assert min(ratios) < 0.8


def plain_fingerprint(text, size=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + size]), 42) for i in range(max(len(words) - size + 1, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, distance):
    parent = {c: c for c in codes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(parent, 2):
        if (a ^ b).bit_count() <= distance:
            parent[root(a)] = root(b)
    groups = defaultdict(list)
    for c in parent:
        groups[root(c)].append(c)
    return groups


@pytest.mark.parametrize("node_size", [2, 256])
def test_near_duplicates(spark, documents, texts, node_size, monkeypatch):
    links = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda d, distance: links(d, distance, node_size))
    fp = {i: plain_fingerprint(t) for i, t in texts.items()}
    least = {}
    for group in plain_components(set(fp.values()), 2).values():
        ids = [i for i, f in fp.items() if f in set(group)]
        least |= dict.fromkeys(ids, min(ids))
    for r in simhash.near_duplicates(documents).collect():
        assert r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == least[r.doc_id]


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("node_size", [2, 10_000])
def test_links_of_dense_codes(spark, distance, node_size):
    rng = random.Random(distance)
    centre = [rng.getrandbits(64) for _ in range(4)]
    codes = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(4))) & (1 << 64) - 1 for c in centre for _ in range(60)}
    frame = spark.createDataFrame([(simhash._signed(c),) for c in codes], "fp long")
    labels = {r.node: r.label for r in components.components(simhash.fingerprint_links(frame, distance, node_size)).collect()}
    got = defaultdict(set)
    for c in codes:
        got[labels.get(simhash._signed(c), simhash._signed(c))].add(c)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, plain_components(codes, distance).values()))


def test_gray_index_finds_every_pair():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base, base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)), base[:10] ^ np.uint64(3)]))
    index = simhash.GrayIndex(codes)
    found = {tuple(sorted((int(index.codes[x, 0]), int(index.codes[y, 0])))) for a, b in index.links(2, pairs=500) for x, y in zip(a, b)}
    assert found == {tuple(sorted((int(a), int(b)))) for a, b in itertools.combinations(codes, 2) if (int(a) ^ int(b)).bit_count() <= 2}


@pytest.mark.parametrize("block_bytes", [2000, 4 << 20])
def test_near_copies(spark, block_bytes):
    """Groups of texts with a few edits are found, others are left alone."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(5000)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows, alike = [], {}
    for group in range(60):
        first = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 400))]
        rows.append((1000 * group, " ".join(first)))
        for copy in range(1, 6):
            words = list(first)
            for _ in range(rng.randrange(1 + len(words) // 50)):
                words[rng.randrange(len(words))] = "new"
            a, b = shingles(first), shingles(words)
            if len(a & b) / len(a | b) >= 0.8:
                rows.append((1000 * group + copy, " ".join(words)))
                alike[1000 * group + copy] = 1000 * group
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    component = {r.doc_id: bytes(r.component) for r in simhash.near_copies(docs, block_bytes=block_bytes).collect()}
    assert sum(component[a] == component[b] for a, b in alike.items()) / len(alike) >= 0.95
    assert len({component[1000 * g] for g in range(60)}) == 60
    left = {r.doc_id for r in simhash.one_of_each(docs, simhash.near_copies(docs)).collect()}
    assert {1000 * g for g in range(60)} <= left and len(left) <= 60 + 0.05 * len(alike)


def test_one_of_each_moves_texts_once(spark):
    """Null ids, equal ids with other texts and repeated rows; a text passes one exchange."""
    rows = [(0, "a", 1), (0, "a", 1), (0, "b", 2), (5, "a", 3), (None, "a", 4), (None, "c", 5), (None, "c", 5), (7, None, 6), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    found = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("component"))
    left = simhash.one_of_each(docs, found)
    assert left.columns == docs.columns and sorted(map(tuple, left.collect()), key=str) == sorted([(0, "a", 1), (0, "b", 2), (None, "c", 5), (7, None, 6)], key=str)
    moved = [line for line in left._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].split("\n") if "Exchange hashpartitioning" in line]
    assert len(moved) <= 2  # the texts, and the keys that are kept


def plain_groups(rows, share=0.8):
    """Components of all pairs that share so much of their five-word shingles."""
    sets = {}
    for i, text in rows:
        w = text.split()
        sets[i] = frozenset(tuple(w[j : j + 5]) for j in range(max(len(w) - 4, 1)))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if root(a) != root(b) and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("block_bytes", "most_broadcast"), [(3000, 1), (4 << 20, 1_000_000)])
def test_near_copies_of_a_large_group(spark, block_bytes, most_broadcast):
    """Variants of one text, most pairs of which share about 0.6, and a family that shares a long passage: as all pairs give, whatever the size of the blocks."""
    rng = random.Random(5)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    first, passage, rows = make(120), make(90), []
    for i in range(250):
        words = list(first)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(len(words))] = rng.choice(("new", "other", f"n{i}"))
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(passage + make(rng.randrange(8, 40)))) for i in range(60)]
    want = plain_groups(rows)
    got = {r.doc_id: bytes(r.component) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=block_bytes, most_broadcast=most_broadcast).collect()}
    pairs = lambda label: {frozenset(p) for p in itertools.combinations(label, 2) if label[p[0]] == label[p[1]]}
    found, true = pairs(got), pairs(want)
    assert found <= true and len(found) >= 0.98 * len(true) and len(true) > 1000


def test_near_copies_at_the_limit(spark):
    """Blocks appended, removed or replaced: pairs at a five-word similarity of 0.8 to 0.85 are found, pairs at 0.7 to 0.8 are not."""
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows = []
    for i in range(600):
        words, kind = make(rng.randrange(100, 400)), i % 3
        k = int(len(words) * rng.uniform(0.05, 0.35))
        at = rng.randrange(len(words) - k)
        copy = [words + make(k), words[:-k], words[:at] + make(k) + words[at + k :]][kind]
        a, b = shingles(words), shingles(copy)
        share = len(a & b) / len(a | b)
        if 0.8 <= share <= 0.85 or 0.7 <= share < 0.8:
            rows += [(2 * i, " ".join(words), share >= 0.8), (2 * i + 1, " ".join(copy), share >= 0.8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, alike boolean")
    for block_bytes in (2000, 4 << 20):
        component = {r.doc_id: bytes(r.component) for r in simhash.near_copies(docs, block_bytes=block_bytes).collect()}
        joined = {yes: [component[d] == component[d + 1] for d, _, own in rows if own == yes and d % 2 == 0] for yes in (True, False)}
        assert min(map(len, joined.values())) >= 40 and sum(joined[True]) / len(joined[True]) >= 0.97 and not any(joined[False])


def test_near_copies_far_from_the_least_set(spark):
    """In a candidate group all sets are compared, not only with the least one: each pair's two texts are one group, pairs are not."""
    words = [f"w{i}" for i in range(200)]
    rows = [(2 * g + c, " ".join([*words[:150], *(f"g{g}x{i}" for i in range(50)), *["end"] * c])) for g in range(20) for c in range(2)]
    component = {r.doc_id: bytes(r.component) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=2000).collect()}
    assert all(component[2 * g] == component[2 * g + 1] for g in range(20)) and len(set(component.values())) == 20


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long")
    labels = {r.node: r.label for r in components.components(edges).collect()}
    assert labels == dict.fromkeys(range(301), 0) | {1000: 1000, 1001: 1000}


def test_quality_counts(spark, documents, texts):
    rows = quality.quality_scores(documents, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    for r in rows:
        t = texts[r.doc_id]
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(windows)
        inside = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = len(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (n < 50 or 100 * len(inside) > 50 * n) and (not r.base_failed or not r.kept)


def test_quality_keeps_good_and_drops_bad(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.quality_scores(docs, labels).join(labels, "doc_id").where("not base_failed").collect()
    kept = lambda q: [r.kept for r in rows if r.quality == q]
    assert np.mean(kept(1)) > 0.99 and np.mean(kept(0)) < 0.3
    again = quality.keep_good(docs, labels)
    assert again.columns == docs.columns and again.count() == quality.quality_scores(docs, labels).where("kept").count()


def test_quality_verdicts(spark, documents, texts):
    """Scores and verdicts against plain multinomials of all documents and of half the trusted ones; the other half gives the threshold."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    half = {i: zlib.crc32(str(i).encode()) % 2 for i in trusted}
    size = 1 << quality.BUCKET_BITS

    def grams(text):
        h = [xxhash.xxh64_intdigest(w.lower()) for w in text.encode().split()]
        h += [(a * int(quality.MULTIPLY_A) + b) % (1 << 64) for a, b in itertools.pairwise(h)]
        return [(x * int(quality.MULTIPLY_B) % (1 << 64)) >> (64 - quality.BUCKET_BITS) for x in h]

    own = {i: grams(t) for i, t in texts.items()}
    every, good = Counter(), Counter()
    for i, found in own.items():
        every.update(found)
        if half.get(i) == 0:
            good.update(found)
    n_good, n_every = good.total() + size, every.total() + size
    ratio = lambda b: math.log((good[b] + 1) / n_good) - math.log((every[b] + 1) / n_every)
    score = {i: sum(map(ratio, found)) / len(found) if found else 0.0 for i, found in own.items()}
    rows = {r.doc_id: r for r in quality.quality_scores(documents, labels).collect()}
    unseen = [score[i] for i in trusted if half[i] == 1 and not rows[i].base_failed]
    least = np.mean(unseen) - quality.DEVIATIONS * np.std(unseen)
    for i, r in rows.items():
        assert r.score == pytest.approx(score[i]) and r.kept == (not r.base_failed and score[i] >= round(float(least), 6))


@pytest.mark.parametrize("most_broadcast", [1_000_000, 0])
def test_quality_takes_all_trusted_documents(spark, most_broadcast):
    """Labels of other documents, however many, leave the model as it is; ids in a broadcast and ids in a join give the same."""
    words = "ab cd ef gh ij kl mn op qr st uv wx".split()
    rows = [(i * 7001 % 300_000, " ".join(words[(i * j + j // 5) % 12] + str(j * i % 17) for j in range(60 + i))) for i in range(60)] + [(None, "a b"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.when(F.col("id") % 3 == 0, 1).alias("toxic"))
    own = quality.fit(docs, labels.join(docs.select("doc_id"), "doc_id", "left_semi"))
    every = quality.fit(docs, labels, most_broadcast=most_broadcast)
    assert own.ratio.any() and np.array_equal(own.ratio, every.ratio) and own.least_score == every.least_score


def base_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = [int(c) for c in m[0] if c.isdigit()]
        if 14 <= len(digits) <= 19 and sum(sum(divmod(d * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


HARD = ["a@b.c_d@e.fg", "x@y", "é1.2.3.4.5.6.7.8 999.1.1.1 0000255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (555) 123-4567. +49 30 1234567890123456", "1" * 20000, "a" * 20000 + "@", "🙂 me@x.org 🙂 me@x.org", "1.2.3.4@5.6", "+" * 50 + "1234567890", "5105 1051 0510 5100 4111111111111111"]


def test_pii_base(spark, texts):
    rows = [*texts.items(), *enumerate(HARD, 10_000)]
    found = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = dict(rows)
    for r in found:
        spans = base_spans(by[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), by[r.doc_id][:80]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == i for _, k, _ in spans) for i in range(4))
        assert set(joined.split(",")) <= set(r.spans.split(","))


def test_pii_terms(spark):
    rows = [(i, f"word{i} common text here zorbulon met jim at jim@corp.example.com about qwx{i} and things {i}") for i in range(6)]
    rows += [(100 + i, f"some common text number {i} with things here about it") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    text = rows[0][1]
    terms = {text[int(s.split(":")[1]) : int(s.split(":")[2])] for s in spans[0].split(",") if s.startswith("term")}
    assert "zorbulon" in terms and not terms & {"common", "text", "things"} and spans[100] == ""
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "zorbulon" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == rows[6][1]
    loose = {r.doc_id: r.text for r in pii.sanitise(docs, remove_from=9.9).collect()}
    assert "[TERM] met jim at [EMAIL]" in loose[0]


def test_pii_terms_of_whole_texts(spark):
    """A term far from the entity is found, removed in all places and also where the entity is not named; copies of one passage are no evidence."""
    filler = lambda i: " ".join(f"body{i * 40 + j}" for j in range(40))
    rows = [(i, f"Dear zorbulon, {filler(i)} yours zorbulon. Write to jim@corp.example.com now") for i in range(30)]
    rows += [(50, f"Met zorbulon {filler(50)}")]
    rows += [(60 + i, f"{filler(60 + i)} {filler(99)} quimbly {filler(98)} ask bob@corp.example.com today {filler(97)} {filler(80 + i)}") for i in range(5)]
    rows += [(200 + i, f"some common text number {i} with dear yours write now met") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any("zorbulon" in clean[i] for i in range(30)) and "[TERM]" in clean[50] and "zorbulon" not in clean[50]
    assert all("quimbly" in clean[60 + i] for i in range(5)) and clean[200] == dict(rows)[200]
    spans = {r.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    assert spans[50] == "term:4:12" and spans[0].count("term:") == 2


def test_ppm(spark, documents, texts, monkeypatch):
    rows = ppm.score_documents(documents, table_size=300).collect()
    train = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2}
    tokens = lambda t: [*t.encode().lower().split(), b"\n"]
    count = Counter(w for t in train.values() for w in tokens(t))
    n, v = sum(count.values()), len(count)
    grams: dict[bytes, Counter] = defaultdict(Counter)
    whole = {i: b"\n" + b" ".join(t.encode().lower().split()) + b"\n" for i, t in texts.items()}
    for i in train:
        for p in range(1, len(whole[i])):
            for k in range(min(ppm.ORDER, p) + 1):
                grams[whole[i][p - k : p]][whole[i][p]] += 1

    @functools.cache
    def score(before, symbol):
        out, barred = 0.0, set()
        for k in range(len(before), -1, -1):
            here = {s: c for s, c in grams.get(before[len(before) - k :], {}).items() if s not in barred}
            if not here:
                continue
            total = sum(here.values()) + len(here)
            if symbol in here:
                return out + math.log10(here[symbol] / total)
            out += math.log10(len(here) / total)
            barred |= set(here)
        return out - math.log10(256 - len(barred))

    for r in rows:
        t, w = tokens(texts[r.doc_id]), whole[r.doc_id]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (r.doc_id not in train, len(t), n)
        assert r.n_known == sum(count[x] > 0 for x in t)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 1) / (n + v + 1)) for x in t))
        assert r.score == pytest.approx(sum(score(w[max(p - ppm.ORDER, 0) : p], w[p]) for p in range(1, len(w))))
    monkeypatch.setattr(ppm, "CHUNK", 20_000)
    apart = {r.doc_id: r.score for r in ppm.score_documents(documents, table_size=10, max_model=1).collect()}
    assert all(apart[r.doc_id] == pytest.approx(r.score) for r in rows)


def test_ppm_hears_the_order_of_words(spark):
    """The same words in another order are another text: shuffled texts score lower than those that follow the corpus."""
    rng = random.Random(2)
    follow = {w: rng.sample(range(40), 3) for w in range(40)}
    name = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra", "su", "ti") for b in ("ba", "de", "go", "vi", "zu")]

    def sentence():
        out = [rng.randrange(40)]
        for _ in range(60):
            out.append(rng.choice(follow[out[-1]]))
        return [name[i] for i in out]

    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, " ".join(sentence())) for i in range(400)]
    rows += [(10_000 + i, " ".join(rng.sample(dict(rows)[i].split(), 61))) for i in held]
    docs = spark.createDataFrame([r for r in rows if r[0] < 400 or zlib.crc32(str(r[0]).encode()) % 7 == 2], "doc_id long, text string")
    score = {r.doc_id: r.score for r in ppm.score_documents(docs).collect()}
    both = [i for i in held if 10_000 + i in score]
    assert both and all(score[i] > score[10_000 + i] for i in both)


def test_ppm_is_a_distribution():
    codes, _ = ppm.events([b"ab abc b", b"", b"b  AB"], 3)
    trie = ppm.Trie(*ppm.all_orders(*ppm.summed(codes, np.ones(len(codes), np.int64))))
    for context in (b" ", b" a", b" ab", b"b a", b"\n", b"xyz"):
        codes = [int.from_bytes(context + bytes([s]), "big") | len(context) << 56 for s in range(256)]
        assert (10 ** trie.log10(np.array(codes, np.uint64))).sum() == pytest.approx(1)


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b, key = j, (key * sharding.MULTIPLIER + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark, documents, texts):
    rows = sharding.shard_rows(documents, buckets=3).collect()
    slots = defaultdict(list)
    for r in rows:
        key = xxhash.xxh64_intdigest(struct.pack("<q", r.doc_id), 42)
        assert (r.shard, r.grown_shard) == (jump(key, 24), jump(key, 25)) and r.grown_shard in (r.shard, 24)
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id].encode()) + 8, zlib.crc32(texts[r.doc_id].encode()))
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def least_distance(item, words):
    row = [0] * (len(words) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(words, 1):
            last, row[j] = row[j], min(last + (a != b), row[j] + 1, row[j - 1] + 1)
    return min(row)


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    make = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, make(rng.randrange(14, 60))) for i in range(30)] + [(30, ["short", "item"]), (31, ["one"])]
    docs = []
    for d in range(250):
        i, item = rng.choice(items[:30])
        words, k = list(item), int(0.2 * len(item) + 1e-9)
        for _ in range(rng.choice([0, 1, k // 2, k, k, k + 3])):
            p, op = rng.randrange(len(words)), rng.random()
            if op < 0.4:
                words[p] = "zz"
            elif op < 0.7:
                del words[p]
            else:
                words.insert(p, "yy")
        docs.append((d, " ".join(make(rng.randrange(40)) + words + make(rng.randrange(40)))))
    docs.append((1000, "a Short, item here"))
    truth = {(d, i) for d, t in docs for i, item in items if least_distance(item, [w.decode() for w in decontam.words_of(t.encode())]) <= int(0.2 * len(item) + 1e-9)}
    frame, benchmark = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for block in (1 << 25, 1500):
        found = {(r.doc_id, r.item_id) for r in decontam.contaminations(frame, benchmark, block_bytes=block).collect()}
        assert found <= truth and len(found & truth) / len(truth) >= 0.95 and (1000, 30) in found
    left = {r.doc_id for r in decontam.drop_contaminated(frame, benchmark, block_bytes=1500).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in found}
    # The keys find the windows: with every window of every item's size embedded, the same is found and nothing else.
    bare = {(r.doc_id, r.item_id) for r in decontam.contaminations(frame, benchmark, prefilter=False).collect()}
    assert bare == found


def test_edit_distance_of_parts():
    rng = np.random.default_rng(1)
    for _ in range(200):
        item, region = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        d, at = decontam.edit_distance(item, region)
        assert d == least_distance(list(item), list(region))
        assert min(least_distance(list(item), list(region[at : at + n])) if n else len(item) for n in range(len(region) - at + 1)) == d


PAGE = """<html><head><title>T</title></head><body><header class="site"><a href="/">Site</a><h1>My Site</h1></header><div class="cookie-notice"><p>We use cookies, okay?</p></div><div id="wrap"><div class="sidebar"><p>Popular posts. Read them all, now.</p></div><div class="content"><h2>Title &amp; more</h2><p>First   para, with <a href=x>link</a> text. It is long enough to matter, and has commas.<p>Second&nbsp;para: more text here, which goes on for a while. Really.</p><ul><li>one thing<li>two things</ul><p>End.</p><div class="comments"><p>Nice post, dude! I like it, a lot.</p></div></div></div><form><p>Sign up</p><input></form><footer>(c) me</footer><script>var x = "<p>no</p>";</script></body></html>"""


def test_html_page():
    assert html_extract.main_text(PAGE) == "Title & more First para, with link text. It is long enough to matter, and has commas. Second para: more text here, which goes on for a while. Really. one thing two things End."


def test_html_articles(spark):
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for (r, p) in zip(html_extract.extract(pages).orderBy("page_id").collect(), pages.orderBy("page_id").collect()):
        article = re.sub("<footer.*", "", p.html[p.html.index("<article>") + 9 :].split("</article>")[0], flags=re.S)
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*(>|$)", "", x.replace("<br>", " "))).split()) for x in re.split(r"<p>|</?h1>|</p>", article)]
        assert r.text == " ".join(filter(None, parts))


@pytest.mark.parametrize("page", ["<" * 50_000, '<a "' * 20_000, "<div>" * 10_000 + "x", "<!--" * 20_000, "<script>" * 20_000, "<p>a" * 5_000, "</p>" * 20_000])
def test_html_broken_markup_is_quick(page):
    html_extract.main_text(page)


def plain_disclosures(rows, least_contexts=3, share=0.9):
    """Every (entity, term) whose mutual information reaches the threshold, by plain counting over documents."""
    named, holding, contexts, n = defaultdict(set), defaultdict(set), {}, len(rows)
    for i, text in enumerate(rows):
        spans, outside, at = base_spans(text), "", 0
        for a, k, b in spans:
            if b > at:
                outside, at = outside + text[at : max(a, at)] + "\n", b
            value = text[a:b].lower() if k < 2 else re.sub("[^0-9]", "", text[a:b])
            own = text[max(a - pii.WIDTH, 0) : b + pii.WIDTH]
            for name in ((k, value), (k, ["@" + value.split("@")[-1], ".".join(value.split(".")[:3]) + ".*", value[:6] + "*", value[:-4] + "*"][k])):
                named[name].add(i)
                contexts.setdefault((name, i), set()).add(own)
        for t in re.findall(r"[^\W_]+(?:['’-][^\W_]+)*", outside + text[at:]):
            if len(t) >= 4:
                holding[t.lower()].add(i)
    out = {}
    for name, ids in named.items():
        for t, own in holding.items():
            both = ids & own
            # one surrounding a document: documents with one mention only in these rows
            if len({tuple(contexts[name, i]) for i in both}) >= least_contexts:
                shared = math.log2(n * len(both) / (len(ids) * len(own)))
                if shared >= share * math.log2(n / len(ids)) - 1e-9:
                    out[pii.KINDS[name[0]] + ":" + name[1], t] = (len(ids), len(own), len(both), shared)
    return out


def test_pii_mutual_information_of_every_pair(spark):
    """Against plain counts: strong, weak and half-way terms, terms inside spans, copies of a passage, overlapping spans, an entity in many documents."""
    rng = random.Random(4)
    words = [f"word{i}" for i in range(60)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(300):
        text = some(25)
        if i % 10 < 6:
            who = rng.randrange(5)
            text += f" ask P{who}@corp.example or so " if who % 2 else f" call +1 (555) 000-000{who} now "
            text += some(12)
            if rng.random() < 0.8:
                text += f" alias{who}"
        if rng.random() < 0.05:
            text += f" alias{rng.randrange(5)} {some(2)}"
        rows.append(text)
    rows += [f"{some(20)} {'same passage ' * 6}only here quux ask Z@corp.example {'same passage ' * 6}{some(20)}" for _ in range(8)]
    rows += [f"{some(14)} 1.1.1.{i} 4111111111111111 {some(14)} gadget" for i in (1, 1, 1, 1, 2)]
    rows += [f"{some(20)} see x@y.zz {some(20)}" for _ in range(200)]
    rows += [f"{some(20)} ask one{i}@acme.example or call +49 30 9988{i:04} {some(12)} widgetry" for i in range(9)]
    want = plain_disclosures(rows)
    found = pii.disclosures(spark.createDataFrame([(r,) for r in rows], "text string")).collect()
    got = {(r.entity, r.t): (r.n_c, r.n_t, r.n_ct, r.shared) for r in found}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert {t for _, t in want} >= {"alias1", "gadget"} and "quux" not in {t for _, t in want}
    assert {e for e, t in want if t == "widgetry"} == {"email:@acme.example", "phone:49309988*"}


def test_pii_many_addresses_in_one_text(spark):
    """Twenty thousand spans in one text take seconds, and stand where plain matching finds them."""
    text = " ".join(f"né{i} who{i}@m{i % 90}.example.com or 10.{i % 256}.7.{i % 99}, 🙂" for i in range(10_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    begin = time.monotonic()
    row = pii.find_spans(docs).collect()[0]
    clean = pii.sanitise(docs).collect()[0].text
    assert time.monotonic() - begin < 60
    assert row.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(text)).encode()).hexdigest()
    assert clean == re.sub(r"10\.[0-9]+\.7\.[0-9]+", "[IP]", re.sub(r"who[^ ]*", "[EMAIL]", text))


def test_pii_generalises_by_class(spark):
    rows = [(i, f"filler{i * 7} Zorbulon met qx77 quietly {'' if i % 5 else 'word'}{i} at jim@corp.example.com about tail{i * 3}") for i in range(12)]
    rows += [(50, "Some Zorbulon, ZORBULON and QX77 quietly"), (51, "card 4111 1111 1111 1111.1.1.1 here")]
    rows += [(100 + i, f"other text number {i} with things here about it") for i in range(150)]
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[50] == "Some [NAME], [NAME] and [CODE] [TERM]" and clean[100] == "other text number 0 with things here about it"
    assert clean[51].count("1111") == 0 and "[CARD]" in clean[51] and "[EMAIL]" in clean[0]


PROSE = ["The first paragraph goes on for a while, with commas, and says something. It is long enough.", "A second one follows; it has more to say, of course, and says it at length, as they do.", "Then a third, which ends the matter, more or less, after some more words of this kind."]
LONGER = "<p>" + "</p><p>".join(PROSE) + "</p>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<body><div class="site-menu"><a href=a>Home</a> <a href=b>News</a></div><article>{LONGER}<div class="commentary"><p>{PROSE[0]}</p></div></article><p>(c) 2020</p></body>', " ".join([*PROSE, PROSE[0]])),
        (f'<body><article>{LONGER}<section class="social-policy"><p>{PROSE[1]}</p></section></article></body>', " ".join([*PROSE, PROSE[1]])),
        (f'<body><article>{LONGER}<section class="social-policy"><p>Be kind.</p></section></article></body>', " ".join([*PROSE, "Be kind."])),
        (f"<body><article>{LONGER}<p>Press <button>OK</button> to go.</p><button>Share</button><div><button><span>Save</span></button> <button>Print</button></div></article></body>", " ".join([*PROSE, "Press OK to go."])),
        (f'<body><article>{LONGER}<div class="share-buttons"><a href="x">Send</a> or copy</div><div class="ad-slot-3">Buy.</div></article></body>', " ".join(PROSE)),
        (f'<body><div id="content">{LONGER}<div class="restaurant-menu-review"><p>{PROSE[2]}</p></div></div><footer>(c) 2020</footer></body>', " ".join([*PROSE, PROSE[2]])),
        (f'<body><div class="post widget">{LONGER}</div><p>(c) 2020</p></body>', " ".join(PROSE)),
        (f'<body><article><h1>Title</h1>{LONGER}<p><a href="x">All about this in a longer text elsewhere</a></p></article></body>', "Title " + " ".join(PROSE) + " All about this in a longer text elsewhere"),
        (f"<body><article>{LONGER}<p>It holds that <math><mi>x</mi><mo>=</mo><mn>1</mn></math> here.</p></article></body>", " ".join(PROSE) + " It holds that x=1 here."),
        (f'<body><div class="row with-sidebar"><article>{LONGER}</article><div class="sidebar"><p>Popular posts. Read them.</p></div></div></body>', " ".join(PROSE)),
        (f'<body><div class="elementor-widget"><div>{LONGER}</div></div><div class="cookie-notice"><p>We use cookies, as you know, and ask you to agree to this. Please do.</p></div></body>', " ".join(PROSE)),
        (f'<body><article>{LONGER}<div id="comments">{"".join(f"<p>{PROSE[i % 3]} I agree, {i}.</p>" for i in range(9))}</div></article></body>', " ".join(PROSE)),
        (f'<body><main>{LONGER}<div class="ad">{PROSE[0]}</div><aside><p>{PROSE[1]}</p></aside><form><p>{PROSE[1]}</p></form></main><div class="page-footer2">{PROSE[2]}</div></body>', " ".join(PROSE)),
    ],
)
def test_html_names_only_weigh(page, text):
    assert html_extract.main_text(page) == text


def test_html_deep_pages_are_quick():
    begin = time.monotonic()
    deep = "<div>" * 3000 + "".join(f"<p>Some text, number {i}, and more of it.</p>" for i in range(3000))
    assert html_extract.main_text(f"<body>{deep}").startswith("Some text, number 0") and time.monotonic() - begin < 2


def test_html_path_ratios():
    """Against plain sums over each tag path."""
    blocks, _ = html_extract.blocks_of(PAGE)
    paths = [tuple(label for label, _ in path) for path, _, _ in blocks]
    ratio = {}
    for p in set(paths):
        own = [b for b, q in zip(blocks, paths) if q == p]
        ratio[p] = (sum(len(t) - k for _, t, k in own) / len(own), sum(sum(c in ".,;:!?" for c in t) for _, t, _ in own) / len(own))
    around = lambda i: [ratio[paths[max(i - 1, 0)]], ratio[paths[i]], ratio[paths[i]], ratio[paths[min(i + 1, len(paths) - 1)]]]
    want = [sum(x for x, _ in around(i)) / 4 * (1 + sum(y for _, y in around(i)) / 4) for i in range(len(paths))]
    assert html_extract.path_ratios(blocks, paths).tolist() == pytest.approx(want)
    assert {b[1] for b in blocks} >= {"We use cookies, okay?", "End.", "Site"} and not any("var x" in b[1] for b in blocks)
