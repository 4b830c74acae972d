"""Divergence of sources, alignment of tokenizers and repeated passages against plain versions."""

import hashlib
import itertools
import random
import re
import time
from collections import Counter

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from searchlight.llm import align, divergence, queries, repeats

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LONG = "word " * 30_000
ROWS = [(None, "a text without an id, with some words in it"), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "the same text twice"), (5, "the same text twice"), (6, "the same text twice"), (7, "ünï cödé 日本語 🙂 é \x85  x"), (8, "x" * 5000 + " <|endoftext|> a@b.co")]
CLASH = ["n", "p", "term", "postings", "codes", "uid", "part", "k1", "crc", "shared", "less", "spans", "begin", "a", "rank", "value"]


def clashing(df):
    for name in CLASH:
        df = df.withColumn(name, F.lit("extra"))
    return df


# Divergence


def divergence_rows(rows, least=3, top=200):
    """lang, source, part, item, value, rank by dense tables."""
    lower = {**{c: c + 32 for c in range(65, 91)}}
    cut = [(lang or "", source or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(lower))) for lang, source, text in rows]
    out = []
    for lang in sorted({c[0] for c in cut}):
        own = [c for c in cut if c[0] == lang]
        seen = Counter(t for c in own for t in set(c[2]))
        kept = sorted(t for t, n in seen.items() if n >= least)
        counts = {s: Counter(t for c in own if c[1] == s for t in c[2] if seen[t] >= least) for s in {c[1] for c in own}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        shares, q = {s: share(c) for s, c in counts.items()}, share(sum(counts.values(), Counter()))
        gap = lambda p, q: (p - q) ** 2 // q
        for s, p in shares.items():
            pairs = [(o, sum(gap(p[t], r[t]) for t in kept)) for o, r in shares.items() if o != s]
            terms = [(t, gap(p[t], q[t])) for t in kept if counts[s][t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(items[:most])]
    return sorted(out)


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


@pytest.mark.parametrize("block", [1, 7, 10**6])
def test_divergence_is_that_of_dense_tables(spark, block):
    rng = random.Random(block)
    words = ["Straße", "straße", "naïve", "NAÏVE", "x", "日本", "Ab", "aB", "c1d", "é_é", "zz"]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", None, "é"]), " ".join(rng.choices(words, k=rng.randrange(0, 9))) if rng.random() < 0.9 else None) for _ in range(60)]
    rows += [rows[0]] * 4 + [("alone", "only", "no term here is in three documents"), ("void", "a", ""), ("void", "b", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    found = divergence.source_divergence(clashing(docs).repartition(3), block=block, top=4).select(COLUMNS)
    assert sorted(map(tuple, found.collect())) == divergence_rows(rows, top=4)


def test_divergence_equals_its_sql(spark):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    found = queries.QUERIES["op11_divergence"](spark, SF).select(COLUMNS)
    assert sorted(map(tuple, found.collect())) == sorted(c.execute(f"SELECT {', '.join(COLUMNS)} FROM ({divergence.SQL})").fetchall())


def test_divergence_merge_across_batches(spark):
    """Terms that lie in several batches of three rows, at their ends or within, add up as a whole; rare ones go."""
    runs = [(lang, f"t{t}", 1 + (t + k) % 2, [(f"s{k % 3}", k + 1)]) for lang in ("a", "b") for t in range(30) for k in range(t % 8)]
    want = {}
    for lang, term, n_docs, ((source, n),) in runs:
        docs, postings = want.setdefault((lang, term), [0, {}])
        want[lang, term][0] = docs + n_docs
        postings[source] = postings.get(source, 0) + n
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        found = divergence.merge_runs(spark.createDataFrame(runs, divergence.POSTINGS), 4).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {(r.lang, r.term): (r.n_docs, [tuple(x) for x in r.postings]) for r in found} == {k: (n, sorted(p.items())) for k, (n, p) in want.items() if n >= 4} and len(found) > 20


class Passed:
    """Stands for a DataFrame whose rows are dealt out and sorted already, and gives what would run over them."""

    repartition = sortWithinPartitions = lambda self, *columns: self
    mapInArrow = lambda self, run, schema: run


def merge_input(rng, n):
    rows = sorted(((rng.choice("ab"), f"t{rng.randrange(n // 4)}é", rng.randrange(1, 3), [{"source": s, "n": rng.randrange(1, 9)} for s in rng.sample(["s1", "s2", "é", "", "\U0001f642", "\uffee"], rng.randrange(1, 4))]) for _ in range(n)), key=lambda r: (r[0], r[1].encode()))
    kinds = [pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("source", pa.string()), ("n", pa.int64())]))]
    columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
    return rows, pa.RecordBatch.from_arrays(columns, ["lang", "term", "n_docs", "postings"])


@pytest.mark.parametrize("n, size", [(1, 5), (40, 1), (300, 2), (300, 7), (2000, 500)])
def test_divergence_merge_of_any_batches(n, size):
    rows, whole = merge_input(random.Random(n + size), max(n, 4))
    want = {}
    for lang, term, n_docs, postings in rows:
        docs, counts = want.setdefault((lang, term), [0, Counter()])
        want[lang, term][0] += n_docs
        counts.update({x["source"]: x["n"] for x in postings})
    run = divergence.merge_runs(Passed(), 5)
    batches = [whole.slice(i, size) for i in range(0, whole.num_rows, size)]
    found = [r for batch in run([whole.slice(0, 0), *batches, whole.slice(0, 0)]) for r in batch.to_pylist()]
    plain = [(lang, term, docs, sorted(counts.items())) for (lang, term), (docs, counts) in want.items() if docs >= 5]
    assert [(r["lang"], r["term"], r["n_docs"], [(x["source"], x["n"]) for x in r["postings"]]) for r in found] == plain
    assert list(run([])) == list(run([whole.slice(0, 0)])) == []


def test_divergence_merges_in_less_time_than_rows_are_read_one_by_one():
    _, whole = merge_input(random.Random(9), 60_000)
    batches, ratios = [whole.slice(i, 10_000) for i in range(0, whole.num_rows, 10_000)], []
    for _ in range(3):
        began = time.process_time()
        assert sum(b.num_rows for b in divergence.merge_runs(Passed(), 3)(batches)) > 10_000
        merged = time.process_time()
        rows = [columns for b in batches for columns in zip(*(b.column(i).to_pylist() for i in range(3)))]
        ratios.append((merged - began) / (time.process_time() - merged))
    assert len(rows) == 60_000 and min(ratios) < 1


def test_divergence_writes_blocks_in_less_time_than_it_fills_them():
    texts = [(f"s{i % 6}", " ".join(f"w{chr(97 + j % 26)}{chr(97 + i % 26)}{'abcdefghij'[i // 26 % 10]}{'klmnopqrst'[j // 26 % 10]}x{'uvwxyz'[i % 6]}" for j in range(250)).encode()) for i in range(1500)]
    ratios = []
    for _ in range(3):
        block, began = divergence.Block(), time.process_time()
        for source, text in texts:
            block.add("en", source, text)
        filled = time.process_time()
        rows = sum(batch.num_rows for batch in block.run())
        ratios.append((time.process_time() - filled) / (filled - began))
    assert rows > 50_000 and min(ratios) < 1


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


def test_long_texts_are_cut_between_terms():
    text = ("Alpha βeta " * 5000).encode()
    assert b" ".join(b" ".join(p.split()) for p in divergence.pieces(text, 100)).split() == text.translate(divergence.TERM_BYTES).split()


# Alignment


@pytest.fixture(scope="module")
def own():
    return align.Aligner(A, B)


def plain_alignment(own, text):
    """(ids of A, ids of B) of each group, and links; None if there are no tokens."""
    a, b = (own.a.encode(" " + text, add_special_tokens=False).ids, own.b.encode(text)) if text else ([], [])
    raw_a, raw_b = [own.bytes_a[i] for i in a], [own.bytes_b[i] for i in b]
    if not text or {b"".join(raw_a), b"".join(raw_b)} != {(" " + text).encode()}:
        return None
    ends_a, ends_b = (list(itertools.accumulate(map(len, raw))) for raw in (raw_a, raw_b))
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        m, n = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append((a[i:m], b[j:n]))
        links.append((a[m - 1], b[n - 1]))
        i, j = m, n
    return groups, links


def alignment_rows(own, rows):
    found = [(i, plain_alignment(own, text)) for i, text in rows]
    n = Counter(link for _, x in found if x for link in x[1])
    most = {b: max(c for (_, other), c in n.items() if other == b) for _, b in n}
    for i, x in found:
        groups, links = x or ([], [])
        digest = hashlib.sha256(";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()).hexdigest() if x else ""
        yield i, sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(n[x] == most[x[1]] for x in links), sum(n[x] for x in links), digest


ODD = ["a" * 5000, "  x  \n\n y", " foo 'S's <|endoftext|> ", "日本語テキスト🙂🙂" * 100, "\t\t\tfoo\n bar\x1cq.\r\n  x.\r", "ab" * 900, "x'.y a.b ,c .d word.\nThe don't, é,\x0bq", "ñ́é" * 50, " ", "  ", "\n", "a▁b", "a▁ b", "<s> </s> <unk> <0x0A>", "trailing  ", "x　y\xa0z\x85q   w", "\x00\x01", "日本語、テキスト。" * 90, "word, " * 700, "a.b.c,d" * 200, ");\r\n]\rx" * 60]
PARTS = [" ", "  ", "\n", "\r", "▁", "a", "b", "the", " the", "ing", "é", "日", "本", ".", ",", "'s", "\t", "x", "🙂", "1", "23", "-", ")"]
ALIGNED = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
by_text = lambda row: tuple(map(str, row))


@pytest.mark.parametrize("chunk, most_pairs", [(1 << 15, 10**6), (50, 10**6), (7, 10)])
def test_alignment(spark, own, chunk, most_pairs):
    rng = random.Random(chunk)
    rows = ROWS[:4] + ROWS[5:] + list(enumerate(ODD, 20)) + [(100 + i, "".join(rng.choice(PARTS[:4] * (i % 9 == 0) + PARTS[i % 8 != 0 and 5 or 3 :]) for _ in range(rng.randrange(1, 200)))) for i in range(60)]
    found = align.align_tokenizers(clashing(spark.createDataFrame(rows, "doc_id long, text string")), A, B, chunk=chunk, fan=3, most_pairs=most_pairs).select(ALIGNED)
    assert sorted(map(tuple, found.collect()), key=by_text) == sorted(alignment_rows(own, rows), key=by_text)


def test_alignment_of_documents_and_of_nothing(spark, own):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.QUERIES["op12_alignment"](spark, SF).select(ALIGNED)
    assert sorted(map(tuple, found.collect())) == sorted(alignment_rows(own, [(r.doc_id, r.text) for r in docs.collect()]))
    assert align.align_tokenizers(docs.limit(0), A, B).collect() == []


def test_fragments_compose_in_any_order(own):
    """Tokens dealt out to chunks of any ranges, the two sides apart, compose to the fragment of all, however they are bracketed."""
    rng = random.Random(5)
    same = lambda x, y: (x.head, x.cut, b";".join(x.groups), x.codes, x.tail) == (y.head, y.cut, b";".join(y.groups), y.codes, y.tail)
    for text in ["the cat, sat on the mat. " * 3, "日本語テキスト" * 6, "don't stop\n\n x" * 4]:
        whole = own.region(" " + text, 0, " " + text, 0)
        for _ in range(60):
            cuts = lambda n: [0, *sorted(rng.choices(range(n + 1), k=3)), n]
            sides = [list(itertools.pairwise(cuts(len(ids)))) for ids in (whole.a, whole.b)]
            chunks = [align.Fragment.of(align.Region(whole.a[i:j], whole.ends_a[i:j], whole.b[m:n], whole.ends_b[m:n])) for (i, j), (m, n) in zip(*sides)]
            x, y, z, w = chunks
            orders = [((x + y) + z) + w, x + (y + (z + w)), (x + y) + (z + w), (x + (y + z)) + w, align.Fragment() + x + y + z + w + align.Fragment()]
            assert all(same(o, align.Fragment.of(whole)) for o in orders)


# Repeats


def repeat_rows(rows, window):
    cut = [(i, re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())) for i, text in rows]
    first: dict = {}
    for i, words in cut:
        for k in range(len(words) - window + 1) if i is not None else ():
            key = tuple(words[k : k + window])
            first[key] = min(first.get(key, i), i)
    for i, words in cut:
        gone = set()
        for k in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        yield i, len(words), len(gone), hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()


@pytest.mark.parametrize("window, part, alphabet", [(2, 1 << 20, "ab"), (5, 64, "ab"), (5, 1 << 20, "abcdefghij"), (8, 40, "abcdefghij"), (50, 1 << 20, "abc"), (50, 200, "abcdefghij")])
def test_repeats(spark, window, part, alphabet):
    rng = random.Random(window)
    pool = [" ".join(rng.choices(alphabet, k=rng.randrange(3, 90))) for _ in range(12)]
    piece = lambda: rng.choice(pool) if rng.random() < 0.5 else " ".join(rng.choices("abcdefghijklmnop", k=rng.randrange(0, 30)))
    rows = [(rng.choice([None] + [i] * 6 + [rng.randrange(100)]), "\x0b".join(piece() for _ in range(rng.randrange(0, 6)))) for i in range(110)]
    rows += [(500, "a " * 300), (501, "a " * 290), (501, "b" + " a" * 200), (502, None), *ROWS]
    found = repeats.remove_repeats(clashing(spark.createDataFrame(rows, "doc_id long, text string")).repartition(3), window=window, part=part)
    assert sorted(map(tuple, found.collect()), key=by_text) == sorted(repeat_rows(rows, window), key=by_text)


def test_repeats_of_documents_and_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = queries.QUERIES["op13_repeats"](spark, SF).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(map(tuple, found.collect())) == sorted(repeat_rows([(r.doc_id, r.text) for r in docs.collect()], 50))
    assert repeats.remove_repeats(docs.limit(0)).collect() == []


def test_a_screen_hits_all_that_is_there(spark):
    ids = spark.range(0, 5000, 7).withColumnRenamed("id", "k")
    rows = repeats.screened(spark.range(3000).select(F.col("id").alias("k")).unionByName(spark.createDataFrame([(None,)], "k long")), ids, "k").collect()
    hits = {r.k for r in rows if r.hit}
    assert len(rows) == 3001 and set(range(0, 3000, 7)) <= hits and len(hits) < 460
    assert repeats.among(spark.range(50).select(F.col("id").alias("k")), ids, "k").count() == 8 and repeats.among(spark.range(50).select(F.col("id").alias("k")), ids.limit(0), "k").count() == 0


def test_equal_passages_have_equal_symbols():
    """What the rounds make within a passage does not depend on what stands around it."""
    rng = random.Random(2)
    passage = [rng.choice([b"x", b"y", b"zz", b"q"]) for _ in range(200)]
    seen = []
    for _ in range(8):
        before, after = ([rng.choice([b"x", b"y", b"u"]) for _ in range(rng.randrange(0, 40))] for _ in range(2))
        p = repeats.Parsed([before + passage + after])
        at = len(before)
        made = {(int(name[0, i]), int(b[i]) - at, int(e[i]) - at) for name, b, e, low, high in p.rounds() for i in range(len(b)) if low[i] >= at and high[i] <= at + len(passage)}
        seen.append(made)
    assert all(s == seen[0] for s in seen) and max(e - b for _, b, e in seen[0]) > 20
