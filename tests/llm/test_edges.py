"""Every operator and pipeline stage on nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from searchlight.llm import bpe, decontam, html_extract, pii, ppm, quality, sharding, simhash, token_counts, token_files
from searchlight.llm.common import new_folder

LONG = "word " * 30_000
ROWS = [(None, "a text without an id, with some words in it"), (1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "the same text twice"), (5, "the same text twice"), (6, "the same text twice"), (7, "ünï cödé 日本語 🙂 é \x85  x"), (8, "x" * 5000 + " <|endoftext|> a@b.co")]
CLASH = ["lang", "row", "fp", "score", "bucket", "shard", "word", "n", "half", "trusted", "component", "label", "t", "s", "size", "ids", "file", "start", "crc", "code"]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(ROWS, "doc_id long, text string")
    for name in CLASH:
        out = out.withColumn(name, F.lit("extra"))
    return out


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (4, 1, 0), (None, 1, None), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "nothing like this is in any document at all"), (2, None), (None, ""), (3, "the same text twice")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


TIKTOKEN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def operators(spark, tables, docs):
    labels, benchmark = spark.read.parquet(f"{tables}/labels.parquet"), spark.read.parquet(f"{tables}/benchmark.parquet")
    return {
        "quality": lambda: quality.quality_scores(docs, labels),
        "bpe": lambda: bpe.encode_digests(docs, TIKTOKEN, public_tokenizers.PATTERN),
        "pii": lambda: pii.find_spans(docs),
        "simhash": lambda: simhash.near_duplicates(docs),
        "ppm": lambda: ppm.score_documents(docs),
        "sharding": lambda: sharding.shard_rows(docs),
        "counts": lambda: token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")),
        "files": lambda: token_files.read_token_files(token_files.write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "t"))),
        "decontam": lambda: decontam.contaminations(docs, benchmark),
    }


NAMES = ["quality", "bpe", "pii", "simhash", "ppm", "sharding", "counts", "files", "decontam"]


@pytest.mark.parametrize("name", NAMES)
def test_edge_rows(spark, tables, docs, name):
    rows = operators(spark, tables, docs)[name]().collect()
    if name == "decontam":
        assert sorted((r.doc_id, r.item_id) for r in rows) == [(5, 3), (5, 3), (6, 3)]
        return
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in ROWS)
    by = {r.doc_id: r for r in rows}
    if name == "simhash":
        assert by[1].fingerprint == by[2].fingerprint == by[3].fingerprint == "0" * 16 and by[3].component_id == 1
        assert by[6].component_id == 5
    if name == "files":
        assert by[1].n_tokens == by[2].n_tokens == 1 and by[None].start == 0
    if name == "ppm":
        assert by[1].n_tokens == by[2].n_tokens == by[3].n_tokens == 1 and all(r.score < 0 for r in rows)
    if name == "quality":
        assert not by[1].kept and by[1].n_words == 0 and by[4].n_words == by[4].n_repeat_words == 30_000


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, tables, docs, name):
    assert operators(spark, tables, docs.limit(0))[name]().collect() == []


@pytest.mark.parametrize("stage", range(5))
def test_stages(spark, tables, docs, stage):
    name, run = corpus_pipeline.STAGES[stage]
    out = run(spark, docs, tables)
    rows = out.collect()
    if stage < 4:
        assert out.columns == docs.columns
    ids = [r.doc_id for r in rows]
    if name == "near_duplicates":
        assert ids.count(5) == 1 and 6 not in ids and ids.count(1) == 1 and 2 not in ids
    if name == "decontamination":
        assert 5 not in ids and 6 not in ids and len(ids) == 7
    if name == "sanitisation":
        texts = {r.doc_id: r.text for r in rows}
        assert texts[1] is None and texts[8].endswith("<|endoftext|> [EMAIL]") and len(ids) == len(ROWS)
    assert run(spark, docs.limit(0), tables).collect() == []


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "x"), (2, "u", "", "x"), (None, "u", "<p>Some text here.</p>", "x"), (4, "u", "<div>" * 3000 + "deep", "x"), (4, "u", "<div>" * 3000 + "deep", "x")], "page_id long, url string, html string, text string")
    rows = html_extract.extract(pages).collect()
    assert sorted((r.page_id or 0, r.text) for r in rows) == [(0, "Some text here."), (1, ""), (2, ""), (4, "deep"), (4, "deep")]
    assert all(r.n_chars == len(r.text) for r in rows)
    assert html_extract.extract(pages.limit(0)).collect() == []
