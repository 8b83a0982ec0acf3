"""The phrase index against the scan of every text, and what its plans read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphlake import api
from glyphlake.operators import phrase_index, search
from glyphlake.plans.fixtures import bound, dictionary

from .conftest import DATA

ROWS = [
    ("U+1", "a", "the cat and the hat"), ("U+1", "a", "the cat and the hat"), ("U+1", "b", "hat the cat"), ("U+2", "cat", "sat"), ("U+3", "cat the", None),
    ("U+4", None, ""), (None, "a", "the cat"), ("U+5", "c", "the the the Cat! and-the"), ("U+6", "d", "The Çat, x " * 40), ("U+7", "e", "cat the"),
]
PHRASES = ["the cat", "cat", "the the", "the the the cat", "and the hat", "cat sat", "Cat AND", "çat", "", "zzz", "the zzz", "x the çat x"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("slice_rows", [2, 1_000])
def test_equals_the_scan(spark, tmp_path, fold, slice_rows):
    texts = spark.createDataFrame(ROWS, "codepoint string, hanja string, body string")
    index = phrase_index.write_index(texts, f"file://{tmp_path}/i", fold=fold, buckets=3, slice_rows=slice_rows)
    for phrase in PHRASES:
        assert rows(index.search(phrase)) == rows(search.phrase_search(texts, phrase, fold=fold).select("codepoint", "hanja")), phrase


def test_writes_add_up(spark, tmp_path):
    texts = spark.createDataFrame(ROWS, "codepoint string, hanja string, body string").repartition(2)
    path = f"file://{tmp_path}/i"
    for part in (texts.limit(0), texts.where("codepoint < 'U+3'"), texts.where("codepoint >= 'U+3'")):
        index = phrase_index.write_index(part, path, buckets=3)
    whole = phrase_index.write_index(texts, f"file://{tmp_path}/w", buckets=3)
    assert rows(index.tokens()) == rows(whole.tokens())
    for phrase in PHRASES:
        assert rows(index.search(phrase)) == rows(whole.search(phrase))


def test_reads_the_postings_of_its_tokens_alone(spark, tmp_path):
    index = phrase_index.write_index(bound(spark, DATA, "fts_search"), f"file://{tmp_path}/i", slice_rows=50)
    plan = index.matches("on the")._jdf.queryExecution().toString()
    assert "EqualTo(token,on)" in plan and "EqualTo(token,the)" in plan and "body" not in plan and "PartitionFilters: [isnotnull(bucket" in plan
    # a token of every row is cut into several folders, each with a part of it
    parts = index.postings("the").groupBy("slice").count().collect()
    total = sum(r["count"] for r in parts)
    assert len(parts) == 4 and max(r["count"] for r in parts) < total / 2
    assert index.postings("the").select(F.count_distinct("bucket")).first()[0] == 1


def test_search_command_by_index(spark, tmp_path):
    d = dictionary(spark, DATA)
    index = phrase_index.write_index(d.fts_search, f"file://{tmp_path}/i")
    assert api.search(d, "on the", index=index).collect() == api.search(d, "on the").collect()


def test_parts_follow_the_length_of_texts(spark, tmp_path):
    texts = spark.range(40).selectExpr("concat('U+', id) codepoint", "'a' hanja", "repeat(concat('the cat ', id, ' '), 100) body")
    index = phrase_index.write_index(texts, f"file://{tmp_path}/i", buckets=2, slice_chars=5_000)
    parts = index.postings("cat").groupBy("slice").agg(F.sum(F.size("positions")).alias("n")).collect()
    assert len(parts) > 5 and max(r["n"] for r in parts) < 4_000 / 3
    assert index.search("cat 7 the").select("codepoint").collect() == [("U+7",)]
