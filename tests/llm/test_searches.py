"""Operators 11 to 13 beyond their SQL: small shards and blocks, filters of the join, checkpoints."""

from __future__ import annotations

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import fill_middle, lexical, license_scan, retrieval
from glyphlake.llm.common import materialize
from glyphlake.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import DATA, plain


def rows(df):
    return plain([tuple(r) for r in df.collect()], df.columns)


@pytest.mark.parametrize("seed", range(20))
def test_best_of_a_wavelet_shard(seed):
    rng = np.random.default_rng(seed)
    docs, n_terms = int(rng.integers(1, 70)), 9
    pairs = np.unique(rng.integers(0, docs * n_terms, int(rng.integers(1, 200))))
    terms, owners, impacts = pairs % n_terms, pairs // n_terms, rng.integers(0, 5, len(pairs))
    shard = lexical.WaveletShard(docs, terms, owners, impacts)
    for k, opened, floor in ((1, 1, 1), (3, 2, 1), (10, 64, 1), (4, 3, 6)):
        asked = np.unique(rng.integers(0, n_terms + 3, 5))
        weights = rng.integers(0, 4, len(asked))
        score = np.zeros(docs, dtype=int)
        for t, w in zip(asked, weights, strict=True):
            np.add.at(score, owners[terms == t], w * impacts[terms == t])
        want = sorted(((int(s), d) for d, s in enumerate(score) if s >= floor), key=lambda x: (-x[0], x[1]))[:k]
        assert shard.best(asked, weights, k, floor, opened) == want


def test_shards_hold_every_row():
    batches = [pa.RecordBatch.from_pylist([{"doc_id": i, "n": 1, "terms": list(range(i % 5)), "counts": [1] * (i % 5)} for i in range(a, b)]) for a, b in ((1, 8), (8, 9), (9, 40))]
    for docs, postings in ((1, 100), (4, 6), (100, 1), (7, 1_000)):
        parts = list(lexical._shards(iter(batches), docs, postings))
        assert [i for p in parts for i in p.column("doc_id").to_pylist()] == list(range(1, 40))
        assert max(len(p) for p in parts) <= docs


def test_small_shards_and_item_blocks_change_nothing(spark, nameless):
    for folder in (DATA, nameless):
        docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
        assert rows(lexical.ranked_search(docs.repartition(5), items, item_block=3, shard_docs=7)) == rows(QUERIES["op11_lexical_search"](spark, folder))


def test_templates_meet_every_block(spark):
    """Texts with some words of a template missing or moved, against SQL's plain counting."""
    rng = random.Random(5)
    templates = [t.split() for _, t in license_scan.TEMPLATES]
    texts = []
    for _ in range(300):
        words = rng.choice(templates)
        words = [w for w in words if rng.random() > rng.choice([0, 0, 0.05, 0.1, 0.2])]
        rng.shuffle(words) if rng.random() < 0.3 else None
        texts.append(" ".join([*rng.choices(["the", "of", "zig", "zag", "license"], k=rng.randrange(60)), *words, *rng.choices(["in", "foo", "bar"], k=rng.randrange(60))]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in license_scan.scan(docs).collect()}
    hits = 0
    for i, text in enumerate(texts):
        words, labels, best = re.findall(license_scan.TERM, text), set(), 0.0
        for label, c, need, own in license_scan._needs(license_scan.TEMPLATES):
            most = max(len(set(own) & set(words[a : a + 2 * c])) for a in range(0, len(words) + 1, c))
            if most >= need:
                labels.add(label)
                best = max(best, most / len(own))
        base = set(filter(None, got[i]["base_labels"].split(",")))
        assert set(filter(None, got[i]["labels"].split(","))) == labels | base
        assert got[i]["score"] == (1.0 if base else best)
        hits += bool(labels - base)
    assert 50 < hits < 300


@pytest.mark.parametrize("step", [4, 7, 4096])
def test_checkpoints_find_every_code_point(step):
    text = "aé中𠀀" * 50 + "plain" * 30 + "𠀀" * 40
    index = fill_middle.Checkpoints(np.frombuffer(text.encode(), dtype=np.uint8), step)
    for k in range(len(text) + 1):
        byte = len(text[:k].encode())
        assert index.byte_of(k) == byte and index.points_before(byte) == k


def test_outputs_are_rebuilt_whatever_the_step(spark, nameless):
    docs = spark.read.parquet(f"{nameless}/documents.parquet")
    texts = sorted(hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in docs.collect())
    for step in (5, 4096):
        made = fill_middle.fill_in_middle(docs, step=step)
        assert sorted(r[0] for r in made.select(F.sha2(fill_middle.restored(F.col("output"), F.col("form")).cast("binary"), 256)).collect()) == texts
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}


def test_a_hot_document_is_cut_by_checkpoints(spark):
    text = "中a" * 1_500_000
    made = fill_middle.fill_in_middle(spark.createDataFrame([(i, text) for i in range(3)], "doc_id bigint, text string"))
    assert made.where(fill_middle.restored(F.col("output"), F.col("form")) == text).count() == 3


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_license_scan", "op13_fill_middle"])
def test_repeated_reads_agree(spark, name):
    assert name in ORACLE_SQL
    found = QUERIES[name](spark, DATA)
    assert rows(found) == rows(found)


@pytest.mark.parametrize("scale", [2.0**-8, 3_000_000.0, 2.0**40, 2.0**100])
def test_products_are_exact_whatever_their_size(spark, scale):
    """Components from fractions to beyond 64 bits, with repeated ids, against integers of any size."""
    rng = random.Random(7)
    rows = [(i // 2 * 25, [float(np.float32(rng.choice([1, -1, 3, 0.5]) * scale * (1 + rng.randrange(50) / 2**20))) for _ in range(3)]) for i in range(60)]
    rows += [(0, [3000001.0, 2000001.0, 1 / 256]), (1, [3000003.0, 4999999.0, 7 / 256]), (2, [3000003.0, 4999999.0, 8 / 256])]
    vectors = retrieval.quantised(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).withColumn("row", F.monotonically_increasing_id())
    vectors = materialize(vectors)
    got = retrieval.top_k(vectors, vectors.where("vec_id % 50 = 0"), shard_rows=9, query_block=4, seed_rows=8).collect()
    whole = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows]
    want = []
    for a, (query_id, q) in enumerate(whole):
        if query_id % 50 == 0:
            scores = [(sum(x * y for x, y in zip(q, c, strict=True)), i) for b, (i, c) in enumerate(whole) if b != a]
            clipped = [(min(max(s, -(2**63)), 2**63 - 1), i) for s, i in scores]
            want += [(query_id, rank + 1, i, s) for rank, (s, i) in enumerate(sorted(clipped, key=lambda x: (-x[0], x[1]))[:5])]
    if scale < 2.0**40:
        assert sorted(map(tuple, got)) == sorted(want)
    else:  # beyond 64 bits scores are equal, so only they are told
        assert sorted((r["query_id"], r["score"]) for r in got) == sorted((q, s) for q, _, _, s in want)
