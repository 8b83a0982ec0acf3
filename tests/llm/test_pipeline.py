from __future__ import annotations

from collections import Counter

import duckdb
import public_tokenizers
import sentencepiece

from pyspark.sql import functions as F

import corpus_pipeline
from glyphlake.llm import language, length_buckets, mixing
from glyphlake.llm.common import materialize
from glyphlake.llm.queries import ORACLE_SQL

from ..conftest import DATA
from .test_operators import components, least_padding


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = materialize(stage(spark, before, DATA))
        assert docs.columns == columns
        kept[name] = (before, docs)
    before, after = kept["language"]
    model = language.fit(before.where(~language.held_out()))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    sure = {i for i, t in texts.items() if t and any(c.isalpha() for c in t) and model.probabilities(t).max() >= model.least}
    assert {r["doc_id"] for r in after.collect()} == sure
    before, after = kept["quality"]
    before.write.parquet(f"{tmp_path}/judged.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/judged.parquet/*.parquet')")
    want = con.execute(f"SELECT doc_id FROM ({ORACLE_SQL['op2_quality_rules']}) WHERE kept ORDER BY doc_id").fetchall()
    assert sorted((r["doc_id"],) for r in after.collect()) == want and want
    before, after = kept["near_dup"]
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(set(components(before.collect()).values()))
    before, after = kept["mixing"]
    before.select("doc_id", "text", "source").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    columns = [d[0] for d in con.execute(mixing.OP7_SQL).description]
    mixed = [dict(zip(columns, r, strict=True)) for r in con.execute(mixing.OP7_SQL).fetchall()]
    drawn = Counter(r["doc_id"] for r in after.collect())
    assert all(drawn[r["doc_id"]] * r["size"] == r["taken"] for r in mixed) and set(drawn) <= {r["doc_id"] for r in mixed}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = sorted((r["doc_id"], len(library.encode(r["text"] or ""))) for r in docs.collect())
    assert sorted((r["doc_id"], r["length"]) for r in packed) == want and want
    assert sum(r["padding"] for r in packed) == least_padding([n for _, n in want], length_buckets.N_BUCKETS)


def test_stages_on_odd_and_empty_tables(spark, odd, empty):
    for folder in (odd, empty):
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = materialize(stage(spark, docs, folder))
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


CLASHES = ["_size", "_copy", "_copies", "_told", "_content", "_shard", "_local", "_before", "_source", "_level", "_rank", "_source_size", "_target", "_offset", "_one", "_n", "_others", "_judged", "kept", "length", "bucket", "size", "root", "row", "a.b"]


def test_stages_keep_columns_of_any_name(spark):
    """Every extra column comes through with the value that belongs to its document."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.select("*", *[F.concat(F.lit(f"{c}/"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, DATA))
        assert docs.schema.simpleString() == before.schema.simpleString(), name
        rows = docs.collect()
        assert rows and all(r[c] == f"{c}/{r['doc_id']}" for r in rows for c in CLASHES), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).count() == len(rows)
