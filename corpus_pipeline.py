"""Corpus pipeline: each stage is one of the operators, and works on what the stage before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glyphlake.llm.common import materialize
from glyphlake.llm.language import language_stage
from glyphlake.llm.length_buckets import packing_stage
from glyphlake.llm.mixing import mix_stage
from glyphlake.llm.near_dup import near_dup_stage
from glyphlake.llm.quality import quality_stage

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language_stage),
    ("quality", quality_stage),
    ("near_dup", near_dup_stage),
    ("mixing", mix_stage),
    ("packing", packing_stage),
]
#: Trained models and iterative grouping have no SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in order over documents; each result is written to the shared folder and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
