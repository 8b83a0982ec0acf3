"""Readers and writers. Schemas are explicit; every file goes through Spark's readers, so any store will do."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.display import file_stem
from ..operators.entry import Dictionary
from ..schemas import TABLES


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One dictionary table from Parquet."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def read_dictionary(spark: SparkSession, folder: str) -> Dictionary:
    return Dictionary(**{name: read_table(spark, folder, name) for name in Dictionary.__dataclass_fields__})


def read_class_index(spark: SparkSession, path: str) -> DataFrame:
    """(codepoint, idx) of a JSON object of code points and indexes."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,int>")).alias("codepoint", "idx"))


def npy_rows(files: DataFrame) -> DataFrame:
    """(file, idx, embedding) of (path, content): 32-bit matrices in NumPy's format; a file is one task, so large sets are many files."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                matrix = np.load(io.BytesIO(content), allow_pickle=False)
                for at in range(0, len(matrix), 4096):
                    part = matrix[at : at + 4096].astype("float32")
                    yield pd.DataFrame({"file": file, "idx": np.arange(at, at + len(part), dtype="int32"), "embedding": list(part)})

    return files.select("path", "content").mapInPandas(rows, "file string, idx int, embedding array<float>")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    return npy_rows(spark.read.format("binaryFile").load(path))


def npy_files(vectors: DataFrame) -> DataFrame:
    """(path, content) of (path, idx, embedding): the vectors of a path, in the order of idx, as one matrix; a path is one task."""

    def saved(group: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        np.save(out, np.stack(group.sort_values("idx")["embedding"]).astype("float32"))
        return pd.DataFrame({"path": group["path"].iloc[:1], "content": [out.getvalue()]})

    return vectors.select("path", "idx", "embedding").groupBy("path").applyInPandas(saved, "path string, content binary")


def read_glyphs(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(path, label, height, width, channels, data) of images in path order; label is the file's stem."""
    images = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder).select("image.*")
    return images.select(F.col("origin").alias("path"), file_stem(F.col("origin")).alias("label"), "height", "width", F.col("nChannels").alias("channels"), "data").orderBy("path")


def read_list(texts: DataFrame, column: str) -> DataFrame:
    """texts with items: a stored JSON list, empty if missing or malformed."""
    return texts.withColumn("items", F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>")))


def as_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, nulls kept."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    as_json(df).write.text(path)
