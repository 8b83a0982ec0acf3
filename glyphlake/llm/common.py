"""What the operators share: table access, the word rule, the shared folder, distributed ranks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder

#: A word is a run of characters other than these six; the class body works in Java, RE2 and Python.
BLANK = r"\x20\x09-\x0D"
WORD = f"[^{BLANK}]+"
BLANK_CHARS = " \t\n\x0b\x0c\r"
#: Shards of a key whose rows are ranked together; a rank never needs more than one shard's rows in a task.
SHARDS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage in a way that survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def apart(docs: DataFrame, *read: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns that are read, and all others in one struct, so that a stage's own names meet no other.

    The second result gives a frame that still has those columns the columns of docs back, in their order. A column
    that is read but missing is null in between.
    """
    own = {c: F.col(f"`{c}`") if c in docs.columns else F.lit(None).cast("string").alias(c) for c in read}
    others = [c for c in docs.columns if c not in read]
    slim = docs.select(*own.values(), F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others")) if others else docs.select(*own.values())
    at = lambda c: F.col(c) if c in read else F.col("_others").getField(c).alias(c)
    return slim, lambda df: df.select(*map(at, docs.columns))


def word_array(text: Column) -> Column:
    """Words of text (null: none), in order."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANK_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{BLANK}]+"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def slices(texts: pa.Array, size: int) -> Iterator[pa.Array]:
    """An Arrow text column in parts of about so many bytes, one text at least; what a part needed is given back before the next."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else None
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield texts.slice(at, to - at)
        pa.default_memory_pool().release_unused()
        at = to


def md5_number(*parts: Column) -> Column:
    """The first 32 bits of md5 over the parts; the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 8), 16, 10).cast("bigint")


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (fixed constants of a common finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranked(df: DataFrame, group: list[str], levels: list[str], order: list[Column], shard: Column, out: str) -> DataFrame:
    """Adds column out: the 1-based rank in each group by levels, then shard, then order. Keys must not be null.

    A group is never sorted in one task: rows are ranked within (group, levels, shard), and the ranks
    before each of those come from a prefix sum over their counts, a table with one row for each. The
    join with that table reuses the partitioning of the ranking.
    """
    keys = [*group, *levels, "_shard"]
    df = df.withColumn("_shard", shard)
    counts = df.groupBy(keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy(*levels, "_shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = df.withColumn("_local", F.row_number().over(Window.partitionBy(keys).orderBy(*order)))
    return local.join(counts, keys).withColumn(out, F.col("_before") + F.col("_local")).drop("_shard", "_local", "_before")
