"""The home page's counts, kept up to date: new rows are counted by themselves and added to what was counted before.

What is kept is a table of (measure, bucket, bits, n), appended to with each addition. A plain count is a sum of n. A count of
different code points is exact: each is a bit at its number, in maps of 32,768 bits; maps of one bucket are joined by OR, so a
code point that was there before is not counted twice, whichever addition it came with. No addition reads an earlier row,
and the counts read only the maps: for a million code points some 125 kB for each addition that touches all of them.

Scale: an addition aggregates by (measure, bucket) before its shuffle. compact() joins the maps of all additions, when many
have come, into a new folder, so that a reader of the old one isn't disturbed.

Defined results: code points that aren't U+ and hexadecimal digits, and null ones, are in no count of different ones; rows
count as rows whatever they hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from .entry import Dictionary

SCHEMA = "measure string, bucket bigint, bits binary, n bigint"
DISTINCT = ("with_reading", "with_meaning", "families")
COUNTED = ("characters", "family_rows")


def _number(codepoint: Column) -> Column:
    """The number that a code point names; null for any other text."""
    digits = F.nullif(F.regexp_extract(codepoint, r"^U\+([0-9A-F]{4,8})$", 1), F.lit(""))
    return F.conv(digits, 16, 10).cast("bigint")


def _rows(df: DataFrame, measure: str, bucket: Column | None = None) -> DataFrame:
    by = df.groupBy(F.lit(measure).alias("measure"), (F.lit(0) if bucket is None else bucket).cast("bigint").alias("bucket"))
    return by.agg(F.lit(None).cast("binary").alias("bits"), F.count("*").alias("n"))


def _distinct(df: DataFrame, codepoint: str, measure: str) -> DataFrame:
    numbers = df.select(_number(F.col(codepoint)).alias("number")).where("number IS NOT NULL")
    by = numbers.groupBy(F.lit(measure).alias("measure"), F.bitmap_bucket_number("number").alias("bucket"))
    return by.agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"), F.lit(0).cast("bigint").alias("n"))


class HomeCounts:
    """Counts kept in a folder of Parquet files."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or shared_folder(spark)

    def add(self, new: Dictionary) -> None:
        """Counts the rows of new, which were in no addition before."""
        family = new.variant_family.where("component_size > 1")
        parts = [
            _rows(new.characters_ids, "characters"), _rows(family, "family_rows"), _rows(new.characters_structure, "radical", F.col("radical_idx")),
            _distinct(new.character_readings, "codepoint", "with_reading"), _distinct(new.character_meanings, "codepoint", "with_meaning"), _distinct(family, "representative", "families"),
        ]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        whole.write.mode("append").parquet(self.path)

    def merged(self) -> DataFrame:
        """One row for each measure and bucket."""
        kept = self.spark.read.schema(SCHEMA).parquet(self.path)
        return kept.groupBy("measure", "bucket").agg(F.bitmap_or_agg(F.coalesce("bits", F.lit(b""))).alias("bits"), F.sum("n").alias("n"))

    def stats(self) -> DataFrame:
        """One row of counts, as browse.db_stats gives them."""
        at = lambda m, value: F.coalesce(F.sum(F.when(F.col("measure") == m, value)), F.lit(0)).alias(m)
        kept = self.merged().where(F.col("measure") != "radical")
        counts = {**{m: F.col("n") for m in COUNTED}, **{m: F.bitmap_count("bits") for m in DISTINCT}}
        return kept.agg(*[at(m, counts[m]) for m in ("characters", "with_reading", "with_meaning", "family_rows", "families")])

    def radical_index(self, radicals: DataFrame) -> DataFrame:
        """Every radical with the number of its characters, as browse.radical_index gives it."""
        n = self.merged().where(F.col("measure") == "radical").select(F.col("bucket").alias("radical_idx"), F.col("n").alias("char_count"))
        rows = radicals.join(n, "radical_idx", "left")
        return rows.select("radical_idx", F.col("char").alias("character"), "name_ko", "strokes", F.coalesce("char_count", F.lit(0)).alias("char_count")).orderBy("radical_idx")

    def compact(self) -> HomeCounts:
        """The same counts in a new folder, with one row for each measure and bucket."""
        fresh = HomeCounts(self.spark)
        self.merged().write.parquet(fresh.path)
        return fresh
