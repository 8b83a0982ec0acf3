"""Families as stored: every member's row repeats the list of all members, so the rows hold the square of a family's size.

A list is named by the md5 of its text. Rows go through exchanges with that name alone; each different text is kept and parsed
once, and what is made of it is given to the rows last. So what is moved grows with the rows, whatever the families' sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Members of a list that one block has: rows that meet all of a long list meet it block by block, in different tasks.
BLOCK = 1_000


def texts(family: DataFrame) -> DataFrame:
    """(text_id, text): each different list once. The tasks that read combine their rows before any is moved."""
    text = F.col("family_members_json")
    return family.where(text.isNotNull()).groupBy(F.md5(text).alias("text_id")).agg(F.get(F.collect_set(text), 0).alias("text"))


def least(rows: DataFrame, family: DataFrame) -> DataFrame:
    """(codepoint, text_id, ...) of rows (codepoint, ids, ...): of several ids that of the least text, null first. Only rows with several look at texts."""
    others = [c for c in rows.columns if c != "ids"]
    one = rows.where(F.size("ids") < 2).select(*others, F.get("ids", 0).alias("text_id"))
    several = rows.where(F.size("ids") > 1).select(*others, F.explode("ids").alias("text_id")).join(texts(family), "text_id", "left")
    kept = [F.first(c).alias(c) for c in others if c != "codepoint"]
    return one.unionByName(several.groupBy("codepoint").agg(*kept, F.min_by("text_id", F.struct("text", "text_id")).alias("text_id")).select(*others, "text_id"))


def in_blocks(lists: DataFrame, items: str) -> DataFrame:
    """(list, block, items) of (list, items: an array), BLOCK of them at most."""
    blocks = lists.select("list", items, F.explode(F.sequence(F.lit(0), F.ceil(F.size(items) / BLOCK).cast("int") - 1)).alias("block"))
    return blocks.select("list", "block", F.slice(items, F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias(items))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df in as many parts as shuffles have, however small it is, as each of its rows will meet many others."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
