"""Counts, radical index, radical browsing and the character of the day."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .entry import Dictionary, first_gloss, first_hunum, shown_character

BLOCK = "CJK Unified Ideographs"


def bounded_limit(limit: int, most: int, default: int) -> int:
    """A limit outside 1..most is reset to the default, not clamped."""
    return limit if 1 <= limit <= most else default


def db_stats(d: Dictionary) -> DataFrame:
    """One row of four counts; family_rows counts rows, as that table has one per character."""
    one = d.characters_ids.agg(F.count("*").alias("characters"))
    for df, value in (
        (d.character_readings, F.count_distinct("codepoint").alias("with_reading")),
        (d.character_meanings, F.count_distinct("codepoint").alias("with_meaning")),
        (d.variant_family.where("component_size > 1"), F.count("*").alias("family_rows")),
        (d.variant_family.where("component_size > 1"), F.count_distinct("representative").alias("families")),
    ):
        one = one.join(df.agg(value))  # one row each
    return one


def radical_index(radicals: DataFrame, structure: DataFrame) -> DataFrame:
    """Every radical with the number of its characters, 0 if none, in the order of radical_idx."""
    n = structure.groupBy("radical_idx").agg(F.count("*").alias("char_count"))
    return radicals.join(n, "radical_idx", "left").select("radical_idx", F.col("char").alias("character"), "name_ko", "strokes", F.coalesce("char_count", F.lit(0)).alias("char_count")).orderBy("radical_idx")


def radical_chars(d: Dictionary, radical_idx: int, limit: int = 500) -> DataFrame:
    """Characters of a radical by strokes (null first) and code point, with their first gloss.

    The limit is applied before the gloss is joined, so only the rows shown are decorated.
    """
    own = d.characters_structure.where(F.col("radical_idx") == radical_idx).join(d.characters_core.select("codepoint", "character"), "codepoint")
    order = [F.col("total_strokes").asc_nulls_first(), F.col("codepoint")]
    top = own.orderBy(*order).limit(bounded_limit(limit, 2000, 500))
    gloss = first_gloss(d.character_meanings.join(top.select("codepoint"), "codepoint", "left_semi"))
    shown = top.join(gloss, "codepoint", "left").orderBy(*order)
    return shown.select("codepoint", shown_character().alias("character"), F.coalesce("gloss", F.lit("")).alias("gloss"), "total_strokes")


def daily_pool(d: Dictionary, block: str = BLOCK, language: str = "ko") -> DataFrame:
    """Distinct code points of a block that have a meaning in a language."""
    meant = d.character_meanings.where(F.col("language") == language).select("codepoint")
    return d.characters_core.where(F.col("block") == block).select("codepoint").join(meant, "codepoint", "left_semi").distinct()


def day_number(day: datetime.date) -> int:
    """Days since the epoch; 0 before it."""
    return max(0, (day - datetime.date(1970, 1, 1)).days)


def daily_character(d: Dictionary, day: datetime.date, block: str = BLOCK) -> DataFrame:
    """The card of a day: the pool's row at day number modulo pool size; no row for an empty pool.

    The row is found by ranges, not by a sort in one task: the pool is counted by the first characters of the
    code point, and only the prefix that holds the row is sorted.
    """
    pool = daily_pool(d, block)
    prefix = F.substring("codepoint", 1, 5)
    sizes = sorted((r["p"], r["count"]) for r in pool.groupBy(prefix.alias("p")).count().collect())  # some thousands at most
    total = sum(n for _, n in sizes)
    at = day_number(day) % total if total else 0
    chosen = ""
    for chosen, n in sizes:
        if at < n:
            break
        at -= n
    picked = pool.where(prefix == chosen).orderBy("codepoint").offset(at).limit(1)
    summary = d.character_summary.join(picked, "codepoint", "left_semi")
    card = picked.join(summary, "codepoint", "left")
    gloss = first_gloss(d.character_meanings.join(picked, "codepoint", "left_semi"))
    hunum = first_hunum(d.character_hunum.join(picked, "codepoint", "left_semi"))
    card = card.join(gloss, "codepoint", "left").join(hunum, "codepoint", "left")
    return card.select("codepoint", shown_character().alias("character"), F.coalesce("gloss", F.lit("")).alias("gloss"), "hunum", "primary_ids", "total_strokes")


def home_data(d: Dictionary, day: datetime.date, block: str = BLOCK) -> DataFrame:
    """One row: stats, radicals (a list), daily (null for an empty pool)."""
    stats = db_stats(d).select(F.struct("*").alias("stats"))
    index = radical_index(d.radicals, d.characters_structure)
    index = index.agg(F.array_sort(F.collect_list(F.struct("radical_idx", "character", "name_ko", "strokes", "char_count"))).alias("radicals"))
    daily = daily_character(d, day, block).agg(F.first(F.struct("codepoint", "character", "gloss", "hunum", "primary_ids", "total_strokes")).alias("daily"))
    return stats.join(index).join(daily)  # one row each
