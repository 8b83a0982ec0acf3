"""What a user did: recently viewed keys, settled events, changes of key, the freeze switch, the latest events.

Input: user_id, key, ts, event_id; equal times stand in the order of event_id. A user may have a third of all
events, so no window holds a user's events: they are aggregated by (user, key) or by (user, cell) first, and windows
run over those rows. Cells are as long as a gap, or hold about as many rows each (sequences.in_cells).

Nulls: a null user_id is a user like any other, and a null ts or event_id stands after all others of its user. An
event without ts is settled, as none follows it by a known time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .sequences import CELL_ROWS, in_cells, just_before, running_count

RECENT = 14


def _late() -> Column:
    """What orders events by (ts, event_id), nulls last, inside an aggregate."""
    return F.struct(F.col("ts").isNull(), "ts", F.col("event_id").isNull(), "event_id")


def recent(events: DataFrame, n: int = RECENT) -> DataFrame:
    """(user_id, key, ts, place): each user's n latest keys, each once, the latest first."""
    last = events.groupBy("user_id", "key").agg(F.max(F.struct("ts", "event_id")).alias("l")).select("user_id", "key", "l.ts", "l.event_id")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return last.withColumn("place", place).where(F.col("place") <= n).select("user_id", "key", "ts", "place")


def put_recent(stored: DataFrame, events: DataFrame, n: int = RECENT) -> DataFrame:
    """(user_id, items): the stored lists, JSON texts with the latest key first, after what users opened since.

    A key opened moves to the front, the others keep their order, and a list is cut to n. A missing or malformed list is
    empty, users without events keep theirs, and of a user's several lists the longest, then the largest text, counts. Events
    must be later than those that the lists hold; events without a key or a time are left out.
    """
    timed = events.where(F.col("key").isNotNull() & F.col("ts").isNotNull())
    fronts = recent(timed.withColumn("key", F.col("key").cast("string")), n)
    fronts = fronts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("place", "key"))).alias("front"))  # n at most
    fronts = fronts.select(F.col("user_id").alias("_user"), F.transform("front", lambda x: x["key"]).alias("front"))
    none = F.array().cast("array<string>")
    kept = stored.groupBy("user_id").agg(F.max_by("items", F.struct(F.length("items"), "items")).alias("items"))
    kept = kept.select("user_id", F.coalesce(F.from_json("items", "array<string>"), none).alias("old"))
    both = kept.join(fronts, F.col("user_id").eqNullSafe(F.col("_user")), "full")
    front, old = F.coalesce("front", none), F.coalesce("old", none)
    items = F.slice(F.array_distinct(F.concat(front, old)), 1, n)
    user = F.when(F.col("front").isNotNull(), F.col("_user")).otherwise(F.col("user_id"))
    return both.select(user.alias("user_id"), F.to_json(items).alias("items"))


def settled(events: DataFrame, gap_seconds: int) -> DataFrame:
    """The events after which a user did nothing for longer than a gap.

    In cells as long as the gap only the last event of a cell can be one, and only the next cell can hold an
    event that follows too soon.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    cells = events.where(F.col("ts").isNotNull()).withColumns({"_us": micros, "_cell": F.floor(micros / F.lit(gap_seconds * 1_000_000)).cast("bigint")})
    by = cells.groupBy("user_id", "_cell").agg(F.max_by(F.struct(*events.columns, "_us"), _late()).alias("last"), F.min("_us").alias("first"))
    following = by.select(F.col("user_id").alias("_user"), (F.col("_cell") - 1).alias("_of"), F.col("first").alias("next"))
    ended = F.col("next").isNull() | (F.col("next") - F.col("last._us") > gap_seconds * 1_000_000)
    same = F.col("user_id").eqNullSafe(F.col("_user")) & (F.col("_cell") == F.col("_of"))
    timed = by.drop("first").join(following, same, "left").where(ended).select(*[f"last.{c}" for c in events.columns])
    return timed.unionByName(events.where(F.col("ts").isNull()))


def changes(events: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """events with previous (the user's key just before, null at first): only those whose key is another one."""
    joined = just_before(in_cells(events, cell_rows), F.col("key"), "_previous")
    previous = F.col("_previous")["v"]  # a struct, so that a null key is a key too
    return joined.withColumn("previous", previous).where(~F.col("key").eqNullSafe(F.col("previous"))).drop("_cell", "_previous")


def unfrozen(events: DataFrame, is_click: Column, is_move: Column, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The moves that count: those after an even number of the user's clicks."""
    flagged = events.withColumns({"_click": is_click, "_move": is_move})
    counted = running_count(in_cells(flagged, cell_rows), F.col("_click"), "_clicks")
    return counted.where(F.col("_move") & (F.col("_clicks") % 2 == 0)).select(*events.columns)


def latest(events: DataFrame, n: int) -> DataFrame:
    """(user_id, items): each user's n latest events as (ts, event_id), in order; a task sends at most n for each user."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.col("ts").desc_nulls_first(), F.col("event_id").desc_nulls_first()))
    last = events.select("user_id", "ts", "event_id", place.alias("_place")).where(F.col("_place") <= n)
    items = F.array_sort(F.collect_list(F.struct(-F.col("_place"), "ts", "event_id")))
    return last.groupBy("user_id").agg(F.transform(items, lambda x: F.struct(x["ts"].alias("ts"), x["event_id"].alias("event_id"))).alias("items"))
