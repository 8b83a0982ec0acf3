"""What depends on a user's earlier steps: the back stack, and requests that come while one is running.

Input: user_id, ts, event_id and what a function asks for; equal times stand in the order of event_id.

Both are folds over a user's steps, and a user may have a third of all. So the steps are cut where the fold provably starts
anew: going home empties the stack, and after a pause of twice the longest run no request is running or waiting. To number
these spans, steps are dealt by ranges of (user, ts, event_id) into cells of about CELL_ROWS rows, a large user over many
cells, and written; within a cell a running count tells the span, and the counts before a cell come from one row for each
user and cell. Each span then goes to the task its hash names, in order, and a task walks through its spans row by row:
it never holds one, only the fold's state. A span itself is one task's walk.

Nulls: a null user_id is a user like any other; a null ts or event_id stands after all others of its user.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_folder

CELL_ROWS = 500_000


def in_order() -> list[Column]:
    return [F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last()]


def in_cells(events: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """events, written to the shared folder, with _cell: a user's events of a cell come before those of a later one."""
    spark, path = events.sparkSession, shared_folder(events.sparkSession)
    n = -(-max(1, events.count()) // cell_rows)
    dealt = events.repartitionByRange(n, F.col("user_id"), *in_order()) if n > 1 else events.coalesce(1)
    dealt = dealt.withColumn("_cell", F.spark_partition_id())
    dealt.write.parquet(path)  # the cells of a table that is read twice must be the same both times
    return spark.read.schema(dealt.schema).parquet(path)


def joined_cells(cells: DataFrame, sums: DataFrame) -> DataFrame:
    """cells with what sums has for the same (user_id, _cell), nulls being equal to each other."""
    right = sums.withColumnsRenamed({"user_id": "_user", "_cell": "_of"})
    return cells.join(right, F.col("user_id").eqNullSafe(F.col("_user")) & F.col("_cell").eqNullSafe(F.col("_of"))).drop("_user", "_of")


def running_count(cells: DataFrame, counts: Column, out: str) -> DataFrame:
    """cells with out: how many of the user's events up to and with this one count."""
    flagged = cells.withColumn("_counts", F.coalesce(counts.cast("int"), F.lit(0)))
    before = Window.partitionBy("user_id").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    sums = flagged.groupBy("user_id", "_cell").agg(F.sum("_counts").alias("_n"))
    sums = sums.select("user_id", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    near = F.sum("_counts").over(Window.partitionBy("user_id", "_cell").orderBy(*in_order()).rowsBetween(Window.unboundedPreceding, 0))
    return joined_cells(flagged.withColumn("_near", near), sums).withColumn(out, F.col("_before") + F.col("_near")).drop("_counts", "_near", "_before")


def just_before(cells: DataFrame, value: Column, out: str) -> DataFrame:
    """cells with out: a struct with the value v of the user's event just before, null at the first."""
    struct = F.struct(value.alias("v"))
    late = F.struct(F.col("ts").isNull(), "ts", F.col("event_id").isNull(), "event_id")
    lasts = cells.groupBy("user_id", "_cell").agg(F.max_by(struct, late).alias("_last"))
    lasts = lasts.select("user_id", "_cell", F.lag("_last").over(Window.partitionBy("user_id").orderBy("_cell")).alias("_earlier"))
    near = F.lag(struct).over(Window.partitionBy("user_id", "_cell").orderBy(*in_order()))
    return joined_cells(cells.withColumn("_near", near), lasts).withColumn(out, F.coalesce("_near", "_earlier")).drop("_near", "_earlier")


def walked(spans: DataFrame, walk: Callable[[Iterator[tuple]], Iterator[tuple]], columns: list[str], schema: str) -> DataFrame:
    """What walk makes of the rows (user_id, _span, columns) of whole spans, one span after the other, each in order."""
    dealt = spans.repartition("user_id", "_span").sortWithinPartitions("user_id", "_span", *in_order()).select("user_id", "_span", *columns)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for part in range(0, len(b), 4096) for row in zip(*(c.to_pylist() for c in b.slice(part, 4096).columns), strict=True))
        for held in itertools.batched(walk(rows), 4096):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), given, strict=True)], schema=given)

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    given = pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in schema.split(", ")])
    return dealt.mapInArrow(over, schema)


def back_stack(events: DataFrame, home: str = "home", back: str = "back", cell_rows: int = CELL_ROWS) -> DataFrame:
    """(user_id, event_id, current, depth, previous) after each event with a key: where the user is, how many keys are behind
    it, and the one that a step back leads to.

    Opening another key than the current one puts that on the stack, back takes the last off, home empties it; back with an
    empty stack changes nothing.
    """
    keyed = events.where(F.col("key").isNotNull()).select("user_id", "event_id", "ts", "key")
    spans = running_count(in_cells(keyed, cell_rows), F.col("key") == home, "_span")

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        place, current, trail = None, None, []
        for user, span, event, key in rows:
            if (user, span) != place:
                place, current, trail = (user, span), None, []
            if key == home:
                current, trail = None, []
            elif key == back:
                current = trail.pop() if trail else current
            elif key != current:
                if current is not None:
                    trail.append(current)
                current = key
            yield user, event, current, len(trail), trail[-1] if trail else None

    return walked(spans, walk, ["event_id", "key"], "user_id bigint, event_id bigint, current string, depth int, previous string")


def coalesced(requests: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(user_id, event_id, outcome, start_us, end_us) of requests with a ts and took_us, how long a run takes that serves it.

    One runs at a time for each user. A request that comes while one runs waits; the last of those that wait runs when
    that ends (outcome trailing), the others never do (dropped, without times). A missing or negative took_us is 0.
    """
    asked = requests.where(F.col("ts").isNotNull())
    asked = asked.select("user_id", "event_id", "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.greatest(F.coalesce("took_us", F.lit(0)), F.lit(0)).cast("bigint").alias("took_us"))
    cells = in_cells(asked, cell_rows)
    longest = cells.agg(F.max("took_us")).first()[0] or 0
    earlier = just_before(cells, F.col("us"), "_was")
    # a run begins at its request, or with the end of one that was running then: after 2 * longest nothing is under way
    idle = F.col("us") - F.col("_was.v") >= 2 * longest
    spans = running_count(earlier, F.coalesce(idle, F.lit(True)), "_span").drop("_was")

    def walk(rows: Iterator[tuple]) -> Iterator[tuple]:
        place, end, waits = None, 0, None
        for user, span, event, us, took in rows:
            if waits and (us >= end or (user, span) != place):
                yield place[0], waits[0], "trailing", end, end + waits[1]
                end, waits = end + waits[1], None
            if (user, span) != place or us >= end:
                place, end = (user, span), us + took
                yield user, event, "run", us, end
            else:
                if waits:
                    yield user, waits[0], "dropped", None, None
                waits = event, took
        if waits:
            yield place[0], waits[0], "trailing", end, end + waits[1]

    return walked(spans, walk, ["event_id", "us", "took_us"], "user_id bigint, event_id bigint, outcome string, start_us bigint, end_us bigint")
