"""Streams of events (user_id, key, ts): settled events, recently viewed keys, the back stack.

`ts` without a time zone is taken as UTC, as watermarks need instants.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import IntegerType, StructField, StructType

RECENT = 14
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def settled_stream(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, key, ts): the last event of each session that a gap ends."""
    sessions = timed(events, late).groupBy("user_id", F.session_window("ts", gap))
    return sessions.agg(F.max_by(F.struct("key", "ts"), F.struct("ts", "event_id")).alias("l")).select("user_id", "l.key", "l.ts")


def counts_stream(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, n): events in windows of a fixed length."""
    by = timed(events, late).groupBy(F.window("ts", window).alias("w"), "key").agg(F.count("*").alias("n"))
    return by.select(F.col("w.start").alias("start"), "key", "n")


class Recent(StatefulProcessor):
    """The n latest keys of a user: map state from key to its latest time and event."""

    def __init__(self, n: int) -> None:
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getMapState("latest", "key string", "us bigint, event_id bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = {k[0]: tuple(v) for k, v in self.latest.iterator()}
        kept = dict(known)
        for r in rows:
            if r["key"] is not None and r["us"] is not None:
                kept[r["key"]] = max(kept.get(r["key"], (r["us"], r["event_id"] or 0)), (r["us"], r["event_id"] or 0))
                if len(kept) > 4 * self.n:
                    kept = dict(self._first(kept))
        first = self._first(kept)
        kept = dict(first)
        for k in known.keys() - kept.keys():
            self.latest.removeKey((k,))
        for k, v in kept.items():
            if known.get(k) != v:
                self.latest.updateValue((k,), v)
        yield Row(user_id=key[0], keys=[k for k, _ in first])

    def _first(self, kept: dict) -> list[tuple]:
        return sorted(sorted(kept.items()), key=lambda x: x[1], reverse=True)[: self.n]

    def close(self) -> None:
        pass


class BackStack(StatefulProcessor):
    """A user's stack as map state from a running number to a key. What a batch pushes stays in the task, and only what is left
    of it at the end is written; the state is read where a step goes back behind the batch, one key for each such step.

    each: a row after each event; else one for each batch, with the whole trail.
    """

    def __init__(self, home: str, back: str, depth: int | None, each: bool) -> None:
        self.home, self.back, self.depth, self.each = home, back, depth, each

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "current string, bottom bigint, top bigint")
        self.trail = handle.getMapState("trail", "number bigint", "key string")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        current, bottom, top = self.place.get() if self.place.exists() else (None, 0, 0)
        read, new = {}, deque()  # what the state was asked for, and the upper end of the trail, not yet in the state

        def at(n: int) -> str:
            if n not in read:
                read[n] = self.trail.getValue((n,))[0]
            return read[n]

        late = lambda r: (r["us"] is None, r["us"] or 0, r["event_id"] is None, r["event_id"] or 0)
        for r in sorted((r for r in rows if r["key"] is not None), key=late):
            if r["key"] == self.home:
                if top - len(new) > bottom:
                    self.trail.clear()
                read.clear()
                new.clear()
                current, bottom, top = None, 0, 0
            elif r["key"] == self.back:
                if top > bottom:
                    if new:
                        current = new.pop()
                    else:
                        current = at(top)
                        self.trail.removeKey((top,))
                        del read[top]
                    top -= 1
            elif r["key"] != current:
                if current is not None:
                    top += 1
                    new.append(current)
                    if self.depth is not None and top - bottom > self.depth:
                        bottom += 1
                        if top - len(new) >= bottom:
                            self.trail.removeKey((bottom,))
                            read.pop(bottom, None)
                        else:
                            new.popleft()
                current = r["key"]
            if self.each:
                yield Row(user_id=key[0], event_id=r["event_id"], current=current, depth=top - bottom, previous=new[-1] if new else at(top) if top > bottom else None)
        if not self.each:
            yield Row(user_id=key[0], current=current, trail=[*map(at, range(bottom + 1, top - len(new) + 1)), *new])
        for n, k in enumerate(new, top - len(new) + 1):
            self.trail.updateValue((n,), (k,))
        self.place.update((current, bottom, top))

    def close(self) -> None:
        pass


def _slim(events: DataFrame) -> DataFrame:
    """What the processors read. Their state needs the RocksDB store, which keeps it outside the heap."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return events.select("user_id", "event_id", F.col("key").cast("string").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def recent_stream(events: DataFrame, n: int = RECENT) -> DataFrame:
    """(user_id, keys): each user's n latest keys, the latest first, as each batch leaves them; later rows replace earlier ones.

    Events without key or ts don't count. The state holds n keys of a user, and only those that change are written.
    """
    return _slim(events).groupBy("user_id").transformWithState(Recent(n), "user_id bigint, keys array<string>", "Update", "None")


def back_stack_stream(events: DataFrame, home: str = "home", back: str = "back", depth: int | None = None) -> DataFrame:
    """(user_id, current, trail): where each user is and the way back. Opening another key pushes the current one, back
    pops, home empties. The whole trail is kept, unless depth cuts it to its last keys. Events of one user in one batch are
    applied in the order of (ts, event_id); those of a later batch come after them."""
    return _slim(events).groupBy("user_id").transformWithState(BackStack(home, back, depth, False), "user_id bigint, current string, trail array<string>", "Update", "None")


def back_steps_stream(events: DataFrame, home: str = "home", back: str = "back") -> DataFrame:
    """(user_id, event_id, current, depth, previous) after each event with a key, as operators.sequences.back_stack gives them."""
    return _slim(events).groupBy("user_id").transformWithState(BackStack(home, back, None, True), "user_id bigint, event_id bigint, current string, depth int, previous string", "Append", "None")


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, run to its end below a folder that all share, and read back with the batch it came in."""
    path = f"{folder}/out"

    def put(rows: DataFrame, batch: int) -> None:
        # a batch that is run again after a failure replaces what it had written
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    query = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    written = StructType([*stream.schema.fields, StructField("batch", IntegerType())])
    return stream.sparkSession.read.schema(written).parquet(path)
