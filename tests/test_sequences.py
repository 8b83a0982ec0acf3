"""Folds over a user's steps against plain loops, with cells of a few rows."""

from __future__ import annotations

import datetime
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import activity, sequences

START = datetime.datetime(2024, 1, 1)
SCHEMA = "user_id bigint, event_id bigint, ts timestamp_ntz, key string, took_us bigint"


def made(seed: int, n: int = 400) -> list[tuple]:
    """Events of a hot user, a few others and a null one, with equal and missing times, null keys and null ids."""
    rng = random.Random(seed)
    keys = ["a", "b", "c", "back", "back", "home", None]
    rows = []
    for i in range(n):
        user = rng.choice([1, 1, 1, 2, 3, None])
        ts = None if rng.random() < 0.03 else START + datetime.timedelta(seconds=rng.randrange(n if user == 1 else 4 * n))
        rows.append((user, None if i == 7 else i, ts, rng.choices(keys, [4, 4, 2, 2, 2, 1, 1])[0], rng.choice([0, 1, 2, 9, 40, None, -5]) and rng.choice([0, 1, 2, 9]) * 1_000_000))
    return rows


def by_user(rows):
    users = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r[2] is None, r[2] or START, r[1] is None, r[1] or 0)):
        users[r[0]].append(r)
    return users


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize(("seed", "cell_rows"), [(1, 7), (2, 1_000_000)])
def test_back_stack(spark, seed, cell_rows):
    rows, want = made(seed), []
    for user, steps in by_user(rows).items():
        current, trail = None, []
        for _, event, _, key, _ in steps:
            if key is None:
                continue
            if key == "home":
                current, trail = None, []
            elif key == "back":
                if trail:
                    current = trail.pop()
            elif key != current:
                trail += [current] if current is not None else []
                current = key
            want.append((user, event, current, len(trail), trail[-1] if trail else None))
    got = sequences.back_stack(spark.createDataFrame(rows, SCHEMA).repartition(3), cell_rows=cell_rows)
    assert order(map(tuple, got.collect())) == order(want)
    assert sequences.back_stack(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(("seed", "cell_rows"), [(3, 7), (4, 1_000_000)])
def test_coalesced(spark, seed, cell_rows):
    rows, want = made(seed), []
    for user, steps in by_user(r for r in rows if r[2] is not None).items():
        end, waits = None, None
        for _, event, ts, _, took in steps:
            us, took = round((ts - START).total_seconds() * 1e6), max(took or 0, 0)
            if waits and us >= end:
                want.append((user, waits[0], "trailing", end, end + waits[1]))
                end, waits = end + waits[1], None
            if end is None or us >= end:
                want.append((user, event, "run", us, us + took))
                end = us + took
            else:
                want += [(user, waits[0], "dropped", None, None)] if waits else []
                waits = event, took
        want += [(user, waits[0], "trailing", end, end + waits[1])] if waits else []
    base = (START - datetime.datetime(1970, 1, 1)) // datetime.timedelta(microseconds=1)
    want = [(*w[:3], *(x if x is None else x + base for x in w[3:])) for w in want]
    got = sequences.coalesced(spark.createDataFrame(rows, SCHEMA).repartition(3), cell_rows=cell_rows)
    assert order(map(tuple, got.collect())) == order(want)
    assert {w[2] for w in want} == {"run", "trailing", "dropped"}
    assert sequences.coalesced(spark.createDataFrame([], SCHEMA)).collect() == []


def test_small_cells_change_nothing(spark):
    events = spark.createDataFrame(made(5), SCHEMA).repartition(3)
    for f in (lambda n: activity.changes(events, n), lambda n: activity.unfrozen(events, F.col("key") == "a", F.col("key") == "b", n)):
        assert order(map(tuple, f(5).collect())) == order(map(tuple, f(1_000_000).collect())) != []


def test_a_hot_user_is_dealt_over_cells_and_tasks(spark):
    rows = [(1, i, START + datetime.timedelta(seconds=i), "home" if i % 50 == 0 else f"k{i}", 1) for i in range(5_000)]
    cells = sequences.in_cells(spark.createDataFrame(rows, SCHEMA), 500)
    sizes = [r["count"] for r in cells.groupBy("_cell").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 1_500
    spans = sequences.running_count(cells, F.col("key") == "home", "_span")
    assert spans.select("_span").distinct().count() == 100
    stacks = sequences.back_stack(spark.createDataFrame(rows, SCHEMA), cell_rows=500)
    assert stacks.agg(F.max("depth")).first()[0] == 48


def test_latest(spark):
    events = spark.createDataFrame(made(6), SCHEMA).repartition(3)
    want = {u: [(r[2], r[1]) for r in steps[-8:]] for u, steps in by_user(made(6)).items()}
    assert {r["user_id"]: [tuple(x) for x in r["items"]] for r in activity.latest(events, 8).collect()} == want


def test_put_recent(spark):
    stored = spark.createDataFrame([(1, '["a","b","c"]'), (2, "cut"), (3, '["x"]'), (None, '["n","a"]'), (4, None)], "user_id bigint, items string")
    rows = [(1, 1, START, "b", 0), (1, 2, START, "d", 0), (2, 3, START, "a", 0), (None, 4, START, "a", 0), (5, 5, START, "z", 0), (5, 6, START, None, 0), (6, 7, None, "q", 0)]
    put = activity.put_recent(stored, spark.createDataFrame(rows, SCHEMA), 3)
    assert {r["user_id"]: r["items"] for r in put.collect()} == {1: '["d","b","a"]', 2: '["a"]', 3: '["x"]', None: '["a","n"]', 4: "[]", 5: '["z"]'}
