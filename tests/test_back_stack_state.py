"""The back stack's processor over map state kept in a dictionary: results over batches, and how often it asks the state."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Row

from glyphlake.streaming.activity import BackStack


class Kept(dict):
    calls = 0

    def getValue(self, k):  # noqa: N802
        self.calls += 1
        return self[k]

    def updateValue(self, k, v):  # noqa: N802
        self.calls += 1
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        self.calls += 1
        del self[k]


class Place:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, v):
        self.value = v


def run(batches, depth, each):
    p = BackStack("home", "back", depth, each)
    p.place, p.trail = Place(), Kept()
    return [r for b in batches for r in p.handleInputRows((1,), iter(b), None)], p.trail


def plain(keys, depth):
    current, trail = None, []
    for k in keys:
        if k == "home":
            current, trail = None, []
        elif k == "back":
            current = trail.pop() if trail else current
        elif k != current:
            trail = ([*trail, current] if current is not None else trail)[-depth if depth else 0 :]
            current = k
        yield current, list(trail)


@pytest.mark.parametrize("depth", [None, 1, 2, 3])
def test_batches_equal_plain_steps(depth):
    rng = random.Random(5)
    for _ in range(200):
        keys = rng.choices(["a", "b", "c", "back", "home"], [3, 3, 3, 4, 1], k=rng.randint(0, 40))
        rows = [Row(event_id=i, key=k, us=i) for i, k in enumerate(keys)]
        cuts = sorted(rng.choices(range(len(rows) + 1), k=4))
        batches = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        want = list(plain(keys, depth))
        steps, trail = run(batches, depth, True)
        assert [(r["current"], r["depth"], r["previous"]) for r in steps] == [(c, len(t), t[-1] if t else None) for c, t in want]
        assert len(trail) == (len(want[-1][1]) if want else 0)
        whole, _ = run(batches, depth, False)
        ends = [want[end - 1] if end else (None, []) for end in [*cuts, len(rows)]]
        assert [(r["current"], r["trail"]) for r in whole] == ends


def test_a_batch_writes_only_what_is_left():
    rows = [Row(event_id=i, key=("a", "b", "back", "c")[i % 4], us=i) for i in range(4_000)]
    _, trail = run([rows, [Row(event_id=9_999, key="home", us=9_999)]], None, True)
    assert trail.calls <= 2_001 and len(trail) == 0
    pairs = [Row(event_id=i, key=("a", "b", "back")[i % 3], us=i) for i in range(3_000)]
    assert run([pairs], None, True)[1].calls == 0
