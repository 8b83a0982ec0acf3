"""Pruned search against all pairs, on clusters, copies, ties and odd vectors."""

import numpy as np
import pytest

from glyphlake.operators import neighbours, pruned

ROWS = "idx bigint, embedding array<double>"


def found(df):
    return sorted(map(tuple, df.select("query_id", "rank", "idx", "score").collect()))


def table(spark, vectors, first=0):
    return spark.createDataFrame([(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)], ROWS)


def asked(df):
    return df.withColumnRenamed("idx", "query_id")


@pytest.fixture(scope="module")
def clusters():
    """Vectors of several lengths around a few directions, a third of them one vector."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(12, 16))
    near = centres[rng.integers(0, 12, 400)] + rng.normal(scale=0.05, size=(400, 16))
    return [*(near * rng.uniform(0.5, 2, size=(400, 1))), *np.repeat(centres[:1], 200, axis=0)]


def test_equals_all_pairs_and_leaves_most_alone(spark, clusters):
    rows = table(spark, clusters)
    queries = asked(rows.where("idx % 9 = 0"))
    out = pruned.nearest_pruned(rows, queries, 5, pivots=32, anchor_block=64, query_block=16)
    assert found(out.hits) == found(neighbours.nearest_of_each(rows, queries, 5))
    scored, pairs = out.scored.first()
    assert pairs == 600 * 67 and 0 < scored < 0.6 * pairs


@pytest.mark.parametrize(("pivots", "shells"), [(1, 1), (3, 2), (40, 64)])
def test_any_cells_give_the_same(spark, pivots, shells):
    rng = np.random.default_rng(5)
    rows = table(spark, [*rng.normal(size=(120, 3)), *rng.integers(-1, 2, size=(80, 3)), [0, 0, 0], [1e-9, 0, 0]])
    out = pruned.nearest_pruned(rows, asked(rows), 4, pivots=pivots, shells=shells)
    assert found(out.hits) == found(neighbours.nearest_of_each(rows, asked(rows), 4))


def test_odd_vectors(spark):
    rows = table(spark, [[1, 0], [0, 1], [-1, 0], [1, 0], [5], [1, 2, 3], None, [float("nan"), 1], [float("inf"), 0], []])
    rows = rows.union(spark.createDataFrame([(None, [1.0, 1.0]), (20, [1.0, None]), (3, [0.5, 0.5])], ROWS))
    whole = rows.where("idx < 6")
    out = pruned.nearest_pruned(rows, asked(rows), 9, pivots=1)
    assert found(out.hits) == found(neighbours.nearest_of_each(whole, asked(whole), 9))
    few = table(spark, [[0.0, 1.0]], 100)  # fewer than k, and a query that is no anchor
    assert [r[2] for r in found(pruned.nearest_pruned(whole, asked(few), 9).hits)] == [1, 3, 0, 2, 3]  # two rows of idx 3


def test_empty_tables(spark):
    none, one = table(spark, []), table(spark, [[1.0, 0.0]])
    for anchors, queries in ((none, one), (one, none), (none, none)):
        out = pruned.nearest_pruned(anchors, asked(queries), 3)
        assert found(out.hits) == [] and out.scored.first()["scored"] == 0
