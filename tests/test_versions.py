"""Versions of a table: merges in sequence, failures, and two merges onto one version."""

import pytest
from pyspark.sql import functions as F

from glyphlake.sources.versions import Conflict, Versions

SCHEMA = "k bigint, n bigint"


def added(old, new):
    return old.unionByName(new).groupBy("k").agg(F.sum("n").alias("n"))


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def store(spark, tmp_path):
    return Versions(spark, f"file://{tmp_path}/t", SCHEMA, "k", buckets=8)


def test_merges_in_sequence(spark, store):
    assert store.version() == 0 and rows(store.read()) == []
    assert store.merge(spark.createDataFrame([(1, 5), (2, 6), (None, 1)], SCHEMA), added) == 1
    assert store.merge(spark.createDataFrame([(2, 1), (9, 4), (None, 1)], SCHEMA), added) == 2
    assert rows(store.read()) == rows(spark.createDataFrame([(1, 5), (2, 7), (9, 4), (None, 2)], SCHEMA))
    assert rows(store.read(1)) == rows(spark.createDataFrame([(1, 5), (2, 6), (None, 1)], SCHEMA))
    assert store.merge(spark.createDataFrame([], SCHEMA), added) == 2


def test_only_the_buckets_of_new_keys_are_read_and_written(spark, store):
    store.merge(spark.range(100).selectExpr("id AS k", "id AS n"), added)
    seen = []
    store.merge(spark.createDataFrame([(5, 1)], SCHEMA), lambda old, new: (seen.append(old.count()), added(old, new))[1])
    assert 0 < seen[0] < 50
    before, after = store._folders(1), store._folders(2)
    assert len([b for b in after if before[b] != after[b]]) == 1
    assert rows(store.read()) == rows(spark.range(100).selectExpr("id AS k", "if(id = 5, 6, id) AS n"))


def test_a_failed_merge_leaves_the_old_version(spark, store):
    store.merge(spark.createDataFrame([(1, 5)], SCHEMA), added)
    broken = lambda old, new: added(old, new).withColumn("n", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        store.merge(spark.createDataFrame([(1, 1)], SCHEMA), broken)
    assert store.version() == 1 and rows(store.read()) == [(1, 5)]


def test_of_two_merges_onto_one_version_one_is_published(spark, store, tmp_path):
    store.merge(spark.createDataFrame([(1, 5)], SCHEMA), added)
    other = Versions(spark, store.path, SCHEMA, "k", buckets=8)

    def overtaken(old, new):
        other.merge(spark.createDataFrame([(1, 100)], SCHEMA), added)
        return added(old, new)

    with pytest.raises(Conflict):
        store.merge(spark.createDataFrame([(1, 1)], SCHEMA), overtaken)
    assert store.version() == 2 and rows(store.read()) == [(1, 105)]


def test_rows_that_a_merge_takes_away(spark, store):
    store.merge(spark.createDataFrame([(1, 5), (2, 6)], SCHEMA), added)
    store.merge(spark.createDataFrame([(1, 0)], SCHEMA), lambda old, new: old.join(new, "k", "left_anti"))
    assert rows(store.read()) == [(2, 6)]
