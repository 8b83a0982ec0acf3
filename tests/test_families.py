"""A family stored with each of its members: what is moved grows with the members, not with their square."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glyphlake.operators import families, graph
from glyphlake.operators.entry import family_members, family_rows
from glyphlake.plans.queries import ORACLE_SQL, QUERIES
from glyphlake.schemas import TABLES

from .conftest import DATA


def shuffled(df) -> int:
    """Bytes that df shuffles, before they are compressed."""
    df.collect()

    def walk(p) -> int:
        kind = p.getClass().getSimpleName()
        if kind in ("AdaptiveSparkPlanExec", "ReusedExchangeExec"):
            return walk(p.executedPlan()) if kind.startswith("Ada") else 0
        if kind.endswith("QueryStageExec"):
            return walk(p.plan())
        size = p.metrics().get("dataSize")
        own = size.get().value() if kind == "ShuffleExchangeExec" and size.isDefined() else 0
        return own + sum(walk(p.children().apply(i)) for i in range(p.children().size()))

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture(scope="module")
def one_family(spark, tmp_path_factory):
    """1,000 suppliers of one nation, some related: their rows store 10 MB of lists."""
    folder = str(tmp_path_factory.mktemp("family"))
    spark.range(1, 1001, 1, 2).selectExpr("id AS s_suppkey", "3 AS s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    spark.range(6).selectExpr("id AS o_orderkey", "id * 90 + 1 AS o_custkey", "'1-URGENT' AS o_orderpriority").write.parquet(f"{folder}/orders.parquet")
    spark.range(6).selectExpr("id AS l_orderkey", "id * 7 + 1 AS l_suppkey", "'A' AS l_returnflag", "'F' AS l_linestatus").write.parquet(f"{folder}/lineitem.parquet")
    return folder


@pytest.mark.parametrize(("name", "rows"), [("graph_edges", 6_000), ("graph_nodes", 1_000_000), ("family", 1_000)])
def test_lists_are_not_moved_with_each_row(spark, one_family, name, rows):
    df = QUERIES[name](spark, one_family)
    df = df.groupBy().agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h"))
    assert shuffled(df) < 3_000_000
    assert df.first()["n"] == rows


def test_blocks_of_a_list_give_the_same(spark, same, monkeypatch):
    for module in (families, graph):
        monkeypatch.setattr(module, "BLOCK", 2)
    for name in ("graph_edges", "graph_nodes"):
        same(QUERIES[name](spark, DATA), ORACLE_SQL[name])


def test_entries_without_members_read_no_list(spark):
    plan = QUERIES["entry_bundle"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan


def test_the_least_of_several_lists(spark):
    stored = [("a", 2, "a", '["b"]'), ("a", 2, "a", '["a"]'), ("a", 3, "a", '["0"]'), ("b", 2, "b", '["x"]'), ("b", 2, "b", None), ("c", 2, None, "no list"), ("c", 2, "c", '["x"]')]
    family = spark.createDataFrame(stored, TABLES["variant_family"])
    found = family_rows(family).join(family_members(family), "text_id", "left").selectExpr("codepoint", "family.*", "members.codepoint AS members").collect()
    assert sorted(map(tuple, (r[:] for r in found))) == [("a", 2, "a", ["a"]), ("b", 2, "b", None), ("c", 2, None, None)]
    lists = {r["codepoint"]: r["members"] for r in graph.family_lists(family, family).collect()}
    assert lists == {"a": ["0"], "b": ["x"], "c": ["x"]}
