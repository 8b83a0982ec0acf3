"""The graph of a family: its members and the relations among them, each undirected pair once per relation.

Works for any number of families at once: members are exploded, joined with the edges by source, and joined
once more by (family, target). The first of equal pairs is chosen by an aggregation, which combines before
the shuffle. Members of a family that store the same list share one graph, made once; keys know their list by
name, and only the last join gives each the nodes and edges, block by block, so a large family has many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codepoints import codepoint_char
from .families import BLOCK, dealt, in_blocks, least, texts


def _named(members: str | Column) -> Column:
    return F.md5(F.to_json(members))


def _parsed(family: DataFrame) -> DataFrame:
    """(text_id, list, members) of each different text that is a list: repeated members once, list named by what is left."""
    members = F.filter(F.array_distinct(F.from_json("text", "array<string>")), lambda c: c.isNotNull())
    return texts(family).select("text_id", members.alias("members")).where("members IS NOT NULL").select("text_id", _named("members").alias("list"), "members")


def key_lists(keys: DataFrame, family: DataFrame) -> DataFrame:
    """(codepoint, list, n, alone) of keys (codepoint): the list's name and length; alone for a key without one, whose list is itself."""
    stored = least(family.groupBy("codepoint").agg(F.collect_set(F.md5("family_members_json")).alias("ids")), family)
    joined = keys.select("codepoint").distinct().join(stored, "codepoint", "left").join(_parsed(family).select("text_id", "list", F.size("members").alias("n")), "text_id", "left")
    alone = F.col("list").isNull()
    own = F.filter(F.array("codepoint"), lambda c: c.isNotNull())
    return joined.select("codepoint", F.coalesce("list", _named(own)).alias("list"), F.coalesce("n", F.size(own)).alias("n"), alone.alias("alone"))


def different_lists(lists: DataFrame, family: DataFrame) -> DataFrame:
    """(list, members) of each different list of key_lists()."""
    own = lists.where("alone").select("list", F.filter(F.array("codepoint"), lambda c: c.isNotNull()).alias("members"))
    used = _parsed(family).select("list", "members").join(lists.where("NOT alone").select("list").distinct(), "list", "left_semi")
    return used.unionByName(own).groupBy("list").agg(F.first("members").alias("members"))


def family_lists(keys: DataFrame, family: DataFrame) -> DataFrame:
    """(codepoint, list, members) of keys (codepoint): the family stored, repeated members once; alone without one.

    Keys with equal members have the same list, so what is made for a list is made once for all of them.
    """
    lists = key_lists(keys, family)
    return lists.select("codepoint", "list").join(different_lists(lists, family), "list").select("codepoint", "list", "members")


def _exploded(lists: DataFrame) -> DataFrame:
    return lists.select(F.col("list").alias("codepoint"), F.posexplode("members").alias("pos", "member"))


def once(lists: DataFrame) -> DataFrame:
    """(codepoint, pos, member) of each different list, under the name of the list."""
    return _exploded(lists.groupBy("list").agg(F.first("members").alias("members")))


def family_members(keys: DataFrame, family: DataFrame) -> DataFrame:
    """(codepoint, pos, member) of keys (codepoint)."""
    return graph_nodes(keys, family).select("codepoint", "pos", "member")


def _by_block(lists: DataFrame) -> DataFrame:
    """(codepoint, list, block) of key_lists(): a row for each block of a key's list."""
    some = lists.where("n > 0").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    return dealt(some.select("codepoint", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")), "list", "block")


def graph_nodes(keys: DataFrame, family: DataFrame) -> DataFrame:
    """(codepoint, pos, member, character, focus) of keys (codepoint); focus marks the key itself. Characters are named once for each list."""
    lists = key_lists(keys, family)
    node = lambda m, i: F.struct(i.alias("pos"), m.alias("member"), codepoint_char(m).alias("character"))
    nodes = different_lists(lists, family).where(F.size("members") > 0).select("list", F.transform("members", node).alias("nodes"))
    met = _by_block(lists).join(dealt(in_blocks(nodes, "nodes"), "list", "block"), ["list", "block"])
    return met.select("codepoint", F.explode("nodes").alias("n")).select("codepoint", "n.*", (F.col("n.member") == F.col("codepoint")).alias("focus"))


def graph_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(codepoint, source, target, relation, category): edges inside each family; self-loops stay."""
    starts = members.select("codepoint", "pos", F.col("member").alias("source"))
    # edges that leave every family go first, before sources multiply them by families
    edges = edges.join(members.select(F.col("member").alias("target_codepoint")).distinct(), "target_codepoint", "left_semi")
    out = starts.join(edges.select(F.col("source_codepoint").alias("source"), F.col("target_codepoint").alias("target"), "relation", F.col("relation_category").alias("category")), "source")
    inside = out.join(members.select("codepoint", F.col("member").alias("target")), ["codepoint", "target"], "left_semi")
    pair = ["codepoint", F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), "relation"]
    first = F.min_by(F.struct("source", "target", "category"), F.struct("pos", "target", "category"))
    return inside.groupBy(*pair).agg(first.alias("e")).select("codepoint", "e.source", "e.target", "relation", "e.category")


def edges_of(keys: DataFrame, family: DataFrame, edges: DataFrame) -> DataFrame:
    """(codepoint, source, target, relation, category) of keys: found once for each different family, then given to its keys."""
    lists = key_lists(keys, family)
    different = different_lists(lists, family)
    found = graph_edges(_exploded(different), edges).withColumnRenamed("codepoint", "list")
    # a list's edges are dealt over as many blocks as its members have
    blocks = different.select("list", F.ceil(F.size("members") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("source", "target", "relation"), F.col("blocks")).cast("int").alias("block")
    found = dealt(found.join(blocks, "list").select("list", block, "source", "target", "relation", "category"), "list", "block")
    return _by_block(lists).join(found, ["list", "block"]).drop("list", "block")


def variant_graph(keys: DataFrame, family: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per key: codepoint, nodes in the family's order, edges sorted. Edges are found once for each different family."""
    family = family.join(keys.select("codepoint"), "codepoint", "left_semi")
    lists = key_lists(keys, family)
    different = different_lists(lists, family)
    edge = F.struct("source", "target", "relation", "category")
    found = graph_edges(_exploded(different), edges).groupBy(F.col("codepoint").alias("list")).agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    node = lambda m: F.struct(m["codepoint"].alias("codepoint"), m["character"].alias("character"), (m["codepoint"] == F.col("codepoint")).alias("focus"))
    kind = "array<struct<source:string,target:string,relation:string,category:string>>"
    named = different.select("list", F.transform("members", lambda m: F.struct(m.alias("codepoint"), codepoint_char(m).alias("character"))).alias("members"))
    met = lists.select("codepoint", "list").join(named.join(found, "list", "left"), "list")
    return met.select("codepoint", F.transform("members", node).alias("nodes"), F.coalesce("edges", F.array().cast(kind)).alias("edges"))
