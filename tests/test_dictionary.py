"""A small dictionary in the tables' own schemas, with the rows that are easy to get wrong."""

import dataclasses
import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from glyphlake import api
from glyphlake.operators import activity, browse, entry, graph, neighbours, ranges, search
from glyphlake.functions import display
from glyphlake.operators.entry import Dictionary, entries
from glyphlake.operators.home_counts import HomeCounts
from glyphlake.plans.queries import ORACLE_SQL, QUERIES
from glyphlake.schemas import TABLES

ROWS = {
    "character_summary": [
        ("U+9451", "鑑", "CJK Unified Ideographs", 167, 22, 14, "⿰金監金", "⿰"),
        ("U+20000", "", "Ext B", None, None, None, None, None),
        ("U+91D1", "金", "CJK Unified Ideographs", 167, 8, 0, "⿱𠆢龸", "⿱"),
        ("U+76E3", "監", "CJK Unified Ideographs", 108, 14, 9, None, None),
    ],
    "radicals": [(108, "皿", "그릇명부", 5), (167, "金", "쇠금부", 8), (214, "龠", "피리약부", 17)],
    "characters_ids": [("U+9451",), ("U+91D1",), ("U+20000",)],
    "characters_structure": [("U+9451", 167, 22), ("U+91D1", 167, 8), ("U+20000", 167, None), ("U+76E3", 108, 14)],
    "characters_core": [("U+9451", "鑑", "CJK Unified Ideographs"), ("U+91D1", "金", "CJK Unified Ideographs"), ("U+20000", None, "Ext B"), ("U+76E3", "監", "CJK Unified Ideographs")],
    "character_readings": [("U+9451", "mandarin", "jiàn"), ("U+9451", "onyomi", "カン"), ("U+9451", "onyomi", "ガン"), ("U+9451", "klingon", "x")],
    "character_hunum": [("U+9451", 2, None, "감"), ("U+9451", 1, "거울", "감")],
    "character_meanings": [("U+9451", "ko", "거울"), ("U+9451", "en", "mirror"), ("U+9451", "fr", "miroir"), ("U+91D1", "ko", "쇠")],
    "variant_edges": [
        ("U+9451", "U+9452", "鑒", "simplified", "variant"), ("U+9452", "U+9451", "鑑", "simplified", "semantic"), ("U+9451", "U+9452", "鑒", "semantic", "semantic"),
        ("U+9451", "U+9451", "鑑", "spoofing", "variant"), ("U+9451", "U+0041", "A", "simplified", "variant"),
    ],
    "variant_family": [("U+9451", 2, "U+9451", '["U+9451","U+9452","U+9451"]'), ("U+9452", 2, "U+9451", '["U+9451","U+9452"]'), ("U+91D1", 1, "U+91D1", '["U+91D1"]'), ("U+76E3", 3, "U+76E3", "not json")],
    "character_grades": [("U+9451", "3급", "", 1, 0, None, 1, None)],
    "fts_search": [("U+9451", "鑑", "Mirror, to reflect: a mirror-image"), ("U+91D1", "金", "gold; metal"), ("U+76E3", "監", None)],
}


@pytest.fixture(scope="module")
def d(spark):
    return Dictionary(**{k: spark.createDataFrame(v, TABLES[k]) for k, v in ROWS.items()})


def test_lookup(spark, d):
    e = api.lookup(spark, d, "鑑賞").first().asDict(recursive=True)
    assert e["codepoint"] == "U+9451" and e["structure"]["radical_name"] == "쇠금부"
    assert e["components"] == ["U+91D1"]  # once, and only what the universe holds
    assert e["readings"] == {"mandarin": ["jiàn"], "cantonese": [], "onyomi": ["カン", "ガン"], "kunyomi": [], "vietnamese": []}
    assert e["hunum"] == [{"jahun": "거울", "dokeum": "감"}, {"jahun": None, "dokeum": "감"}]
    assert e["meanings"] == {"ko": ["거울"], "en": ["mirror"]}
    assert [(v["category"], v["relation"], v["target_codepoint"]) for v in e["variants"]] == [("semantic", "semantic", "U+9452"), ("variant", "simplified", "U+0041"), ("variant", "simplified", "U+9452"), ("variant", "spoofing", "U+9451")]
    assert e["family"]["size"] == 2 and e["family"]["members"][1] == {"codepoint": "U+9452", "character": "鑒"}
    assert e["grades"]["kr_education"] == "" and e["grades"]["jp_grade"] == 0


def test_the_search_bar_routes(spark, d):
    for typed in ("u9451", "U+9451", " u+9451 ", "鑑"):
        assert api.submit(spark, d, typed).first()["codepoint"] == "U+9451"
        assert api.lookup(spark, d, typed).first()["codepoint"] == "U+9451"
    assert [tuple(r) for r in api.submit(spark, d, "mirror image").collect()] == [("U+9451", "鑑", "거울")]
    with pytest.raises(KeyError):
        api.submit(spark, d, "u0042")


def test_diacritics_fold_only_if_asked(spark, d):
    texts = spark.createDataFrame([("U+9451", "鑑", "Le Miroir brisé, à part"), ("U+91D1", "金", "a\u0300 part")], TABLES["fts_search"])
    found = lambda phrase, fold: sorted(r["codepoint"] for r in search.phrase_search(texts, phrase, fold=fold).collect())
    assert found("brise", False) == [] and found("brise", True) == found("BRISÉ", True) == ["U+9451"]
    assert found("à part", True) == found("a part", True) == ["U+91D1", "U+9451"] and found("à part", False) == ["U+9451"]


def test_variants_by_category_and_links(spark, d):
    shown = entries(d).where("codepoint = 'U+9451'").select(entry.variant_categories(F.col("variants")).alias("v"), entry.ids_links(F.col("structure.primary_ids"), F.col("components")).alias("c")).first()
    assert [len(shown["v"][k]) for k in ("variant", "semantic")] == [3, 1]
    assert [(x["char"], x["link"]) for x in shown["c"]] == [("⿰", False), ("金", True), ("監", False), ("金", True)]
    none = entries(d).where("codepoint = 'U+20000'").select(entry.ids_links(F.col("structure.primary_ids"), F.col("components")).alias("c")).first()
    assert none["c"] == []


def test_sparse_entries(spark, d):
    rows = {r["codepoint"]: r for r in entries(d).collect()}
    assert len(rows) == 4
    empty = rows["U+20000"]
    assert empty["character"] == "𠀀" and empty["structure"]["radical_char"] is None and empty["family"] is None and empty["grades"] is None
    assert empty["components"] == [] and empty["variants"] == [] and empty["readings"]["onyomi"] == []
    assert rows["U+91D1"]["family"] is None and rows["U+76E3"]["family"]["members"] is None


def test_errors(spark, d):
    with pytest.raises(ValueError):
        api.lookup(spark, d, "  ")
    with pytest.raises(KeyError):
        api.lookup(spark, d, "U+0042")


def test_search(spark, d):
    assert [tuple(r) for r in api.search(d, "MIRROR", 80).collect()] == [("U+9451", "鑑", "거울")]
    assert [r["codepoint"] for r in api.search(d, "mirror image").collect()] == ["U+9451"]
    for nothing in ("", "  ", '"', "image mirror", "mirr"):
        assert api.search(d, nothing).collect() == []
    assert browse.bounded_limit(201, 200, 50) == 50 and browse.bounded_limit(200, 200, 50) == 200 and browse.bounded_limit(2001, 2000, 500) == 500


def test_graph(spark, d):
    g = api.variant_graph(spark, d, "鑑").first().asDict(recursive=True)
    assert g["nodes"] == [{"codepoint": "U+9451", "character": "鑑", "focus": True}, {"codepoint": "U+9452", "character": "鑒", "focus": False}]
    assert {(e["source"], e["target"], e["relation"], e["category"]) for e in g["edges"]} == {
        ("U+9451", "U+9452", "simplified", "variant"), ("U+9451", "U+9452", "semantic", "semantic"), ("U+9451", "U+9451", "spoofing", "variant")}
    alone = api.variant_graph(spark, d, "z").first()
    assert [n["codepoint"] for n in alone["nodes"]] == ["U+007A"] and alone["edges"] == []
    members = graph.family_members(d.variant_family, d.variant_family)
    once = graph.graph_edges(members, d.variant_edges)
    again = graph.graph_edges(members, once.selectExpr("source source_codepoint", "target target_codepoint", "relation", "category relation_category").distinct())
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, again.collect()))


def test_home(spark, d):
    home = api.home_data(d, datetime.date(1970, 1, 2)).first()
    assert tuple(home["stats"]) == (3, 1, 2, 3, 2)
    assert [(r["radical_idx"], r["char_count"]) for r in home["radicals"]] == [(108, 1), (167, 3), (214, 0)]
    assert home["daily"]["codepoint"] == "U+9451"  # second of two
    assert browse.day_number(datetime.date(1960, 1, 1)) == 0
    assert browse.daily_character(d, datetime.date(2024, 1, 1), "none").collect() == []


def test_radical_chars(spark, d):
    rows = api.radical_chars(d, 167, 400).collect()
    assert [(r["codepoint"], r["character"], r["gloss"]) for r in rows] == [("U+20000", "𠀀", ""), ("U+91D1", "金", "쇠"), ("U+9451", "鑑", "거울")]


def test_recognition(spark):
    anchors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.6, 0.8]), (2, [0.6, 0.8]), (3, None)], "idx int, embedding array<float>")
    names = spark.createDataFrame([("U+9451", 1)], TABLES["class_index"])
    rows = api.recognize_vector(anchors, names, [3.0, 4.0], 9).collect()
    assert [(r["codepoint"], r["character"], round(r["score"], 5)) for r in rows] == [("U+9451", "鑑", 1.0), ("", "", 1.0), ("", "", 0.6)]
    none = anchors.where("idx > 9")
    assert neighbours.nearest_of_each(none, none.withColumnRenamed("idx", "query_id"), 3).collect() == []
    out = neighbours.accuracy(spark.createDataFrame([], "query_id int, rank int, label int"), spark.createDataFrame([], "query_id int, label int")).first()
    assert out["n"] == 0 and out["top1_percent"] is None and out["passed"]


def test_ranges(spark):
    areas = spark.createDataFrame([(1, 0, 0, 100, 100), (0, 50, 0, 100, 100), (2, 5, 5, 0, 9)], "ordinal long, x int, y int, width int, height int")
    points = spark.createDataFrame([(0.0, 0.0), (99.0, 99.0), (100.0, 1.0), (150.0, 1.0), (-1.0, 5.0)], "x double, y double")
    assert [r["ordinal"] for r in sorted(ranges.first_holding(points, areas, -1).collect())] == [-1, 1, 0, 0, -1]


def test_ranges_of_every_size_by_brute_force(spark):
    """Wide, tall, tiny, huge, equal, flat, infinite and null areas; points on edges, repeated, without x."""
    inf, sizes = float("inf"), [0.25, 1.0, 3.0, 4.0, 1e-300, 1e6, 1e300, 5e-324]
    rng = random.Random(5)
    areas = [(n, rng.choice([-2.0, 0.0, 0.5, 3.0, 1e3]), rng.choice([-1.0, 0.0, 2.5]), rng.choice(sizes), rng.choice(sizes)) for n in range(60)]
    areas += [(60, 0.0, 0.0, 0.0, 5.0), (61, 0.0, 0.0, inf, 5.0), (62, None, 0.0, 1.0, 1.0), (3, *areas[9][1:]), (63, 1e15, 0.0, 1e-3, 1.0), (64, 1e300, 0.0, 1e-3, 1.0), (65, float("nan"), 0.0, 1.0, 1.0)]
    spots = [-2.0, -0.0, 0.0, 0.25, 0.5, 0.75, 1.0, 3.5, 4.0, 7.0, 999.9, 1e3, 1e6 + 3, 1e15, 1e300, float("nan"), None]
    points = [(n, x, y) for n, (x, y) in enumerate([(x, y) for x in spots for y in spots] * 2)]

    def holder(x, y):
        fit = [n for n, ax, ay, w, h in areas if None not in (x, y, ax) and w > 0 and h > 0 and math.isfinite(ax + w) and math.isfinite(ay + h) and ax <= x < ax + w and ay <= y < ay + h]
        return min(fit, default=None)

    made = spark.createDataFrame(areas, "ordinal bigint, x double, y double, width double, height double")
    asked = spark.createDataFrame(points, "id int, x double, y double")
    got = {r["id"]: r["ordinal"] for r in ranges.first_holding(asked, made).collect()}
    assert got == {n: holder(x, y) for n, x, y in points}
    assert sum(v is not None for v in got.values()) > 100
    assert ranges.covers(made).groupBy("ordinal", "ax", "ay", "width", "height").count().agg(F.max("count")).first()[0] <= 4
    assert {r["ordinal"] for r in ranges.first_holding(asked, made.limit(0), -1).collect()} == {-1}


@pytest.mark.parametrize("name", ["debounce_last", "key_changes", "unfrozen_moves"])
def test_activity_with_nulls(spark, same, tmp_path, name):
    at = lambda day, minute: datetime.datetime(2024, 1, day, 1, minute)
    kinds = ["view", "click", "view", None, "view", "view", "click"]
    rows = [(n, user, kinds[(n + i) % 7], ts) for i, user in enumerate((None, 1)) for n, ts in enumerate([at(1, 0), at(1, 5), at(2, 0), at(2, 1), at(4, 0), None, None, None], 10 * i)]
    rows.append((None, 1, "view", at(4, 0)))
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    same(QUERIES[name](spark, str(tmp_path)), ORACLE_SQL[name], str(tmp_path))


def test_activity_on_nothing(spark):
    none = spark.createDataFrame([], "user_id long, key string, ts timestamp, event_id long")
    assert not activity.recent(none).collect() and not activity.settled(none, 60).collect() and not activity.changes(none).collect()


def test_linked_characters_are_those_that_are_marked(spark):
    rows = [("⿰金監a金b", ["U+91D1"]), ("plain", ["U+91D1"]), (None, ["U+91D1"]), ("金監", None), ("金監", []), ("𠀀x𠀀監", ["U+20000", "U+76E3"]), ("", None)]
    df = spark.createDataFrame(rows, "ids string, components array<string>")
    both = df.select(entry.ids_links(F.col("ids"), F.col("components")).alias("a"), entry.linked_characters(F.col("ids"), F.col("components")).alias("b"))
    for r in both.collect():
        assert r["b"]["links"] == [x["char"] for x in r["a"] if x["link"]]
        assert r["b"]["n_plain"] == sum(not x["link"] for x in r["a"])


def test_a_graph_is_made_once_for_members_that_share_it(spark, d):
    keys = spark.createDataFrame([("U+9451",), ("U+9452",), ("U+91D1",), ("U+76E3",), ("U+0",), ("U+9451",)], "codepoint string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(graph.graph_edges(graph.family_members(keys, d.variant_family), d.variant_edges))
    assert rows(graph.edges_of(keys, d.variant_family, d.variant_edges).select("codepoint", "source", "target", "relation", "category")) == want != []
    assert graph.once(graph.family_lists(keys, d.variant_family)).select("codepoint").distinct().count() == 4


def test_nearest_without_the_vector_asked(spark, tmp_path):
    spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["knn_topk"](spark, str(tmp_path)).collect() == []


def test_panels(spark, d):
    lines = {r["codepoint"]: r for r in entry.panels(entries(d)).collect()}
    own = lines["U+9451"]
    assert (own["strokes"], own["mandarin"], own["onyomi"], own["hunum"], own["ko"], own["en"]) == ("총 22획 · 잔여 14획", "jiàn", "カン / ガン", "거울 감 · 감", "거울", "mirror")
    none = lines["U+20000"]
    assert none["character"] == "𠀀" and all(none[c] is None for c in none.asDict() if c not in ("codepoint", "character"))


def test_home_counts_add_up(spark, d, tmp_path):
    kept = HomeCounts(spark, f"file://{tmp_path}/counts")
    kept.add(d)
    assert kept.stats().collect() == browse.db_stats(d).collect()
    kept.add(d)  # rows count twice, different code points once
    once, twice = browse.db_stats(d).first(), kept.stats().first()
    for c in once.asDict():
        assert twice[c] == once[c] * (2 if c in ("characters", "family_rows") else 1)
    assert kept.compact().stats().collect() == [twice]
    assert kept.radical_index(d.radicals).agg(F.sum("char_count")).first()[0] == 2 * d.characters_structure.join(d.radicals, "radical_idx").count()
    plan = kept.stats()._jdf.queryExecution().toString()
    assert "codepoint" not in plan and "bitmap_or_agg" in plan  # no row of the dictionary is read
    odd = spark.createDataFrame([("U+4E00", "a"), ("u+4e00", "b"), (None, "c"), ("x", "d"), ("U+4E00", "e")], "codepoint string, value string").withColumn("language", F.lit("ko"))
    empty = HomeCounts(spark, f"file://{tmp_path}/odd")
    empty.add(dataclasses.replace(Dictionary(**{k: spark.createDataFrame([], TABLES[k]) for k in ROWS}), character_meanings=odd))
    assert empty.stats().first().asDict() == {"characters": 0, "with_reading": 0, "with_meaning": 1, "family_rows": 0, "families": 0}


def test_clamped(spark):
    values = spark.createDataFrame([(x,) for x in (-3.0, 0.5, 2.0, 9.0)] + [(None,)], "x double")
    assert [r[0] for r in values.select(display.clamped(F.col("x"), 0.25, 4.0)).collect()] == [0.25, 0.5, 2.0, 4.0, 0.25]
