"""The driver's tables in the roles of the dictionary's tables.

Each binding is one SELECT in the SQL that Spark and the checking engine share; {agg} is the one word in which
they differ. The operators' results are checked by SQL of their own in plans.queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.entry import Dictionary

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
FIRST = 19968  # U+4E00


def _cp(key: str) -> str:
    return f"'U+' || hex({FIRST} + {key})"


BINDINGS: dict[str, str] = {
    "character_summary": f"""SELECT {_cp("c_custkey")} AS codepoint, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS character,
      c_mktsegment AS block, CAST(c_nationkey AS BIGINT) AS radical_idx, CAST(floor(c_acctbal) AS BIGINT) AS total_strokes,
      CASE WHEN c_acctbal < 0 THEN CAST(NULL AS BIGINT) ELSE c_custkey END AS residual_strokes, c_name AS primary_ids, c_mktsegment AS ids_top_idc FROM {{customer}}""",
    "radicals": "SELECT CAST(n_nationkey AS BIGINT) AS radical_idx, substr(n_name, 1, 1) AS char, n_name AS name_ko, CAST(n_regionkey AS BIGINT) AS strokes FROM {nation}",
    "characters_ids": f"SELECT {_cp('c_custkey')} AS codepoint FROM {{customer}} WHERE c_acctbal >= 0",
    "characters_structure": f"SELECT {_cp('c_custkey')} AS codepoint, CAST(c_nationkey AS BIGINT) AS radical_idx, CASE WHEN c_acctbal < 0 THEN CAST(NULL AS BIGINT) ELSE CAST(floor(c_acctbal) AS BIGINT) END AS total_strokes FROM {{customer}}",
    "characters_core": f"SELECT {_cp('c_custkey')} AS codepoint, c_name AS character, c_mktsegment AS block FROM {{customer}}",
    "character_readings": f"""SELECT {_cp("o_custkey")} AS codepoint, CASE o_orderpriority WHEN '1-URGENT' THEN 'mandarin' WHEN '2-HIGH' THEN 'cantonese'
      WHEN '3-MEDIUM' THEN 'onyomi' WHEN '4-NOT SPECIFIED' THEN 'vietnamese' ELSE 'unknown' END AS reading_type, CAST(o_orderkey AS STRING) AS value FROM {{orders}}""",
    "character_hunum": f"SELECT {_cp('o_custkey')} AS codepoint, o_orderkey AS seq, o_orderpriority AS jahun, o_orderstatus AS dokeum FROM {{orders}} WHERE o_orderstatus <> 'P'",
    "character_meanings": f"""SELECT {_cp("o_custkey")} AS codepoint, CASE o_orderstatus WHEN 'O' THEN 'ko' WHEN 'F' THEN 'en' ELSE 'xx' END AS language,
      o_orderpriority || '/' || CAST(o_orderkey AS STRING) AS value FROM {{orders}}""",
    "variant_edges": f"""SELECT {_cp("l_suppkey")} AS source_codepoint, {_cp("o_custkey")} AS target_codepoint, o_orderpriority AS target_character,
      l_returnflag AS relation, l_linestatus AS relation_category FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey""",
    "variant_family": f"""SELECT {_cp("s_suppkey")} AS codepoint, f.component_size, f.representative, f.family_members_json FROM {{supplier}} s JOIN (
      SELECT s_nationkey, count(*) AS component_size, min({_cp("s_suppkey")}) AS representative, '["' || {{agg}} || '"]' AS family_members_json
      FROM {{supplier}} GROUP BY s_nationkey) f ON s.s_nationkey = f.s_nationkey""",
    "character_grades": f"""SELECT {_cp("p_partkey")} AS codepoint, CASE WHEN p_size < 10 THEN '' ELSE p_brand END AS kr_grade, p_type AS kr_education,
      CAST(p_size AS BIGINT) AS cn_tonggyong, CAST(p_size % 12 AS BIGINT) AS jp_grade, p_partkey AS jp_freq, CAST(NULL AS BIGINT) AS jp_jlpt, p_name AS unihan_core FROM {{part}} WHERE p_size <= 40""",
    "fts_search": f"SELECT {_cp('doc_id')} AS codepoint, lang AS hanja, text AS body FROM {{documents}}",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound(spark: SparkSession, sf_dir: str, name: str, opened: dict[str, DataFrame] | None = None) -> DataFrame:
    """A dictionary table made of the driver's tables; opened keeps those that are open already, as opening one looks up its schema."""
    opened = {} if opened is None else opened
    used = {}
    for t in SOURCES:
        if f"{{{t}}}" in BINDINGS[name]:
            if t not in opened:
                opened[t] = fixture(spark, sf_dir, t)
            used[t] = opened[t]
    return spark.sql(BINDINGS[name].replace("{agg}", f"array_join(array_sort(collect_list({_cp('s_suppkey')})), '\",\"')"), **used)


def dictionary(spark: SparkSession, sf_dir: str) -> Dictionary:
    opened: dict[str, DataFrame] = {}
    return Dictionary(**{name: bound(spark, sf_dir, name, opened) for name in Dictionary.__dataclass_fields__})


def with_bindings(sql: str) -> str:
    """sql for the checking engine, with the bindings that it names as common tables before it."""
    used = [n for n in BINDINGS if n in sql]
    agg = f"string_agg({_cp('s_suppkey')}, '\",\"' ORDER BY {_cp('s_suppkey')})"
    tables = [f"{n} AS ({BINDINGS[n].format(**{t: t for t in SOURCES}, agg=agg)})" for n in used]
    body = sql.strip()
    if not tables:
        return body
    return "WITH " + ", ".join(tables) + (", " + body[5:] if body.startswith("WITH ") else " " + body)
