"""The nested entry of a character: one dimension, one family and five child tables around its summary row.

Children are aggregated by code point before they are joined, so rows never multiply, and every exchange is
by code point: the joins reuse the partitioning of the aggregations. Keys, if given, are semi-joined with
each table first, which makes a look-up of few characters read few rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import display
from ..functions.codepoints import characters, codepoint_char, component_names, format_codepoint
from ..schemas import MEANING_LANGUAGES, READING_TYPES
from .families import least, texts


@dataclass
class Dictionary:
    """The tables, in the schemas of schemas.TABLES."""

    character_summary: DataFrame
    radicals: DataFrame
    characters_ids: DataFrame
    characters_structure: DataFrame
    characters_core: DataFrame
    character_readings: DataFrame
    character_hunum: DataFrame
    character_meanings: DataFrame
    variant_edges: DataFrame
    variant_family: DataFrame
    character_grades: DataFrame
    fts_search: DataFrame

    def only(self, keys: DataFrame) -> Dictionary:
        """The tables that have rows by code point, less the rows of other keys; for entries()."""
        out = {f.name: getattr(self, f.name) for f in fields(self)}
        for name in ("character_summary", "character_readings", "character_hunum", "character_meanings", "variant_family", "character_grades"):
            out[name] = out[name].join(keys.select("codepoint"), "codepoint", "left_semi")
        own = keys.select(F.col("codepoint").alias("source_codepoint"))
        out["variant_edges"] = out["variant_edges"].join(own, "source_codepoint", "left_semi")
        return Dictionary(**out)


def pivot_lists(rows: DataFrame, kind: str, kinds: tuple[str, ...], name: str) -> DataFrame:
    """(codepoint, name: struct of one sorted list per kind); rows of other kinds are dropped."""
    lists = [F.sort_array(F.collect_list(F.when(F.col(kind) == k, F.col("value")))).alias(k) for k in kinds]
    grouped = rows.where(F.col(kind).isin(*kinds)).groupBy("codepoint").agg(*lists)
    return grouped.select("codepoint", F.struct(*kinds).alias(name))


def hunum_lists(rows: DataFrame) -> DataFrame:
    """(codepoint, hunum: list of pairs in the order of seq)."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "jahun", "dokeum")))
    pairs = F.transform(ordered, lambda x: F.struct(x["jahun"].alias("jahun"), x["dokeum"].alias("dokeum")))
    return rows.groupBy("codepoint").agg(pairs.alias("hunum"))


def variant_lists(edges: DataFrame) -> DataFrame:
    """(codepoint, variants: list ordered by category, relation, target)."""
    item = F.struct(F.col("relation_category").alias("category"), "relation", "target_codepoint", "target_character")
    ordered = F.array_sort(F.collect_list(item))
    return edges.groupBy(F.col("source_codepoint").alias("codepoint")).agg(ordered.alias("variants"))


def variant_categories(variants: Column, categories: tuple[str, ...] = ("variant", "semantic")) -> Column:
    """struct of one list for each category that is shown, in the order of variants; others are left out."""
    own = lambda k: F.filter(variants, lambda v: v["category"] == k)
    return F.struct(*[own(k).alias(k) for k in categories])


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once for a row and not for each item that a lambda in body looks at."""
    return F.get(F.transform(F.array(value), body), 0)


def ids_links(ids: Column, components: Column) -> Column:
    """The characters of a description in order, as struct(char, codepoint, link): a link is one of components."""
    linked = lambda c, known: F.coalesce(F.array_contains(known, c), F.lit(False))
    item = lambda c, known: F.struct(c.alias("char"), format_codepoint(F.ascii(c)).alias("codepoint"), linked(c, known).alias("link"))
    return _bound(F.transform(components, codepoint_char), lambda known: F.transform(characters(ids), lambda c: item(c, known)))


def linked_characters(ids: Column, components: Column) -> Column:
    """struct(links, n_plain): the characters of a description that ids_links marks, in order, and how many it doesn't.

    No component is ASCII, so that is counted and passed over as a whole; nothing is named.
    """
    none, plain = F.array().cast("array<string>"), F.length(F.coalesce(ids, F.lit("")))
    among = lambda known: F.filter(characters(F.regexp_replace(ids, r"[\x00-\x7F]+", "")), lambda c: F.array_contains(known, c))
    links = F.when(F.size(F.coalesce(components, none)) > 0, _bound(F.transform(components, codepoint_char), among)).otherwise(none)
    return _bound(links, lambda x: F.struct(x.alias("links"), (plain - F.size(x)).cast("bigint").alias("n_plain")))


def family_rows(family: DataFrame) -> DataFrame:
    """(codepoint, family: struct(size, representative), text_id): only those of more than one member by the size stored; text_id names the list."""
    family = family.where("component_size > 1")
    stored = F.collect_set(F.struct(F.col("component_size").alias("size"), "representative", F.coalesce(F.md5("family_members_json"), F.lit("")).alias("text_id")))
    first = family.groupBy("codepoint").agg(stored.alias("stored")).withColumn("first", F.array_min("stored"))
    same = lambda x: x["size"].eqNullSafe(F.col("first.size")) & x["representative"].eqNullSafe(F.col("first.representative"))
    ids = F.transform(F.filter("stored", same), lambda x: x["text_id"])
    return least(first.select("codepoint", F.struct("first.size", "first.representative").alias("family"), ids.alias("ids")), family)


def family_members(family: DataFrame) -> DataFrame:
    """(text_id, members) of each different list, parsed once; null for a malformed one."""
    members = F.from_json("text", "array<string>")
    named = F.transform(members, lambda c: F.struct(c.alias("codepoint"), codepoint_char(c).alias("character")))
    return texts(family.where("component_size > 1")).select("text_id", named.alias("members"))


def components(summary: DataFrame, universe: DataFrame) -> DataFrame:
    """(codepoint, components): those parts of the description that are characters themselves, in order."""
    parts = summary.select("codepoint", F.posexplode(component_names(F.col("primary_ids"))).alias("pos", "part"))
    known = parts.join(universe.select(F.col("codepoint").alias("part")), "part", "left_semi")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"])
    return known.groupBy("codepoint").agg(ordered.alias("components"))


def entries(d: Dictionary, keys: DataFrame | None = None) -> DataFrame:
    """One nested row per summary row (of keys, if given): the whole entry."""
    if keys is not None:
        d = d.only(keys)
    empty = lambda name, kind: F.coalesce(F.col(name), F.array().cast(kind)).alias(name)
    lists = lambda name, kinds: F.struct(*[F.coalesce(F.col(f"{name}.{k}"), F.array().cast("array<string>")).alias(k) for k in kinds]).alias(name)
    radical = d.radicals.select("radical_idx", F.col("char").alias("radical_char"), F.col("name_ko").alias("radical_name"), F.col("strokes").alias("radical_strokes"))
    grades = d.character_grades.select("codepoint", F.struct(*[c for c in d.character_grades.columns if c != "codepoint"]).alias("grades"))
    joined = d.character_summary.join(radical, "radical_idx", "left")
    for child in (
        components(d.character_summary, d.characters_ids),
        pivot_lists(d.character_readings, "reading_type", READING_TYPES, "readings"),
        hunum_lists(d.character_hunum),
        pivot_lists(d.character_meanings, "language", MEANING_LANGUAGES, "meanings"),
        variant_lists(d.variant_edges),
        family_rows(d.variant_family),
        grades,
    ):
        joined = joined.join(child, "codepoint", "left")
    structure = F.struct("radical_idx", "radical_char", "radical_name", "radical_strokes", "total_strokes", "residual_strokes", "primary_ids", "ids_top_idc")
    found = joined.select(
        "codepoint",
        shown_character().alias("character"),
        "block",
        structure.alias("structure"),
        empty("components", "array<string>"),
        lists("readings", READING_TYPES),
        empty("hunum", "array<struct<jahun:string,dokeum:string>>"),
        lists("meanings", MEANING_LANGUAGES),
        empty("variants", "array<struct<category:string,relation:string,target_codepoint:string,target_character:string>>"),
        "family",
        "grades",
        "text_id",
    )
    # last and in a projection of its own: members are the widest part of a row, and the join goes where nothing reads them
    whole = found.join(family_members(d.variant_family), "text_id", "left").withColumn("family", F.col("family").withField("members", F.col("members")))
    return whole.drop("text_id", "members")


def panels(found: DataFrame) -> DataFrame:
    """The lines that an entry's page shows, one row per entry: strokes, readings, pairs and meanings; null for a line without values."""
    return found.select(
        "codepoint", "character",
        display.strokes_line(F.col("structure.total_strokes"), F.col("structure.residual_strokes")).alias("strokes"),
        *[display.listed(F.col(f"readings.{k}")).alias(k) for k in READING_TYPES],
        display.hunum_line(F.col("hunum")).alias("hunum"),
        display.listed(F.col("meanings.ko")).alias("ko"),
        display.listed(F.col("meanings.en"), display.GLOSSES).alias("en"),
    )


def shown_character() -> Column:
    """character, or where that is empty the character that codepoint names."""
    return F.coalesce(F.nullif(F.col("character"), F.lit("")), codepoint_char(F.col("codepoint")))


def first_gloss(meanings: DataFrame, language: str = "ko") -> DataFrame:
    """(codepoint, gloss): the smallest meaning in a language."""
    return meanings.where(F.col("language") == language).groupBy("codepoint").agg(F.min("value").alias("gloss"))


def first_hunum(hunum: DataFrame) -> DataFrame:
    """(codepoint, hunum): the pair with the smallest seq."""
    return hunum.groupBy("codepoint").agg(F.min_by(F.struct("jahun", "dokeum"), F.struct("seq", "jahun", "dokeum")).alias("hunum"))
