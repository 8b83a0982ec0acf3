"""Functions of the display: escapes, labels, grades, numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels of variant relations.
RELATION_LABELS = {
    "traditional": "번체",
    "simplified": "간체",
    "z_variants": "이체(Z)",
    "spoofing": "혼동자",
    "semantic": "통용자",
    "specialized_semantic": "부분통용",
    "kanjidic2_resolved": "일본이체",
    "ehanja_dongja": "동자",
    "ehanja_bonja": "본자",
    "ehanja_sokja": "속자",
    "ehanja_yakja": "약자",
    "ehanja_goja": "고자",
    "ehanja_waja": "와자",
    "ehanja_tongja": "통자",
    "ehanja_simple": "간체",
    "ehanja_hDup": "중복자",
    "ehanja_kanji": "일본자",
    "ehanja_synonyms": "유의자",
    "ehanja_opposites": "반의자",
    "ehanja_alt_forms": "이표기",
}
#: Pattern of a relation and its colour, the first that matches; colour of the others.
RELATION_COLOURS = [
    ("^(simplified|traditional)$", "#b65e16"),
    ("^(semantic|specialized_semantic|z_variants|spoofing|kanjidic2_resolved)$", "#255f9c"),
]
OTHER_COLOUR = "#2a7d2e"
#: Wording of school grades.
PRIMARY_SUFFIX, NAMES, SECONDARY = "학년 (교육한자)", "인명용한자", "상용한자 (중등)"


def escape_html(s: Column) -> Column:
    """Null gives an empty text; the ampersand goes first."""
    steps = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return reduce(lambda out, x: F.replace(out, F.lit(x[0]), F.lit(x[1])), steps, F.coalesce(s, F.lit("")))


def label(key: Column, labels: dict[str, str] = RELATION_LABELS, prefix: str = "ehanja_") -> Column:
    """The label of a key; without one the key itself, less the prefix."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.regexp_replace(key, f"^{prefix}", ""))


def group_of(key: Column, groups: list[tuple[str, str]] = RELATION_COLOURS, other: str = OTHER_COLOUR) -> Column:
    """The colour, or what else groups name, of the first pattern that a key matches."""
    return reduce(lambda rest, g: F.when(key.rlike(g[0]), F.lit(g[1])).otherwise(rest), reversed(groups), F.lit(other))


def school_grade(n: Column) -> Column:
    """Wording of a school grade: to 6 primary school, from 9 on names, between them secondary school."""
    primary = F.concat(n.cast("string"), F.lit(PRIMARY_SUFFIX))
    return F.when(n <= 6, primary).when(n >= 9, F.lit(NAMES)).when(n.isNotNull(), F.lit(SECONDARY))


def radical_name(name: Column) -> Column:
    """The name of a radical without the word for radical at its end; null gives an empty text."""
    return F.regexp_replace(F.coalesce(name, F.lit("")), "部$", "")


def shown(s: Column) -> Column:
    """A text that is worth showing: null if empty."""
    return F.nullif(s, F.lit(""))


def percent(score: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(score * 100 + F.lit(0.5)).cast("bigint")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def clamped(n: Column, least: float, most: float) -> Column:
    return F.least(F.greatest(n, F.lit(least)), F.lit(most))


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def edge_id(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def last_items(items: Column, n: int = 8) -> Column:
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - n + 1), F.lit(n))


#: What stands between the values of a line, and the wording of stroke counts.
VALUES, GLOSSES, PAIRS = " / ", "; ", " · "
TOTAL, RESIDUAL, STROKES = "총 ", "잔여 ", "획"


def listed(items: Column, between: str = VALUES) -> Column:
    """A line of the values of a list; null where there are none."""
    return shown(F.array_join(items, between))


def strokes_line(total: Column, residual: Column) -> Column:
    """The stroke counts that are known, as one line; null if none is."""
    counted = lambda name, n: F.concat(F.lit(name), n.cast("string"), F.lit(STROKES))
    return shown(F.concat_ws(PAIRS, counted(TOTAL, total), counted(RESIDUAL, residual)))


def hunum_line(pairs: Column) -> Column:
    """Pairs of meaning and sound as one line, the sound alone where there is no meaning; null without pairs."""
    pair = lambda h: F.concat_ws(" ", shown(h["jahun"]), h["dokeum"])
    return listed(F.transform(pairs, pair), PAIRS)
