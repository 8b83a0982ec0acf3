"""Operator 2, quality rules: a threshold table compiled into one projection of built-in functions.

Counts come first, each from the whole text (null: no words): words, code points in words, symbols,
repeated lines, words in repeated three-word windows, stop words. RULES then names ratios of those counts
and the range each must keep; compile_rules makes one boolean expression of them. Nothing shuffles and no
user function runs, so cost is linear in the text and a lost executor repeats only its own files. Counts and
verdict are one expression of bound values, so a filter on them doesn't multiply their parts.

Repeated windows: each window is hashed to 64 bits. Only if a text has equal hashes are (hash, place) pairs
sorted, so that equal ones are neighbours; the places found are sorted again and their union measured.
This is n log n for any text, also one that repeats a single line.

Defined results: null, empty and blank texts have counts of 0 and fail; other columns are ignored; equal
rows get equal results; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_CHARS, table, word_array

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": "a an and are as at be by for from has have he in is it its not of on or that the this to was were which with you",
    "de": "als auf das dem den der des die ein eine er es für ich im in ist mit nicht sich sie und von zu",
    "fr": "au avec ce dans de des du elle en est et il la le les ne pas par pour que qui sur un une",
    "es": "al como con de del el en es esta la las lo los no para pero por que se su un una y",
}
#: name, value, least, most; the value is an expression over the counts.
RULES: list[tuple[str, str, float | None, float | None]] = [
    ("mean_word_length", "word_chars / n_words", 2.0, 12.0),
    ("symbols_per_word", "n_symbols / n_words", None, 0.1),
    ("stop_words_per_word", "n_stop_words / n_words", 0.04, None),
    ("dup_lines_per_line", "n_dup_lines / n_lines", None, 0.5),
    ("words_per_line", "n_words / n_lines", 1.5, None),
]
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def _repeat_words(words: Column) -> Column:
    """Words in three-word windows that occur twice or more."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def same(by_hash: Column) -> Column:
        alike = lambda x, i: (x["h"] == F.get(by_hash, i + 1)["h"]) | (x["h"] == F.get(by_hash, i - 1)["h"])
        return F.sort_array(F.transform(F.filter(by_hash, lambda x, i: F.coalesce(alike(x, i), F.lit(False))), lambda x: x["p"]))

    def union(found: Column) -> Column:
        steps = F.transform(found, lambda p, i: F.least(F.lit(3), p - F.coalesce(F.get(found, i - 1), F.lit(-3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        by_hash = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(by_hash, lambda s: let(same(s), union))).otherwise(0)

    return F.when(n >= 3, let(hashes, counted)).otherwise(0)


def _counts(text: Column, words: Column, lines: Column, stop: list[str]) -> Column:
    counts = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_stop_words": F.size(F.filter(words, lambda w: w.isin(stop))),
        "n_repeat_words": _repeat_words(words),
    }
    return F.struct(*[c.cast("bigint").alias(k) for k, c in counts.items()])


def compile_rules(counts: Column, rules: list[tuple[str, str, float | None, float | None]] = RULES) -> Column:
    """One boolean over a struct of counts: every ratio within its range. A ratio over nothing fails."""
    kept = F.lit(True)
    for _, value, least, most in rules:
        ratio = F.try_divide(*(counts[c] for c in value.split(" / ")))
        if least is not None:
            kept &= F.coalesce(ratio >= F.lit(least), F.lit(False))
        if most is not None:
            kept &= F.coalesce(ratio <= F.lit(most), F.lit(False))
    return kept


def judgement(text: Column, rules: list[tuple[str, str, float | None, float | None]] = RULES, words: dict[str, str] = STOP_WORDS) -> Column:
    """struct of the counts, base_failed and kept: one expression, so that a filter moves it as a whole or not at all."""
    stop = sorted({w for line in words.values() for w in line.split()})
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_repeat_words")

    def judged(c: Column) -> Column:
        failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEATED_PERCENT * c["n_words"])
        return F.struct(*[c[n].alias(n) for n in names], failed.alias("base_failed"), (~failed & compile_rules(c, rules)).alias("kept"))

    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")
    whole = lambda t: let(word_array(t), lambda w: let(lines(t), lambda x: let(_counts(t, w, x, stop), judged)))
    return let(F.coalesce(text, F.lit("")), whole)


def judge(docs: DataFrame, text: str = "text", rules: list[tuple[str, str, float | None, float | None]] = RULES) -> DataFrame:
    """docs without the text, with the counts, base_failed and kept."""
    return docs.withColumn("_judged", judgement(F.col(text), rules)).drop(text).select("*", "_judged.*").drop("_judged")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the counts, base_failed and kept."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words"
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep."""
    return docs.where(judgement(F.col("text"))["kept"])


def _sql() -> str:
    stop = ", ".join(f"'{w}'" for w in sorted({w for line in STOP_WORDS.values() for w in line.split()}))
    tests = [f"coalesce({v.replace(' / ', ' / nullif(')}, 0) {sign} {bound}::DOUBLE, false)" for _, v, lo, hi in RULES for sign, bound in ((">=", lo), ("<=", hi)) if bound is not None]
    return rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT row_number() OVER () AS r, * FROM d
), p AS (
  SELECT r, i, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM g WHERE len(w) > 2)
), o AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM p
), c AS (
  SELECT r, count(DISTINCT i + k) AS n FROM o, (VALUES (0), (1), (2)) v(k) WHERE n > 1 GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    (len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, len(list_filter(w, lambda x: x IN ({stop})))::BIGINT AS n_stop_words
  FROM g LEFT JOIN c USING (r)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(tests)} AS kept, n_lines, n_stop_words
FROM b
"""


OP2_SQL = _sql()
