"""Operator 12, license scans by an exact set-similarity join of text blocks with license templates.

Words that templates use are ordered by how often the whole corpus has them, rarest first. A template of m different words
asks for `need` of them (LEAST of m, rounded up) in one block: an overlapping window of words of the text, twice as long
as the template's size class, so that every passage of up to that many words lies whole in some block. The join goes by
these filters, none of which loses a block:
  prefix    a block that has `need` words of a template has one of its m - need + 1 rarest, so only blocks around such
            words are cut, and they meet templates by equal rare words alone;
  length    a block with fewer than `need` words that any template uses is passed over;
  position  the first common word of a pair, by its place in both orders, bounds how many can still follow.
What is left is verified by its intersection. Fixed phrases are found beside it as words that stand consecutively.

Scale: two scans of the texts, one for the words' counts and one for phrases and blocks. Between scan and join only rows
of counts and cut blocks (numbers of words, no texts) are written, so what is shuffled is one short row a document and one
a match. The templates, a few dozen, and the counts of their words are all that passes through the driver; blocks are
linear in the text, also where every word is rare.

Defined results: a null text has no words; a text without a phrase has null first_word and last_word, and without a label
an empty string; equal rows each get their result, and null or repeated ids are rows like others; an empty table gives an
empty result. Only id and text are read, so other columns, whatever their names, change nothing.
score: 1 if a phrase occurs, else the largest share of a template's words that a block holds, if that is LEAST or more, else 0.
"""

from __future__ import annotations

import math
import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .quality import let

#: A word is a run of these, after A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose words stand consecutively, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: How public licenses announce themselves or grant their terms, with a label for each.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal"),
    ("gpl-2.0", "licensed under the gnu general public license version 2"),
    ("gpl-3.0", "licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
#: The share of a template's different words that a block must hold. Below ten words that is all of them.
LEAST = Fraction(9, 10)
#: Templates of up to so many words are of one class; its blocks hold twice as many, and each begins so many after the last.
CLASSES = (16, 32, 64)


def _needs(templates: list[tuple[str, str]]) -> list[tuple[str, int, int, list[str]]]:
    """(label, class, need, different words) of each template."""
    found = []
    for label, text in templates:
        words = re.findall(TERM, text)
        if not words or len(words) > CLASSES[-1]:
            raise ValueError(f"a template needs 1 to {CLASSES[-1]} words: {text!r}")
        own = sorted(set(words))
        found.append((label, next(c for c in CLASSES if c >= len(words)), math.ceil(LEAST * len(own)), own))
    return found


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


def _places(words: Column, phrases: dict[str, str]) -> Column:
    """array of (start, label) of the phrases: where the first word stands, the others are looked at."""
    split = [(p.split(), label) for p, label in phrases.items()]
    first = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(sorted({p[0] for p, _ in split})), i)))

    def at(i: Column) -> Column:
        whole = lambda p: F.forall(F.transform(F.array(*map(F.lit, p)), lambda w, k: F.coalesce(F.get(words, i + k) == w, F.lit(False))), lambda x: x)
        return F.array_compact(F.array(*[F.when(whole(p), F.struct(i.cast("bigint").alias("start"), F.lit(label).alias("label"))) for p, label in split]))

    return F.flatten(F.transform(first, at))


def _blocks(words: Column, classes: list[int], rare: dict[int, list[str]], rank: dict[str, int], least: dict[int, int]) -> Column:
    """array of (class, ranks in ascending order) of the blocks around a rare word of a template of that class."""
    numbers = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])

    def of_class(c: int) -> Column:
        hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(rare[c]), i)))
        starts = F.filter(F.array_distinct(F.flatten(F.transform(hits, lambda i: F.transform(F.array(F.lit(1), F.lit(0)), lambda back: F.floor(i / c).cast("int") - back)))), lambda k: k >= 0)
        cut = lambda k: F.filter(F.array_distinct(F.slice(words, k * c + 1, 2 * c)), lambda w: w.isin(sorted(rank)))
        blocks = F.transform(starts, lambda k: F.struct(F.lit(c).alias("class"), F.array_sort(F.transform(cut(k), lambda w: numbers[w])).alias("ranks")))
        return F.filter(blocks, lambda b: F.size(b["ranks"]) >= least[c])

    return F.array_distinct(F.concat(*map(of_class, classes)))


def word_ranks(docs: DataFrame, used: list[str], text: str = "text") -> dict[str, int]:
    """Each word's number in the order of its count in all texts, rarest first, ties by the word."""
    found = docs.select(F.explode(F.filter(_words(F.col(text)), lambda w: w.isin(used))).alias("word")).groupBy("word").count()
    counts = {r["word"]: r["count"] for r in found.collect()}  # at most the templates' words
    return {w: k for k, w in enumerate(sorted(used, key=lambda w: (counts.get(w, 0), w)))}


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """For every row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    needs = _needs(templates)
    rank = word_ranks(docs, sorted({w for *_, own in needs for w in own}), text)
    rows = [(t, label, c, need, ranks := sorted(map(rank.get, own)), ranks[: len(ranks) - need + 1]) for t, (label, c, need, own) in enumerate(needs)]
    words_at = {k: w for w, k in rank.items()}
    classes = sorted({c for _, _, c, *_ in rows})
    rare = {c: sorted({words_at[k] for *_, own_class, _, _, prefix in [(r[2], r[3], r[4], r[5]) for r in rows] for k in prefix if own_class == c}) for c in classes}
    least = {c: min(r[3] for r in rows if r[2] == c) for c in classes}

    def read(words: Column) -> Column:
        return F.struct(F.size(words).cast("bigint").alias("n_words"), _places(words, phrases).alias("places"), _blocks(words, classes, rare, rank, least).alias("blocks"))

    found = docs.select(F.col(doc_id).alias("doc_id"), let(_words(F.col(text)), read).alias("r"))
    # written once, so that the number is a row's own whenever it is read
    found = materialize(found.select(F.monotonically_increasing_id().alias("row"), "doc_id", "r.*"))
    sets = docs.sparkSession.createDataFrame(rows, "template int, label string, class int, need int, own array<int>, prefix array<int>")
    sets = sets.select("template", "label", "class", "need", "own", F.posexplode("prefix").alias("i", "rare"))
    blocks = found.where(F.size("blocks") > 0).select("row", F.explode("blocks").alias("b")).select("row", "b.class", "b.ranks")
    blocks = blocks.select("*", F.posexplode("ranks").alias("j", "rare"))
    pairs = blocks.join(sets, ["class", "rare"]).where("size(ranks) >= need AND 1 + least(size(own) - 1 - i, size(ranks) - 1 - j) >= need")
    pairs = pairs.withColumn("common", F.array_intersect("ranks", "own")).where((F.get("common", 0) == F.col("rare")) & (F.size("common") >= F.col("need")))
    matches = pairs.groupBy("row").agg(F.collect_set("label").alias("found"), F.max(F.size("common") / F.size("own")).alias("share"))
    base = F.array_distinct(F.transform("places", lambda p: p["label"]))
    joined = lambda labels: F.array_join(F.array_sort(labels), ",")
    none = F.array().cast("array<string>")
    return found.join(matches, "row", "left").select(
        "doc_id", "n_words", F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["start"])).alias("first_word"), F.array_max(F.transform("places", lambda p: p["start"])).alias("last_word"),
        joined(base).alias("base_labels"), joined(F.array_union(base, F.coalesce("found", none))).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    phrases = " UNION ALL ".join(
        f"SELECT r, i, '{label}' AS label FROM w WHERE " + " AND ".join(f"list_extract(ws, i + {k + 1}) = '{x}'" for k, x in enumerate(p.split())) for p, label in PHRASES.items()
    )
    sets = ", ".join(f"({t}, '{label}', {c}, {need}, {len(own)}, [{', '.join(repr(x) for x in own)}])" for t, (label, c, need, own) in enumerate(_needs(TEMPLATES)))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS ws FROM documents
), w AS (
  SELECT r, ws, unnest(range(len(ws))) AS i FROM d
), p AS (
  {phrases}
), b AS (
  SELECT r, count(*) AS n, min(i) AS lo, max(i) AS hi, list(DISTINCT label) AS labels FROM p GROUP BY r
), t AS (
  SELECT t, label, c, need, m, unnest(own) AS x FROM (VALUES {sets}) v(t, label, c, need, m, own)
), h AS (
  SELECT w.r, t.t, t.label, t.need, t.m, t.x, w.i // t.c - back.k AS block
  FROM w JOIN t ON list_extract(w.ws, w.i + 1) = t.x, (VALUES (0), (1)) back(k) WHERE w.i // t.c >= back.k
), o AS (
  SELECT r, label, count(DISTINCT x) AS n, any_value(m) AS m FROM h GROUP BY r, t, label, block HAVING count(DISTINCT x) >= any_value(need)
), s AS (
  SELECT r, list(DISTINCT label) AS labels, max(n / m) AS share FROM o GROUP BY r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(b.n, 0)::BIGINT AS n_base, b.lo::BIGINT AS first_word, b.hi::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, s.labels))), ','), '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(s.share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (r) LEFT JOIN s USING (r)
"""


OP12_SQL = _sql()
