"""Phrase search over whole texts, with the first gloss of each hit."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .browse import bounded_limit
from .entry import first_gloss

SEPARATORS = r"[^\p{L}\p{N}]+"


def phrase_tokens(phrase: str) -> list[str]:
    """Lower-cased runs of letters and digits."""
    return [t for t in regex.split(SEPARATORS, unicodedata.normalize("NFC", phrase).lower()) if t]


def base_letters(char: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", char) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _accented() -> tuple[str, str]:
    """Lower-case letters that are one base letter with diacritics, and those bases, in the same order."""
    pairs = [(c, base_letters(c)) for c in map(chr, range(0xC0, 0x2000)) if c == c.lower() and c.isalpha()]
    pairs = [(c, b) for c, b in pairs if len(b) == 1 and b != c]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case without diacritics."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{Mn}+", ""), *_accented())


def token_text(text: Column, fold: bool = False) -> Column:
    """Tokens of a text with one space before, between and after them."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(F.lit(" "), F.array_join(F.split(folded(text) if fold else F.lower(text), SEPARATORS), " "), F.lit(" "))


def has_phrase(text: Column, phrase: str, fold: bool = False) -> Column:
    """Whether the tokens of phrase stand side by side in text; a phrase without tokens is in no text.

    With fold, letters count as equal whatever their diacritics.
    """
    tokens = phrase_tokens(base_letters(phrase) if fold else phrase)
    if not tokens:
        return F.lit(False)
    plain = F.coalesce(text, F.lit(""))
    plain = folded(plain) if fold else F.lower(plain)
    # a plain search for the first token comes before the costly split
    return plain.contains(tokens[0]) & F.contains(token_text(text, fold), F.lit(f" {' '.join(tokens)} "))


def phrase_search(texts: DataFrame, phrase: str, key: str = "codepoint", columns: tuple[str, ...] = ("hanja", "body"), fold: bool = False) -> DataFrame:
    """Rows of texts in which any of the columns has the phrase."""
    found = F.lit(False)
    for c in columns:
        found = found | has_phrase(F.col(c), phrase, fold)
    return texts.where(found & F.col(key).isNotNull())


def search(texts: DataFrame, meanings: DataFrame, phrase: str, limit: int = 50, fold: bool = False) -> DataFrame:
    """(codepoint, character, gloss): the first hits by code point; a blank phrase has none."""
    return with_gloss(phrase_search(texts, phrase, fold=fold), meanings, limit)


def with_gloss(hits: DataFrame, meanings: DataFrame, limit: int = 50) -> DataFrame:
    """(codepoint, character, gloss) of the first hits (codepoint, hanja) by code point."""
    hits = hits.select("codepoint", F.col("hanja").alias("character")).orderBy("codepoint", "character").limit(bounded_limit(limit, 200, 50))
    gloss = first_gloss(meanings.join(hits.select("codepoint"), "codepoint", "left_semi"))
    return hits.join(gloss, "codepoint", "left").select("codepoint", "character", F.coalesce("gloss", F.lit("")).alias("gloss")).orderBy("codepoint", "character")
