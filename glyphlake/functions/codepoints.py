"""Code points, their `U+XXXX` names, and what a user types for one.

All functions take and give columns of built-in expressions, safe for characters beyond the first plane.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest code point, and the surrogates, which are no characters.
LAST, SURROGATES = 0x10FFFF, (0xD800, 0xDFFF)
#: Ideographic description characters: a block and one more.
IDC_BLOCK, IDC_MORE = (0x2FF0, 0x2FFF), 0x31EF


def format_codepoint(n: Column) -> Column:
    """19968 -> U+4E00: upper-case hex of four digits at least."""
    digits = F.hex(n.cast("bigint"))
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def codepoint_number(name: Column) -> Column:
    """U+4E00 -> 19968; null for what has no exact prefix, bad hex, a surrogate or too large a number."""
    digits = F.regexp_extract(name, r"^U\+0*([0-9A-Fa-f]{1,6})$", 1)
    n = F.when(digits != "", F.conv(digits, 16, 10).cast("bigint"))
    return F.when((n <= LAST) & ~n.between(*SURROGATES), n)


def codepoint_char(name: Column) -> Column:
    """The character of U+XXXX; empty for what names none."""
    n = codepoint_number(name)
    # the guard stands inside, as branches of a conditional may be evaluated together
    safe = F.lpad(F.hex(F.coalesce(n, F.lit(0))), 8, "0")
    return F.when(n.isNotNull(), F.decode(F.unhex(safe), "UTF-32")).otherwise(F.lit(""))


def trim_white(s: Column) -> Column:
    """Without white space, as Unicode defines it, at both ends."""
    return F.regexp_replace(F.regexp_replace(s, r"^\p{IsWhite_Space}+", ""), r"\p{IsWhite_Space}+$", "")


def normalize_query(s: Column) -> Column:
    """The code point that a query names: U+hex, four or more bare hex digits, or else its first character.

    Null for a blank query, bad hex after the prefix, and numbers beyond 32 bits.
    """
    t = trim_white(s)
    up = F.upper(t)
    prefixed = up.startswith("U+")
    digits = F.when(prefixed, F.substring(up, 3, 1 << 30)).otherwise(up)
    is_number = prefixed | up.rlike("^[0-9A-F]{4,}$")
    short = F.regexp_extract(digits, "^0*([0-9A-F]{1,8})$", 1)
    named = F.when(short != "", format_codepoint(F.conv(short, 16, 10).cast("bigint")))
    return F.when(t == "", None).when(is_number, named).otherwise(format_codepoint(F.ascii(t)))


def is_codepoint_query(s: Column) -> Column:
    """Whether a query goes to the look-up (u+hex in either case, or one ideograph), not to the search."""
    t = trim_white(s)
    return t.rlike(r"^[uU]\+?[0-9a-fA-F]{4,}$") | t.rlike(r"^\p{IsHan}$")


def routed_query(s: Column) -> Column:
    """A look-up query in the form that normalize_query reads: u9451 becomes U+9451."""
    t = trim_white(s)
    return F.when(t.rlike(r"^[uU]\+?[0-9a-fA-F]{4,}$"), F.regexp_replace(t, r"^[uU]\+?", "U+")).otherwise(t)


def is_idc(c: Column) -> Column:
    n = F.ascii(c)
    return n.between(*IDC_BLOCK) | (n == IDC_MORE)


def characters(s: Column) -> Column:
    """Array of the characters of a string; null gives none."""
    return F.when(F.coalesce(s, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(s, ""))


def component_names(ids: Column) -> Column:
    """Code points of the components in an ideographic description, first occurrences in order."""
    # ASCII is no component; one expression takes it out before the characters are looked at one by one
    parts = F.array_distinct(characters(F.regexp_replace(ids, r"[\x00-\x7F]+", "")))
    return F.transform(F.filter(parts, lambda c: ~is_idc(c)), lambda c: format_codepoint(F.ascii(c)))
