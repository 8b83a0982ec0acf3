"""Images as arrays of pixels: padding to a white square, and resizing with a triangle filter, in built-in expressions.

Arithmetic is that of 32-bit numbers in a fixed order: rows are combined first, then columns, taps from low to high, and only
the end is rounded, halves up; so every engine that keeps to it gets the same pixels. Division runs in 64 bits and is rounded to
32, which is the same as dividing in 32. The filter is as wide as two source pixels, or two result pixels on reduction.

Defined results: a null image or side is null; sides must be positive and pixels 0 to 255.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _f(x: Column | float) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("float")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is made once."""
    return F.transform(F.array(value), body).getItem(0)


def _total(items: Column) -> Column:
    return F.aggregate(items, _f(0.0), lambda a, x: a + x)


def taps(n: Column, side: int) -> Column:
    """For each of side results: the first of n sources that it takes from, and the weights of that and the next ones."""
    ratio = _f(_f(n) / _f(side))
    reach = F.greatest(ratio, _f(1.0))

    def one(o: Column) -> Column:
        at = (_f(o) + _f(0.5)) * ratio
        first, last = F.greatest(F.floor(at - reach).cast("int"), F.lit(0)), F.least(F.ceil(at + reach).cast("int"), n) - 1
        raw = F.transform(F.sequence(first, last), lambda i: F.greatest(_f(0.0), _f(1.0) - F.abs(_f((_f(i) - (at - _f(0.5))) / reach))))
        weights = _let(raw, lambda r: _let(_total(r), lambda total: F.transform(r, lambda w: _f(w / total))))
        return F.struct(first.alias("first"), weights.alias("weights"))

    return F.transform(F.sequence(F.lit(0), F.lit(side - 1)), one)


def resized(pixels: Column, height: Column, width: Column, side: int) -> Column:
    """(side * side) whole numbers of the height * width pixels of one channel, row by row."""
    height, width = height.cast("int"), width.cast("int")
    combined = lambda t, pixel: F.aggregate(F.sequence(F.lit(0), F.size(t["weights"]) - 1), _f(0.0), lambda s, j: s + _f(pixel(t["first"] + j)) * t["weights"][j])
    rows = F.transform(taps(height, side), lambda t: F.transform(F.sequence(F.lit(0), width - 1), lambda x: combined(t, lambda y: pixels[y * width + x])))
    whole = lambda v: F.floor(F.least(F.greatest(v, _f(0.0)), _f(255.0)).cast("double") + 0.5).cast("int")
    return _let(taps(width, side), lambda columns: F.flatten(F.transform(rows, lambda row: F.transform(columns, lambda t: whole(combined(t, lambda x: row[x]))))))


def squared(pixels: Column, height: Column, width: Column) -> Column:
    """The pixels centred on a white square as wide as the longer side; odd margins have the larger half after."""
    n = F.greatest(height, width).cast("int")
    top, left = F.floor((n - height) / 2).cast("int"), F.floor((n - width) / 2).cast("int")

    def pixel(k: Column) -> Column:
        y, x = F.floor(k / n).cast("int") - top, k % n - left
        inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
        return F.when(inside, F.get(pixels, y * width + x)).otherwise(F.lit(255))

    return F.transform(F.sequence(F.lit(0), n * n - 1), pixel)


def normalised(pixels: Column) -> Column:
    """Pixels as 32-bit numbers in -1..1."""
    return F.transform(pixels, lambda p: _f((_f(_f(p) / _f(255.0)) - _f(0.5)) / _f(0.5)))
