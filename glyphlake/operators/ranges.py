"""Points in half-open rectangles: the first that holds a point, by ordinal; and the square captured around it.

Each rectangle is laid on a grid of its own size: cells as wide and as high as the next power of two of its sides, so it
reaches into four of them at most, whether it is wide, tall or tiny. A point looks up its cell in each grid that
occurs (some dozens: pairs of exponents), so the join is one of equal keys, and a cell's candidates hold a fair share of
its points. Points in one spot are looked up once, and equal rectangles are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_SIDE = 16
#: Exponents of the sides of a grid's cells stay within those of doubles.
LEAST_EXPONENT, MOST_EXPONENT = -1000, 1000


def _exponent(side: str) -> Column:
    return F.least(F.greatest(F.ceil(F.log2(side)), F.lit(LEAST_EXPONENT)), F.lit(MOST_EXPONENT)).cast("int")


def _cell(at: Column, exponent: str) -> Column:
    return F.floor(at / F.pow(F.lit(2.0), F.col(exponent))).cast("bigint")


def _cells(start: str, side: str, exponent: str) -> Column:
    end = F.ceil((F.col(start) + F.col(side)) / F.pow(F.lit(2.0), F.col(exponent))).cast("bigint") - 1
    first = _cell(F.col(start), exponent)
    return F.sequence(first, F.greatest(first, end))


def covers(areas: DataFrame) -> DataFrame:
    """(ex, ey, cx, cy, ax, ay, width, height, ordinal): a row for each cell, of its own grid, that an area reaches into."""
    sides = [F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]
    # What is too small to move its end away from its start holds no number, and its cells are not counted by a bigint.
    holds = [(F.col(a) + F.col(b) > F.col(a)) & (F.col(a) + F.col(b) < F.lit(float("inf"))) for a, b in (("x", "width"), ("y", "height"))]
    own = areas.select("ordinal", *sides).where(holds[0] & holds[1])
    own = own.groupBy("x", "y", "width", "height").agg(F.min("ordinal").alias("ordinal"))
    own = own.withColumns({"ex": _exponent("width"), "ey": _exponent("height")}).withColumn("cx", F.explode(_cells("x", "width", "ex")))
    return own.withColumn("cy", F.explode(_cells("y", "height", "ey"))).withColumnsRenamed({"x": "ax", "y": "ay"})


def first_holding(points: DataFrame, areas: DataFrame, fallback: int | None = None) -> DataFrame:
    """points (x, y, ...) with ordinal of the first area (ordinal, x, y, width, height) that holds them, or fallback.

    A point without x or y gets fallback. An area with a null, without extent or without finite ends holds nothing.
    """
    cover = covers(areas)
    grids = cover.groupBy().agg(F.collect_set(F.struct("ex", "ey")).alias("_grids"))
    spots = points.select(F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL").distinct()
    seen = spots.select("_x", "_y", F.explode(grids.scalar()).alias("_g")).select("_x", "_y", "_g.*")
    seen = seen.withColumns({"cx": _cell(F.col("_x"), "ex"), "cy": _cell(F.col("_y"), "ey")})
    inside = (F.col("_x") >= F.col("ax")) & (F.col("_x") < F.col("ax") + F.col("width")) & (F.col("_y") >= F.col("ay")) & (F.col("_y") < F.col("ay") + F.col("height"))
    found = seen.join(cover, ["ex", "ey", "cx", "cy"]).where(inside).groupBy("_x", "_y").agg(F.min("ordinal").alias("_first"))
    met = (F.col("x").cast("double") == F.col("_x")) & (F.col("y").cast("double") == F.col("_y"))
    first = F.coalesce(F.col("_first"), F.lit(fallback).cast("bigint"))
    return points.join(found, met, "left").withColumn("ordinal", first).drop("_x", "_y", "_first")


def captured_square(x: Column, y: Column, size: Column, scale: Column, width: Column, height: Column) -> Column:
    """struct(x0, y0, side) within a screen: the side in pixels is kept between LEAST_SIDE and the screen's shorter
    side, and the square is moved inside. x and y are relative to the screen."""
    side = F.least(F.greatest(F.round(size * scale), F.lit(float(LEAST_SIDE))), F.least(width, height).cast("double"))
    corner = lambda at, most: F.least(F.greatest(F.round(at - side / 2), F.lit(0.0)), most.cast("double") - side).cast("int")
    return F.struct(corner(x, width).alias("x0"), corner(y, height).alias("y0"), side.cast("int").alias("side"))
