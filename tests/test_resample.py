"""Resizing and padding against plain loops over 32-bit numbers, and against the arrays that models are fed with."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.functions import resample
from glyphlake.sources import images


def plain(image: np.ndarray, side: int) -> np.ndarray:
    f = np.float32

    def along(line):
        n, out = len(line), []
        ratio = f(n) / f(side)
        reach = max(ratio, f(1))
        for o in range(side):
            at = (f(o) + f(0.5)) * ratio
            taken = range(max(0, math.floor(at - reach)), min(n, math.ceil(at + reach)))
            weights = [max(f(0), f(1) - abs((f(i) - (at - f(0.5))) / reach)) for i in taken]
            total = f(0)
            for w in weights:
                total += w
            value = f(0)
            for i, w in zip(taken, weights, strict=True):
                value += line[i] * (w / total)
            out.append(value)
        return np.array(out, dtype="float32")

    rows = np.stack([along(c) for c in image.astype("float32").T]).T
    return np.array([[math.floor(float(min(max(v, 0), 255)) + 0.5) for v in along(r)] for r in rows])


@pytest.mark.parametrize(("height", "width"), [(1, 1), (2, 7), (9, 9), (13, 4), (40, 33)])
def test_resized(spark, height, width):
    image = np.random.default_rng(height).integers(0, 256, size=(height, width))
    df = spark.createDataFrame([(image.ravel().tolist(), height, width)], "p array<int>, h int, w int")
    for side in (1, 6, 9, 20):
        got = df.select(resample.resized(F.col("p"), F.col("h"), F.col("w"), side)).first()[0]
        assert np.array_equal(np.array(got).reshape(side, side), plain(image, side))
        assert np.array_equal(images.resized(image[:, :, None], side)[:, :, 0], plain(image, side))


def test_what_a_model_is_fed_with(spark):
    image = np.random.default_rng(1).integers(0, 256, size=(5, 8)).astype("uint8")
    square = resample.squared(F.col("p"), F.lit(5), F.lit(8))
    df = spark.createDataFrame([(image.ravel().tolist(),)], "p array<int>").select(square.alias("s"))
    assert df.select(F.slice("s", 1, 16)).first()[0] == [255] * 8 + image[0].tolist()  # one row above, two below
    fed = df.select(resample.normalised(resample.resized(F.col("s"), F.lit(8), F.lit(8), 6))).first()[0]
    expected = images.prepared(np.repeat(image[:, :, None], 3, axis=2), 6)
    assert np.array_equal(np.array(fed, dtype="float32").reshape(6, 6), expected[0]) and expected.shape == (3, 6, 6)


def test_same_size_and_nulls(spark):
    df = spark.createDataFrame([([0, 90, 200, 255], 2), (None, 2)], "p array<int>, n int")
    assert [r[0] for r in df.select(resample.resized(F.col("p"), F.col("n"), F.col("n"), 2)).collect()][0] == [0, 90, 200, 255]
