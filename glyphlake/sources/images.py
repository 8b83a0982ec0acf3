"""Glyph images to embeddings: preparation with NumPy, inference with a model file that the caller names."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame

SIDE = 128


def resized(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """An image resized as functions.resample does it, in the same order of 32-bit numbers."""

    def along(source: np.ndarray) -> np.ndarray:
        n, one, half = len(source), np.float32(1), np.float32(0.5)
        ratio = np.float32(n) / np.float32(side)
        reach = max(ratio, one)
        at = (np.arange(side, dtype="float32") + half) * ratio
        first, last = np.maximum(np.floor(at - reach), 0).astype(int), np.minimum(np.ceil(at + reach), n).astype(int) - 1
        taken = first[:, None] + np.arange((last - first).max() + 1)
        raw = np.maximum(np.float32(0), one - np.abs((taken.astype("float32") - (at - half)[:, None]) / reach)) * (taken <= last[:, None])
        total, out = np.zeros(side, "float32"), np.zeros((side, *source.shape[1:]), "float32")
        for tap in raw.T:
            total += tap
        for weights, places in zip((raw / total[:, None]).T, np.minimum(taken, n - 1).T, strict=True):
            out += source[places] * weights.reshape(-1, *[1] * (source.ndim - 1))
        return out

    across = along(along(image.astype("float32")).swapaxes(0, 1)).swapaxes(0, 1)
    return np.floor(np.clip(across, 0, 255).astype(float) + 0.5)


def prepared(image: np.ndarray, side: int = SIDE) -> np.ndarray:
    """(3, side, side) 32-bit values in -1..1 of an RGB image, centred on a white square first."""
    h, w = image.shape[:2]
    n = max(h, w)
    square = np.full((n, n, 3), 255, dtype=np.uint8)
    square[(n - h) // 2 : (n - h) // 2 + h, (n - w) // 2 : (n - w) // 2 + w] = image
    return ((resized(square, side).astype("float32") / np.float32(255) - np.float32(0.5)) / np.float32(0.5)).transpose(2, 0, 1)


def rgb(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Pixels of Spark's image source, whose channels are in the order blue, green, red (and alpha)."""
    pixels = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    return np.repeat(pixels, 3, axis=2) if channels == 1 else pixels[:, :, 2::-1]


def embed(glyphs: DataFrame, model: str) -> DataFrame:
    """(path, label, embedding) of read_glyphs(); model is an ONNX file, shipped to the executors once."""
    glyphs.sparkSession.sparkContext.addFile(model)
    name = model.rpartition("/")[2]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import onnxruntime

        session = onnxruntime.InferenceSession(SparkFiles.get(name), providers=["CPUExecutionProvider"])
        source = session.get_inputs()[0].name
        for batch in batches:
            vectors = [session.run(None, {source: prepared(rgb(r.data, r.height, r.width, r.channels))[None]})[0].reshape(-1) for r in batch.itertuples()]
            yield pd.DataFrame({"path": batch["path"], "label": batch["label"], "embedding": vectors})

    return glyphs.mapInPandas(run, "path string, label string, embedding array<float>")
