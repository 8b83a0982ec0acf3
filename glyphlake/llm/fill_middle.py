"""Operator 13, fill-in-middle transformation with a sparse index of checkpoints.

A text is cut at two code points into prefix, middle and suffix, and the parts are written in the order of its form, each
after its mark. UTF-8 has no direct way to the k-th code point, so while the code points of a run of texts are counted,
their number before every STEP-th byte is recorded. A cut is then found by binary search among these checkpoints and a
rescan of at most STEP bytes from the nearest one. Where to cut, and which form, comes from the SHA-256 of seed and id, so
reruns agree.

Scale: a map over Arrow batches, taken in runs of some megabytes (one text at least); nothing is shuffled, and a lost
executor repeats only its own files. restored() rebuilds texts with built-in functions alone.

Defined results: a null text is empty; an empty text, and one that holds a mark, is plain; a null id is written as no
digits; equal rows get equal results; an empty table gives an empty result. Only the id and the text are read, so other
columns, whatever their names, change nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

#: The marks, and what the contract says of rates and seed.
MARKS = ("<P>", "<S>", "<M>")
SEED = "1:"
FIM_PERCENT, SPM_PERCENT = 90, 20
#: Bytes between checkpoints, and bytes of text held at once.
STEP, SLICE = 4096, 4_000_000
SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


class Checkpoints:
    """The number of code points before every STEP-th byte of a UTF-8 buffer."""

    def __init__(self, data: np.ndarray, step: int = STEP) -> None:
        self.data, self.step = data, step
        counts = [np.count_nonzero(self._first(at)) for at in range(0, len(data), step)]
        self.before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])

    def _first(self, at: int, end: int | None = None) -> np.ndarray:
        """Which bytes from at on, up to the next checkpoint or end, begin a code point."""
        return (self.data[at : at + self.step if end is None else end] & 0xC0) != 0x80

    def points_before(self, byte: int) -> int:
        at = byte // self.step * self.step
        return int(self.before[byte // self.step]) + int(np.count_nonzero(self._first(at, byte)))

    def byte_of(self, point: int) -> int:
        """Where code point number point begins; the end of the buffer, if it has no more than that many."""
        if point >= self.before[-1]:
            return len(self.data)
        i = int(np.searchsorted(self.before, point, side="right")) - 1
        return i * self.step + int(np.flatnonzero(self._first(i * self.step))[point - self.before[i]])


def _rows(ids: list[int | None], texts: pa.Array, seed: str, step: int) -> Iterator[tuple]:
    """SCHEMA's rows of some texts (no nulls); the output as bytes."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    offsets = offsets - offsets[0]
    index = Checkpoints(data, step)
    marks = [m.encode() for m in MARKS]
    start = 0  # code points before this text
    for doc_id, a, b in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        end = index.points_before(b)
        n, text = end - start, data[a:b].tobytes()
        digest = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
        if not n or h3 % 100 >= FIM_PERCENT or any(m in text for m in marks):
            yield doc_id, n, "plain", None, None, text
        else:
            cut, to = sorted((h1 % (n + 1), h2 % (n + 1)))
            i, j = index.byte_of(start + cut) - a, index.byte_of(start + to) - a
            prefix, middle, suffix, (p, s, m) = text[:i], text[i:j], text[j:], marks
            form, parts = ("spm", (s, suffix, p, prefix, m, middle)) if h4 % 100 < SPM_PERCENT else ("psm", (p, prefix, s, suffix, m, middle))
            yield doc_id, n, form, cut, to - cut, b"".join(parts)
        start = end


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: str = SEED, step: int = STEP) -> DataFrame:
    """SCHEMA's columns for every row: code points, form, code points of prefix and middle (null if plain), and the output."""

    def transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        for batch in batches:
            ids, at = batch.column(0), 0
            for part in slices(batch.column(1), SLICE):
                columns = zip(*_rows(ids.slice(at, len(part)).to_pylist(), part.fill_null(""), seed, step), strict=True)
                arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].cast(pa.string())], names=names)
                at += len(part)

    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(transformed, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. No part holds a mark, so marks are where the output splits."""
    parts = F.split(output, f"<[{''.join(m[1] for m in MARKS)}]>")
    joined = lambda *order: F.concat(*[F.get(parts, i) for i in order])
    return F.when(form == "psm", joined(1, 3, 2)).when(form == "spm", joined(2, 3, 1)).otherwise(output)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


#: The same in DuckDB's SQL; the text itself stands for the rebuilt one.
OP13_SQL = f"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
), h AS (
  SELECT *, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d
), f AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {FIM_PERCENT} THEN 'plain'
      WHEN h4 % 100 < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form
  FROM h
), p AS (
  SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1, n - b) AS suffix FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
