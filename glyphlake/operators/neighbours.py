"""Cosine nearest neighbours over anchors, their names, and the accuracy of the recognition.

Queries are scaled to length 1, anchors are taken as they are. Scores are rounded to six places; ties go to
the smaller idx. One vector is a projection of built-in functions and a top-k; many vectors meet the anchors
in a grid of blocks, so that a task holds one block of either and no side is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import dot, scaled

ANCHOR_BLOCK, QUERY_BLOCK = 32_768, 8_192
#: Queries of a block that are scored at a time.
AT_ONCE = 256


def nearest(anchors: DataFrame, vector: list[float], k: int) -> DataFrame:
    """(idx, score) of the k anchors (idx, embedding) most like one vector."""
    norm = max(float(np.sqrt(np.sum(np.square(vector)))), 1e-8)
    q = F.array(*[F.lit(float(x) / norm) for x in vector])
    own = anchors.where(F.size("embedding") == len(vector))
    return own.select("idx", F.round(dot(F.col("embedding"), q), 6).alias("score")).orderBy(F.desc("score"), "idx").limit(max(1, k))


def _best(queries: pd.DataFrame, block: pd.DataFrame, k: int) -> Iterator[tuple[int, int, float]]:
    ids, q_ids = block["idx"].to_numpy(), queries["query_id"].to_numpy()
    q, v = np.vstack(queries["q"].to_numpy()), np.vstack(block["v"].to_numpy()).T
    scores = (row for at in range(0, len(q), AT_ONCE) for row in np.round(q[at : at + AT_ONCE] @ v, 6))
    for query_id, row in zip(q_ids, scores, strict=True):
        yield from best_of(query_id, ids, row, k)


def best_of(query_id: int, ids: np.ndarray, scores: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """(query_id, idx, score) of the k best scores of other ids."""
    other = np.flatnonzero(ids != query_id)
    if len(other) > k:
        other = other[scores[other] >= np.partition(scores[other], len(other) - k)[len(other) - k]]
    for i in other[np.lexsort((ids[other], -scores[other]))[:k]]:
        yield int(query_id), int(ids[i]), float(scores[i])


def hits_frame(rows: Iterable[tuple[int, int, float]]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=["query_id", "idx", "score"]).astype({"query_id": "int64", "idx": "int64", "score": "float64"})


def nearest_of_each(anchors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, idx, score): for each query (query_id, embedding) its k nearest anchors of another id."""
    n_anchor = max(1, -(-anchors.count() // ANCHOR_BLOCK))
    n_query = max(1, -(-queries.count() // QUERY_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    whole = lambda df, c: df.where(F.col(c).isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull()))
    a = whole(anchors, "idx").select(F.col("idx").cast("bigint").alias("idx"), F.col("embedding").cast("array<double>").alias("v"), F.size("embedding").alias("dim"), block("idx", n_anchor).alias("a"), every(n_query).alias("b"))
    q = whole(queries, "query_id").select(F.col("query_id").cast("bigint").alias("query_id"), scaled(F.col("embedding")).alias("q"), F.size("embedding").alias("dim"), every(n_anchor).alias("a"), block("query_id", n_query).alias("b"))

    def met(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return hits_frame(_best(left, right, k) if len(left) and len(right) and left["dim"].iat[0] else [])

    keys = ["dim", "a", "b"]
    found = q.groupBy(keys).cogroup(a.groupBy(keys)).applyInPandas(met, "query_id bigint, idx bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "idx"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "idx", "score")


def decoded(hits: DataFrame, class_index: DataFrame) -> DataFrame:
    """hits with codepoint: empty for an idx that the index does not name."""
    names = class_index.groupBy("idx").agg(F.max("codepoint").alias("codepoint"))
    return hits.join(names, "idx", "left").withColumn("codepoint", F.coalesce("codepoint", F.lit("")))


def accuracy(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: n, top1, top5, top1_percent, top5_percent, passed (60 % of n, rounded down) from (query_id, rank, label)
    and (query_id, label). Without queries the percentages are null."""
    got = hits.join(truth.withColumnRenamed("label", "true_label"), "query_id").where(F.col("label") == F.col("true_label"))
    best = truth.select("query_id").join(got.groupBy("query_id").agg(F.min("rank").alias("rank")), "query_id", "left")
    out = best.agg(F.count("*").alias("n"), F.count_if(F.col("rank") <= 1).alias("top1"), F.count_if(F.col("rank") <= 5).alias("top5"))
    share = lambda c: F.round(F.try_divide(F.lit(100.0) * F.col(c), F.col("n")), 6)
    return out.withColumns({"top1_percent": share("top1"), "top5_percent": share("top5"), "passed": F.col("top1") >= F.floor(F.col("n") * 6 / 10)})
