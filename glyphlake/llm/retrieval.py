"""Operator 10, exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, floor(256 * x). Candidates are grouped by length: a level holds norms within a
factor of sqrt(1.1) and is split into shards of about SHARD_ROWS rows, however many share it. A first pass
scores every query against the SEED_ROWS longest vectors, which gives it a lower bound for its k-th score.
A query then visits only the levels whose longest vector can still reach that bound. In a bucket the local
cosine threshold, bound / (query norm x level norm), decides: from COORDINATE_FROM on the query's largest
coordinates and Cauchy-Schwarz over the rest leave few candidates, below it only lengths prune. What
remains is verified by exact integer products: where lengths are below 2^52 together, every product and partial sum is a
whole number that a double holds, and beyond that the products within rounding of the k-th are formed again in integers
of any size. Seed bounds are lowered by what rounding may add.

Scale: queries of a level go in blocks of about QUERY_BLOCK, so a task holds one shard and one block, and a level's
candidates are sent once to each block of the queries that visit it, not at all if none does. Only the seed (at
most SEED_ROWS vectors) and one row per level go through the driver.

Defined results: vectors that are null or have null or non-finite components, and null ids, take no part;
vectors meet only those of their own dimension; ties go to the smaller id; a row is a query of its own, also where ids
repeat, and meets every row but itself; scores are ordered as exact integers within a bucket and given, and merged,
within the range of 64 bits; no candidates, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, table

K = 5
SCALE = 256
QUERY_EVERY = 50
LEVEL_BASE = 1.1
SHARD_ROWS, QUERY_BLOCK, SEED_ROWS = 16_384, 8192, 1024
COORDINATE_FROM, FOCUS = 0.8, 8


def quantised(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v, dim, norm2, level) of the rows that take part; v holds whole numbers as doubles."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    v = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    df = df.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound).select("vec_id", v.alias("v"))
    df = df.withColumns({"dim": F.size("v"), "norm2": F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)})
    level = F.when(F.col("norm2") > 0, F.floor(F.log("norm2") / F.log(F.lit(LEVEL_BASE)))).otherwise(F.lit(-1))
    return df.withColumn("level", level.cast("int"))


#: Products of lengths below this are exact in doubles, whatever the order of the sums.
EXACT = 2.0**52


def _slack(dim: int, length: np.ndarray | float, longest: float) -> np.ndarray | float:
    """What rounding may add to or take from an inner product in doubles; nothing while all is exact."""
    most = np.asarray(length) * longest
    return np.where(most < EXACT, 0.0, most * (dim + 2) * 2.3e-16)


def _verified(q: np.ndarray, c: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int, slack: float) -> Iterator[tuple[int, int]]:
    """(place, score) of the k best, ties to the smaller id, in integers. scores: products in doubles, -inf for none."""
    if slack:
        near = np.flatnonzero(scores > -np.inf)
        if len(near) > k:
            near = near[scores[near] >= np.partition(scores[near], len(near) - k)[len(near) - k] - 2 * slack]
        whole = [int(x) for x in q.tolist()]
        exact = [(sum(a * int(b) for a, b in zip(whole, c[j].tolist(), strict=True)), int(ids[j]), int(j)) for j in near]
        for score, _, j in sorted(exact, key=lambda x: (-x[0], x[1]))[:k]:
            yield j, min(max(score, -(2**63)), 2**63 - 1)
    else:
        for j in _top(scores, ids, k):
            if scores[j] > -np.inf:
                yield int(j), int(scores[j])


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > k:
        keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _search(queries: pd.DataFrame, bucket: pd.DataFrame, k: int) -> Iterator[tuple[int, int, int, int]]:
    """The k best of one bucket for each query, (query, query_id, vec_id, score), leaving out what cannot reach its bound."""
    bucket = bucket.sort_values("norm2", ascending=False)
    ids, own, norms, c = bucket["vec_id"].to_numpy(), bucket["row"].to_numpy(), np.sqrt(bucket["norm2"].to_numpy()), np.vstack(bucket["v"].to_numpy())
    q, q_rows, q_ids, bounds = np.vstack(queries["v"].to_numpy()), queries["query"].to_numpy(), queries["query_id"].to_numpy(), queries["bound"].to_numpy()
    lengths = np.sqrt(queries["norm2"].to_numpy())
    slack = _slack(q.shape[1], lengths, norms[0])
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.where(bounds > 0, bounds / (lengths * norms[0]), -1.0)
        shortest = np.where((bounds > 0) & (lengths > 0), bounds / lengths, 0.0)
    # a little slack, so that rounding of square roots never prunes a vector that just reaches its bound
    reach = np.searchsorted(-norms, -(shortest * (1 - 1e-9)), side="right")
    by_coordinate = cosine >= COORDINATE_FROM
    for i in np.flatnonzero(by_coordinate & (reach > 0)):
        focus = np.argsort(-np.abs(q[i]))[:FOCUS]
        part = c[: reach[i], focus]
        rest_c = np.sqrt(np.maximum(norms[: reach[i]] ** 2 - np.einsum("ij,ij->i", part, part), 0))
        rest_q = np.sqrt(max(lengths[i] ** 2 - float(q[i, focus] @ q[i, focus]), 0))
        near = np.flatnonzero(part @ q[i, focus] + rest_c * rest_q >= bounds[i] - 1e-6 * abs(bounds[i]) - 1e-6 - slack[i])
        near = near[own[near] != q_rows[i]]
        for j, score in _verified(q[i], c[near], c[near] @ q[i], ids[near], k, slack[i]):
            yield int(q_rows[i]), int(q_ids[i]), int(ids[near[j]]), score
    by_length = np.flatnonzero(~by_coordinate & (reach > 0))
    for block in np.array_split(by_length, max(1, len(by_length) // 256)):
        if len(block):
            scores = q[block] @ c[: reach[block].max()].T
            for row, i in zip(scores, block, strict=True):
                row = np.where(own[: len(row)] == q_rows[i], -np.inf, row)
                for j, score in _verified(q[i], c[: len(row)], row, ids[: len(row)], k, slack[i]):
                    yield int(q_rows[i]), int(q_ids[i]), int(ids[j]), score


def top_k(candidates: DataFrame, queries: DataFrame, k: int = K, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, seed_rows: int = SEED_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): both inputs as quantised() gives them, with a number of its own for each row."""
    schema = "query bigint, query_id bigint, vec_id bigint, score bigint"
    levels = candidates.groupBy("dim", "level").count().collect()  # one row per dimension and level
    if not levels:
        return candidates.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    seed = candidates.orderBy(F.desc("norm2"), "vec_id").limit(seed_rows).select("row", "v", "dim").toPandas()
    seeds = {d: (g["row"].to_numpy(), np.vstack(g["v"].to_numpy())) for d, g in seed.groupby("dim") if d}

    def bounded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bounds = []
            for query, v, dim, norm2 in zip(batch["query"], batch["v"], batch["dim"], batch["norm2"], strict=True):
                rows, c = seeds.get(dim, (np.empty(0), np.empty((0, dim))))
                scores = (c @ np.asarray(v))[rows != query]
                less = float(_slack(dim, np.sqrt(norm2), np.sqrt((c * c).sum(axis=1).max(initial=0.0))))
                bounds.append(float(np.partition(scores, len(scores) - k)[len(scores) - k]) - less if len(scores) >= k else -np.inf)
            yield batch.assign(bound=bounds)

    asked = queries.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "v", "dim", "norm2")
    asked = asked.mapInPandas(bounded, "query bigint, query_id bigint, v array<double>, dim int, norm2 double, bound double")
    shards = {(r["dim"], r["level"]): -(-r["count"] // shard_rows) for r in levels}
    hashed = lambda c, n: F.pmod(F.xxhash64(c), n)
    # where a query goes: all shards of the levels of its dimension that can reach its bound
    places = F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(lv).alias("level"), F.lit(n).alias("shards"), F.lit(LEVEL_BASE ** (lv + 1) if lv >= 0 else 0.0).alias("most2")) for (d, lv), n in sorted(shards.items())])
    can = lambda p: (p["dim"] == F.col("dim")) & ((F.col("bound") <= 0) | (F.sqrt(p["most2"] * F.col("norm2")) * 1.000001 >= F.col("bound")))
    asked = materialize(asked.withColumn("place", F.explode(F.filter(places, can))).select("query", "query_id", "v", "norm2", "bound", "dim", F.col("place.level").alias("level"), F.col("place.shards").alias("shards")))
    blocks = {(r["dim"], r["level"]): -(-r["count"] // query_block) for r in asked.groupBy("dim", "level").count().collect()}
    if not blocks:
        return candidates.sparkSession.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    of_level = lambda numbers: F.try_element_at(F.create_map(*[x for (d, lv), n in sorted(numbers.items()) for x in (F.lit(f"{d}/{lv}"), F.lit(n))]), F.concat_ws("/", "dim", "level"))
    asked = asked.withColumn("block", hashed("query", of_level(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    rows = candidates.withColumn("shard", hashed("row", of_level(shards)).cast("int")).withColumn("blocks", of_level(blocks)).where("blocks IS NOT NULL")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    keys = ["dim", "level", "shard", "block"]

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(_search(left, right, k)) if len(left) and len(right) and left["dim"].iat[0] else []
        return pd.DataFrame(found, columns=["query", "query_id", "vec_id", "score"]).astype("int64")

    found = asked.groupBy(keys).cogroup(rows.groupBy(keys)).applyInPandas(searched, schema)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_norm_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors of each query: query_id, rank, vec_id, score."""
    vectors = materialize(quantised(table(spark, sf_dir, "embeddings")).withColumn("row", F.monotonically_increasing_id()))
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


OP10_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::HUGEINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda x: x[1] * x[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % {QUERY_EVERY} = 0 AND q.r <> c.r AND len(q.v) = len(c.v) AND len(q.v) > 0
), r AS (
  SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}
"""
