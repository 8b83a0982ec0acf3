"""Exact nearest neighbours of many vectors that leave most anchors alone: cells around pivots, and the triangle inequality.

Anchors are laid into cells by the pivot at the least angle, and cells are cut into shells by that angle and by octaves of length. Angles obey the
triangle inequality, so a query's angle to its pivots bounds its angle to every anchor of a shell, and with the longest and
shortest anchor there its score. A query first meets the shells of the best bounds, as many as hold k others; the k-th score
found is a threshold, and then it meets just those shells whose bound reaches it. Scores, rounding and ties are those of
neighbours.nearest_of_each, and so are the results, whatever the data: on vectors without clusters more shells are met.

Scale: pivots are as many as the root of the number of rows, PIVOTS at most of each dimension, out of a sample SAMPLED times as large; they
and one row of bounds for each shell (PIVOTS * SHELLS * BANDS at most, and those without a pivot) are all that the driver and every task hold.
Anchors are written once with their cells. Neighbouring shells are a block of about ANCHOR_BLOCK rows; it is dealt over tasks where it
holds more, and so are its visitors, so that neither a shell with a third of all anchors nor one that all queries visit is one
task. An anchor is copied only once for each QUERY_BLOCK visitors of its block, and not sent at all where there are none.

Defined results: null keys, and vectors that are null or hold nulls or numbers that aren't finite, take no part; a vector meets
those of its own length only, and lengths without a pivot are a cell that is bounded by length alone; vectors of length 0
score 0; an anchor with the query's id is not met; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vectors import scaled
from ..session import shared_folder
from .neighbours import ANCHOR_BLOCK, AT_ONCE, QUERY_BLOCK, best_of, hits_frame

PIVOTS, SHELLS, BANDS = 1024, 32, 8
#: Sampled anchors for each pivot.
SAMPLED = 4
#: Bounds that a task works on at a time.
BOUNDS_AT_ONCE = 2_000_000
SHELL, BLOCK = ["dim", "cell", "shell"], ["dim", "block"]
#: What rounding to six places and errors of an angle may take from a bound, the latter for each unit of length.
SLACK, LENGTH_SLACK = 2e-6, 1e-6


@dataclass(frozen=True)
class Found:
    """hits: (query_id, rank, idx, score); scored: one row with pairs that were scored and pairs there are."""

    hits: DataFrame
    scored: DataFrame


def _kept(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _vectors(df: DataFrame, key: str, vector: Column, out: str) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = df.where(F.col(key).isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return whole.select(F.col(key).cast("bigint").alias(key), F.size("embedding").alias("dim"), vector.alias(out))


def _pivots(anchors: DataFrame, most: int) -> dict[int, np.ndarray]:
    """Directions far from each other, taken one after the other from a sample of anchors, for each dimension."""
    n = min(most, int(np.ceil(np.sqrt(anchors.count()))))
    rows = anchors.where(F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("idx"), "idx", "v").limit(SAMPLED * n).collect()
    found = {}
    for dim in {r["dim"] for r in rows}:
        v = np.array([r["v"] for r in rows if r["dim"] == dim])
        v /= np.linalg.norm(v, axis=1)[:, None]
        taken, nearest = [0], v @ v[0]
        while len(taken) < n and nearest.min() < 1 - SLACK:
            taken.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, v @ v[taken[-1]])
        found[dim] = v[taken]
    return found


def _angles(v: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles of each vector to each pivot, and the vectors' lengths."""
    lengths = np.linalg.norm(v, axis=1)
    return np.arccos(np.clip((v / np.maximum(lengths, np.finfo(float).tiny)[:, None]) @ pivots.T, -1, 1)), lengths


def _celled(anchors: DataFrame, pivots: dict[int, np.ndarray], shells: int) -> DataFrame:
    """anchors with cell, shell, angle to the cell's pivot, and length."""

    def laid(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                v = np.stack(rows["v"].to_numpy()) if dim else np.zeros((len(rows), 0))
                if dim in pivots:
                    angles, lengths = _angles(v, pivots[dim])
                    cell = angles.argmin(axis=1)
                    angle = angles[np.arange(len(v)), cell]
                else:
                    lengths, cell, angle = np.linalg.norm(v, axis=1), -1, 0.0
                band = np.clip(np.frexp(lengths)[1] + BANDS // 2, 0, BANDS - 1)
                shell = np.minimum(np.floor(angle * (shells / np.pi)), shells - 1).astype("int32") * BANDS + band
                yield rows.assign(cell=cell, shell=shell, angle=angle, length=lengths)[["idx", "dim", "v", "cell", "shell", "angle", "length"]]

    return anchors.mapInPandas(laid, "idx bigint, dim int, v array<double>, cell int, shell int, angle double, length double")


def _bounds(q: np.ndarray, pivots: np.ndarray | None, shells: pd.DataFrame) -> np.ndarray:
    """Of each query and shell, what no score of the two can be above."""
    low, high = shells["low"].to_numpy(), shells["high"].to_numpy()
    cosine, lengths = np.ones((len(q), len(shells))), np.linalg.norm(q, axis=1)
    if pivots is not None:
        angles, lengths = _angles(q, pivots)
        own = angles[:, shells["cell"].to_numpy()]
        cosine = np.cos(np.clip(np.maximum(own - high, low - own), 0, np.pi))
    longest, shortest = shells["longest"].to_numpy(), shells["shortest"].to_numpy()
    return lengths[:, None] * np.where(cosine > 0, cosine * longest, cosine * shortest) + LENGTH_SLACK * longest


def _blocks(shells: pd.DataFrame, most: int) -> pd.DataFrame:
    """shells with a number, the block of neighbouring shells that it belongs to, and over how many tasks that is dealt."""
    shells = shells.astype({"dim": "int32", "cell": "int32", "shell": "int32"}).assign(number=np.arange(len(shells), dtype="int32"))
    before = shells.groupby("dim")["n"].cumsum() - shells["n"]
    shells["block"] = (before // most).astype("int32")
    shells["salts"] = (-(-shells.groupby(BLOCK)["n"].transform("sum") // most)).astype("int32")
    return shells


def _visits(queries: DataFrame, pivots: dict[int, np.ndarray], shells: pd.DataFrame, k: int, after: bool) -> DataFrame:
    """The shells that each query meets first, or those that it meets after, given its threshold."""
    of_dim = {int(dim): rows.reset_index(drop=True) for dim, rows in shells.groupby("dim")}

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                if dim not in of_dim or not dim:
                    continue
                own = of_dim[dim]
                step = max(1, BOUNDS_AT_ONCE // len(own))
                for at in range(0, len(rows), step):
                    part = rows.iloc[at : at + step]
                    bounds = _bounds(np.stack(part["q"].to_numpy()), pivots.get(dim), own)
                    order = np.argsort(-bounds, axis=1, kind="stable")
                    n = own["n"].to_numpy()[order]
                    first = np.empty(bounds.shape, bool)
                    np.put_along_axis(first, order, np.cumsum(n, axis=1) - n < k + 1, axis=1)
                    wanted = ~first & (bounds + SLACK >= part["least"].to_numpy()[:, None]) if after else first
                    i, j = np.nonzero(wanted)
                    if not len(i):
                        continue
                    block = own["block"].to_numpy()[j]
                    opens = np.flatnonzero(np.diff(i, prepend=-1).astype(bool) | np.diff(block, prepend=-1).astype(bool))
                    met = np.split(own["number"].to_numpy()[j], opens[1:])
                    yield part.iloc[i[opens]][["query_id", "dim", "q"]].assign(block=block[opens], shells=met)[["query_id", *BLOCK, "shells", "q"]]

    return _kept(queries.mapInPandas(chosen, "query_id bigint, dim int, block int, shells array<int>, q array<double>"))


def _met(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """What visitors of a block find in it: of each the best k among the shells that it asks for."""

    def rows(queries: pd.DataFrame, block: pd.DataFrame) -> Iterator[tuple[int, int, float]]:
        present, shell = np.unique(block["number"].to_numpy(), return_inverse=True)
        ids, v, q_ids = block["idx"].to_numpy(), np.vstack(block["v"].to_numpy()), queries["query_id"].to_numpy()
        for at in range(0, len(queries), AT_ONCE):
            part = queries.iloc[at : at + AT_ONCE]
            asks = np.zeros((len(part), len(present)), bool)
            wanted = np.concatenate(part["shells"].to_numpy())
            row, place = np.repeat(np.arange(len(part)), part["shells"].map(len)), np.minimum(np.searchsorted(present, wanted), len(present) - 1)
            asks[row, place] |= present[place] == wanted
            some = np.flatnonzero(asks.any(axis=0)[shell])
            scores = np.round(np.vstack(part["q"].to_numpy()) @ v[some].T, 6)
            for i in range(len(part)):
                own = np.flatnonzero(asks[i, shell[some]])
                yield from best_of(q_ids[at + i], ids[some[own]], scores[i, own], k)

    return lambda left, right: hits_frame(rows(left, right) if len(left) and len(right) else [])


def _scored(anchors: DataFrame, visits: DataFrame, k: int, query_block: int) -> DataFrame:
    """(query_id, idx, score): the best k of every block that a query meets."""
    parts = visits.groupBy(BLOCK).agg(F.ceil(F.count("*") / query_block).cast("int").alias("parts"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    a = anchors.join(parts, BLOCK).select("idx", "v", "number", *BLOCK, dealt(["idx", "v"], "salts").alias("salt"), every("parts").alias("part"))
    salts = anchors.groupBy(BLOCK).agg(F.first("salts").alias("salts")).join(parts, BLOCK)
    q = visits.join(salts, BLOCK).select("query_id", "q", "shells", *BLOCK, dealt(["query_id", "q"], "parts").alias("part"), every("salts").alias("salt"))
    keys = [*BLOCK, "salt", "part"]
    return q.groupBy(keys).cogroup(a.groupBy(keys)).applyInPandas(_met(k), "query_id bigint, idx bigint, score double")


def nearest_pruned(anchors: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, shells: int = SHELLS, anchor_block: int = ANCHOR_BLOCK, query_block: int = QUERY_BLOCK) -> Found:
    """The k nearest anchors (idx, embedding) of another id for each query (query_id, embedding), and the work it took."""
    a = _vectors(anchors, "idx", F.col("embedding").cast("array<double>"), "v")
    q = _kept(_vectors(queries, "query_id", scaled(F.col("embedding")), "q"))
    directions = _pivots(a, pivots)
    a = _kept(_celled(a, directions, shells))
    bounds = [F.min("angle").alias("low"), F.max("angle").alias("high"), F.min("length").alias("shortest"), F.max("length").alias("longest")]
    outlines = _blocks(a.groupBy(SHELL).agg(F.count("*").alias("n"), *bounds).orderBy(SHELL).toPandas(), anchor_block)
    places = q.sparkSession.createDataFrame(outlines[[*SHELL, "number", "block", "salts", "n"]], "dim int, cell int, shell int, number int, block int, salts int, n bigint")
    a = a.join(places.drop("n"), SHELL)
    first = _visits(q, directions, outlines, k, after=False)
    early = _kept(_scored(a, first, k, query_block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "idx"))
    least = early.withColumn("rank", rank).where(F.col("rank") == k).select("query_id", F.col("score").alias("least"))
    limits = q.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    then = _visits(limits, directions, outlines, k, after=True)
    hits = early.unionByName(_scored(a, then, k, query_block)).withColumn("rank", rank).where(F.col("rank") <= k)
    met_pairs = first.unionByName(then).select(F.explode("shells").alias("number")).join(places, "number").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("scored"))
    pairs = q.groupBy("dim").agg(F.count("*").alias("m")).join(a.groupBy("dim").agg(F.count("*").alias("n")), "dim").agg(F.coalesce(F.sum(F.col("m") * F.col("n")), F.lit(0)).alias("pairs"))
    none = F.lit(0).cast("bigint")
    work = met_pairs.withColumn("pairs", none).unionByName(pairs.withColumn("scored", none))
    return Found(hits.select("query_id", "rank", "idx", "score"), work.agg(F.sum("scored").alias("scored"), F.sum("pairs").alias("pairs")))
