"""Operator 8, packing into optimal length buckets.

Lengths are tokens of whole texts, as operator 1 counts them. Dynamic programming over their exact global
histogram chooses at most N_BUCKETS boundaries such that the padding, boundary minus length summed over all
documents, is least: a bucket's cost is linear in its boundary, so the best place of the boundary before lies
on a hull of lines that is walked once per bucket. Within a bucket, batches hold token budget / boundary
documents, numbered by rank.

Scale: one pass without a shuffle counts tokens; the histogram is one aggregation, and the driver holds a row
for each distinct length, never more than the longest document has tokens; ranks within a bucket come from
hashed shards, as many as the rows ask for, and a prefix sum, so a bucket with a third of all documents is
never in one task. Texts are not shuffled, only ids and lengths.

Defined results: null text has length 0 and goes to the smallest bucket, whose boundary is 1 at least;
documents longer than the budget are batches of their own; repeated rows and ties are each a document; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SHARDS, materialize, ranked, table
from .token_counts import token_count

N_BUCKETS = 16
TOKEN_BUDGET = 16_384
#: Rows that share a shard when they are ranked.
SHARD_ROWS = 200_000


def best_boundaries(lengths: list[int], counts: list[int], sums: list[int], k: int = N_BUCKETS) -> list[int]:
    """At most k of the ascending lengths, the last included, with the least padding in total; sums are those of the
    true lengths in each cell."""
    m = len(lengths)
    c, s = [0], [0]
    for n, total in zip(counts, sums, strict=True):
        c.append(c[-1] + int(n))
        s.append(s[-1] + int(total))
    cost: list[int | None] = [0, *[None] * m]  # of the first j cells
    choices = []
    for _ in range(min(k, m)):
        new, pick = [0, *[None] * m], [0] * (m + 1)
        # Cells i..j-1 in one bucket cost lengths[j-1] * (c[j] - c[i]) - (s[j] - s[i]), which is a line in lengths[j-1]
        # with slope -c[i]. Slopes fall and the points asked for rise, so the lowest line only moves on.
        hull: list[int] = []
        best = 0
        height = lambda i: cost[i] + s[i]  # noqa: B023, E731
        for j in range(1, m + 1):
            if cost[j - 1] is not None:
                while len(hull) >= 2 and (height(j - 1) - height(hull[-2])) * (c[hull[-1]] - c[hull[-2]]) <= (height(hull[-1]) - height(hull[-2])) * (c[j - 1] - c[hull[-2]]):
                    hull.pop()
                hull.append(j - 1)
                best = min(best, len(hull) - 1)
            x = lengths[j - 1]
            while best + 1 < len(hull) and height(hull[best + 1]) - x * c[hull[best + 1]] <= height(hull[best]) - x * c[hull[best]]:
                best += 1
            i = hull[best]
            pick[j] = i
            new[j] = height(i) - x * c[i] + x * c[j] - s[j]
        choices.append(pick)
        cost = new
    bounds, j = [], m
    for pick in reversed(choices):
        if j > 0:
            bounds.append(int(lengths[j - 1]))
            j = pick[j]
    return bounds[::-1]


def bucketed(lengths: DataFrame, n_buckets: int = N_BUCKETS, budget: int = TOKEN_BUDGET) -> DataFrame:
    """Adds bucket, boundary, padding and batch to a table with doc_id and length."""
    cell = F.greatest(F.col("length"), F.lit(1)).cast("bigint").alias("cell")
    cells = lengths.groupBy(cell).agg(F.count("*").alias("n"), F.sum("length").alias("total")).toArrow().sort_by("cell")
    if not len(cells):
        return lengths.withColumns({"bucket": F.lit(0), "boundary": F.lit(0).cast("bigint"), "padding": F.lit(0).cast("bigint"), "batch": F.lit(0).cast("bigint")})
    counts = cells["n"].to_pylist()
    bounds = best_boundaries(cells["cell"].to_pylist(), counts, cells["total"].to_pylist(), n_buckets)
    bucket = F.lit(len(bounds) - 1)
    for i in reversed(range(len(bounds) - 1)):
        bucket = F.when(F.col("length") <= bounds[i], F.lit(i)).otherwise(bucket)
    df = lengths.withColumn("bucket", bucket).withColumn("boundary", F.element_at(F.array(*map(F.lit, bounds)), F.col("bucket") + 1).cast("bigint"))
    shards = max(SHARDS, sum(counts) // SHARD_ROWS)
    shard = F.pmod(F.xxhash64("doc_id", "length"), F.lit(shards))
    df = ranked(df, ["bucket"], [], [F.col("doc_id"), F.col("length")], shard, "_rank")
    size = F.greatest(F.floor(F.lit(budget) / F.col("boundary")), F.lit(1))
    return df.withColumns({"padding": F.col("boundary") - F.col("length"), "batch": F.floor((F.col("_rank") - 1) / size).cast("bigint")}).drop("_rank")


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, length in tokens, bucket, boundary, padding, batch within the bucket."""
    lengths = table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("length"))
    return bucketed(materialize(lengths))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document, as often as it is in docs, with its batch."""
    return bucketed(materialize(docs.select("doc_id", token_count(F.col("text")).alias("length"))))
