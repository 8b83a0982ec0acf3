"""Operator 7, mixing sources to target weights, by systematic sampling with DataFrame functions only.

Each source gets a share of all words by its weight, at most MAX_REPEAT times its own size; what a source
cannot take is shared again among the others by weight. Within a source every document has the same
expected number of copies, target / size of the source. Documents stand in an order by size level, hashed
shard, size and doc_id; the prefix sum of expected copies plus one random offset per source crosses
integers, and each crossing emits the document once. As neighbours in that order are of like size, the
words taken come near the target.

Scale: no window holds a source; ranks come from 64 shards of each size level and a prefix sum over their
counts (at most sources x levels x shards rows). The query shuffles doc_id, size and source only; the stage, which
ranks whole rows, shuffles their texts too.

Defined results: null text has size 0; a null source is a source of its own, last in order; repeated
rows and ties are each a document; an empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SHARDS, apart, materialize, md5_number, ranked, table, word_count

MAX_REPEAT = 3
SEED = "mix-1"
#: Sizes within about 5 % of each other are on one level.
LEVEL_BASE = 1.05


def source_targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) of (source, size): water filling over one row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("w", ((place - 1) % 3 + 1).cast("bigint")).withColumn("cap", F.col("source_size") * max_repeat)
    # Sources fill up in the order of cap / weight. With the first k of them full, the level of the others
    # is what remains over the weights that remain; it rises while a full source is taken out and falls
    # when one that isn't full is, so the level wanted is the highest.
    filling = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = filling.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_w = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0))
    by = by.withColumn("level", left / left_w).withColumn("level", F.max("level").over(everything))
    return by.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))


def mix(sized: DataFrame, max_repeat: int = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """Adds _source_size, _target and _copies to a table with doc_id, source and _size; its other columns stay."""
    by = source_targets(sized.select("source", F.col("_size").alias("size")), max_repeat)
    key = lambda source: F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    offset = md5_number(F.lit(seed + ":"), F.coalesce(F.col("source"), F.lit("\u0000"))) / F.lit(4294967296.0)
    by = by.select(key(F.col("source")).alias("_source"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), offset.alias("_offset"))
    level = F.floor(F.log(F.greatest(F.col("_size"), F.lit(1)).cast("double")) / F.log(F.lit(LEVEL_BASE)))
    shard = F.pmod(md5_number(F.lit(seed + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(SHARDS))
    placed = ranked(sized.withColumns({"_source": key(F.col("source")), "_level": level}), ["_source"], ["_level"], [F.col("_size"), F.col("doc_id")], shard, "_rank")
    placed = placed.join(by, "_source")  # one row per source: Spark broadcasts it when it sees its size
    each = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    reach = F.floor(F.col("_rank") * each + F.col("_offset")) - F.floor((F.col("_rank") - 1) * each + F.col("_offset"))
    return placed.withColumn("_copies", F.least(reach, F.lit(max_repeat)).cast("bigint")).drop("_level", "_rank", "_source", "_offset")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, size, source_size, target (of its source), taken (words, repeats counted)."""
    sized = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("_size"))
    taken = (F.col("_copies") * F.col("_size")).alias("taken")
    size, target = F.col("_size").alias("size"), F.col("_target").alias("target")
    return mix(materialize(sized)).select("doc_id", size, F.col("_source_size").alias("source_size"), target, taken)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as it is drawn, with the columns it had, whatever their names."""
    slim, whole = apart(docs, "doc_id", "source", "text")
    drawn = mix(slim.withColumn("_size", word_count(F.col("text")))).where("_copies > 0")
    return whole(drawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))))


#: The same in DuckDB's SQL.
OP7_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w, source_size * {MAX_REPEAT} AS cap FROM s
), f AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0))::BIGINT AS rest,
    (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS rest_w
  FROM w WINDOW b AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT *, max(rest / rest_w) OVER () AS level FROM f
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, w * level) AS target,
    ('0x' || substr(md5('{SEED}:' || coalesce(source, chr(0))), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM l
), r AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(ln(greatest(size, 1)::DOUBLE) / ln({LEVEL_BASE}::DOUBLE)),
    ('0x' || substr(md5('{SEED}/' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {SHARDS}, size, doc_id) AS place
  FROM d
), e AS (
  SELECT r.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS q
  FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (least(floor(place * q + u) - floor((place - 1) * q + u), {MAX_REPEAT}) * size)::BIGINT AS taken
FROM e
"""
