"""The commands: look-up, search, graph, home page, radical browsing, recognition.

Each takes the dictionary and the user's input and gives a DataFrame; a look-up of what is not there raises.
"""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.codepoints import codepoint_char, is_codepoint_query, normalize_query, routed_query
from .operators import browse, graph, neighbours
from .operators import search as texts
from .operators.entry import Dictionary, entries
from .operators.phrase_index import PhraseIndex
from .sources.files import read_glyphs
from .sources.images import embed


def query_key(spark: SparkSession, query: str) -> DataFrame:
    """(codepoint) of what a user typed; raises ValueError if it names none."""
    key = spark.range(1).select(normalize_query(routed_query(F.lit(query))).alias("codepoint"))
    if key.first()["codepoint"] is None:
        raise ValueError(f"no character or code point: {query!r}")
    return key


def lookup(spark: SparkSession, d: Dictionary, query: str) -> DataFrame:
    """The entry of one character; raises KeyError if the dictionary has none."""
    found = entries(d, query_key(spark, query))
    if found.isEmpty():
        raise KeyError(query)
    return found


def search(d: Dictionary, query: str, limit: int = 50, fold: bool = False, index: PhraseIndex | None = None) -> DataFrame:
    """Hits of a phrase; with fold, letters count as equal whatever their diacritics. An index, if given, is read instead of the texts."""
    if index is not None:
        return texts.with_gloss(index.search(query), d.character_meanings, limit)
    return texts.search(d.fts_search, d.character_meanings, query, limit, fold)


def submit(spark: SparkSession, d: Dictionary, query: str, limit: int = 50) -> DataFrame:
    """What the search bar gives: the entry of one character or code point, for anything else the hits of the phrase."""
    if spark.range(1).select(is_codepoint_query(F.lit(query))).first()[0]:
        return lookup(spark, d, query)
    return search(d, query, limit)


def variant_graph(spark: SparkSession, d: Dictionary, query: str) -> DataFrame:
    return graph.variant_graph(query_key(spark, query), d.variant_family, d.variant_edges)


def home_data(d: Dictionary, day: datetime.date) -> DataFrame:
    return browse.home_data(d, day)


def radical_chars(d: Dictionary, radical_idx: int, limit: int = 500) -> DataFrame:
    return browse.radical_chars(d, radical_idx, limit)


def recognize_vector(anchors: DataFrame, class_index: DataFrame, vector: list[float], k: int = 6) -> DataFrame:
    """(codepoint, character, score) of the k anchors most like a vector."""
    hits = neighbours.decoded(neighbours.nearest(anchors, vector, k), class_index)
    return hits.orderBy(F.desc("score"), "idx").select("codepoint", codepoint_char(F.col("codepoint")).alias("character"), "score")


def recognize_image_files(spark: SparkSession, anchors: DataFrame, class_index: DataFrame, folder: str, model: str, k: int = 6) -> DataFrame:
    """(path, rank, codepoint, character, score) for every image of a folder."""
    glyphs = embed(read_glyphs(spark, folder), model).withColumn("query_id", -1 - F.xxhash64("path").bitwiseAND(F.lit((1 << 62) - 1)))
    # the model runs once for each image, though its vectors are counted, compared and named
    glyphs = glyphs.checkpoint() if spark.conf.get("spark.checkpoint.dir", None) else glyphs.persist()
    hits = neighbours.decoded(neighbours.nearest_of_each(anchors, glyphs, k), class_index)
    named = hits.join(glyphs.select("query_id", "path"), "query_id")
    return named.select("path", "rank", "codepoint", codepoint_char(F.col("codepoint")).alias("character"), "score")
