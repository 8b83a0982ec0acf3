"""Phrase search by a positional inverted index, written once and read by token.

A text's identity is its key and a hash of the row, so it is the same whenever it is computed. The index has three tables:
  postings  (token, key, row, field, positions): where a token stands in a field of a row, in folders by write (part), by a hash
            of the token (bucket) and by one of the key (slice), and sorted by token within a file;
  tokens    (token, rows): in how many fields of rows a token stands, one row for each write;
  rows      (key, row, and the columns that a hit shows), without the texts.
A phrase reads the postings of its tokens alone: the buckets by folder, the tokens by the files' statistics. They are joined
by row, rarest token first, each time keeping the places at which the phrase can begin, so after the first join only rows
that still can be hits are left.

Scale: the build shuffles occurrences once, after the task that reads a text has gathered its positions. The number of
slices follows the numbers of rows and of characters, so a token in every row is cut into parts of about SLICE_ROWS rows, and a
bucket's part of a slice, which one task gathers, has about SLICE_CHARS / BUCKETS characters, both as files and as tasks. Each write appends; no earlier file is read or changed.

Defined results: rows with a null key are not found; equal rows are each a hit; a phrase without tokens has no hits; null
and empty texts have no tokens.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .search import SEPARATORS, base_letters, folded, phrase_tokens

BUCKETS, SLICE_ROWS, SLICE_CHARS = 16, 1_000_000, 64_000_000


def text_tokens(text: Column, fold: bool = False) -> Column:
    """Tokens of a text in order, as phrase search sees them."""
    plain = F.coalesce(text, F.lit(""))
    return F.filter(F.split(folded(plain) if fold else F.lower(plain), SEPARATORS), lambda t: t != "")


@dataclass(frozen=True)
class PhraseIndex:
    """A written index: its folder, the name of the key, how tokens were made, and the tables' columns."""

    spark: SparkSession
    path: str
    key: str
    fold: bool
    buckets: int
    schemas: dict[str, StructType]

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.path}/{name}")

    def tokens(self) -> DataFrame:
        """(token, rows): in how many fields of rows each token stands."""
        return self._table("tokens").groupBy("token").agg(F.sum("rows").alias("rows"))

    def postings(self, token: str) -> DataFrame:
        """The rows of one token; the literal bucket lets Spark open that folder alone."""
        bucket = self.spark.range(1).select(_bucket(F.lit(token), self.buckets)).first()[0]
        return self._table("postings").where((F.col("bucket") == bucket) & (F.col("token") == token))

    def matches(self, phrase: str) -> DataFrame:
        """(key, row): rows in one of whose fields the tokens of phrase stand side by side."""
        words = phrase_tokens(base_letters(phrase) if self.fold else phrase)
        if not words:
            return self._table("rows").select(self.key, "row").limit(0)
        # one row for each different token of the phrase
        counts = {r["token"]: r["rows"] for r in self.tokens().where(F.col("token").isin(sorted(set(words)))).collect()}
        order = sorted(range(len(words)), key=lambda i: (counts.get(words[i], 0), i))
        place = [self.key, "row", "field", "slice"]
        starts = lambda at: F.transform("positions", lambda p: p - at)
        found = self.postings(words[order[0]]).select(*place, starts(order[0]).alias("starts"))
        for at in order[1:]:
            following = self.postings(words[at]).select(*place, starts(at).alias("others"))
            found = found.join(following, place).select(*place, F.array_intersect("starts", "others").alias("starts")).where(F.size("starts") > 0)
        return found.select(self.key, "row").distinct()

    def search(self, phrase: str) -> DataFrame:
        """The indexed rows, without their texts, that have the phrase."""
        return self._table("rows").join(self.matches(phrase), [self.key, "row"], "left_semi").drop("row")


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def write_index(texts: DataFrame, path: str, key: str = "codepoint", columns: tuple[str, ...] = ("hanja", "body"), shown: tuple[str, ...] = ("hanja",), fold: bool = False, buckets: int = BUCKETS, slice_rows: int = SLICE_ROWS, slice_chars: int = SLICE_CHARS) -> PhraseIndex:
    """Adds texts to the index at path, which is made if missing; later writes must use the same key, columns, fold and buckets."""
    spark, used, part = texts.sparkSession, dict.fromkeys((*columns, *shown)), uuid.uuid4().hex
    texts = texts.where(F.col(key).isNotNull()).select(key, F.xxhash64(*used).alias("row"), *used)
    size = texts.agg(F.count("*").alias("rows"), F.sum(sum(F.coalesce(F.length(c), F.lit(0)) for c in columns)).alias("chars")).first()
    slices = max(1, -(-size["rows"] // slice_rows), -(-(size["chars"] or 0) // slice_chars))
    fields = F.posexplode(F.array(*[text_tokens(F.col(c), fold) for c in columns])).alias("field", "words")
    spots = texts.select(key, "row", fields).select(key, "row", "field", F.posexplode("words").alias("position", "token"))
    spots = spots.withColumns({"part": F.lit(part), "bucket": _bucket(F.col("token"), buckets), "slice": F.pmod(F.xxhash64(key), F.lit(slices)).cast("int")})
    # the grouping holds the keys of the writing, so one shuffle serves both
    spots = spots.repartition("bucket", "slice") if slices == 1 else spots.repartition(buckets * slices, "bucket", "slice")
    postings = spots.groupBy("part", "bucket", "slice", "token", key, "row", "field").agg(F.sort_array(F.collect_set("position")).alias("positions"))
    folders = ("part", "bucket", "slice")
    postings.sortWithinPartitions(*folders, "token", key).write.mode("append").partitionBy(*folders).parquet(f"{path}/postings")
    hits = texts.select(key, "row", *shown)
    counts = StructType().add("token", "string").add("rows", "long")
    index = PhraseIndex(spark, path, key, fold, buckets, {"postings": postings.schema, "tokens": counts, "rows": hits.schema})
    written = index._table("postings").where(F.col("part") == part)
    written.groupBy("token").agg(F.count("*").alias("rows")).write.mode("append").parquet(f"{path}/tokens")
    hits.write.mode("append").parquet(f"{path}/rows")  # last, as hits are rows of this table
    return index
