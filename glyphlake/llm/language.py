"""Operator 5, language identification by sparse multinomial logistic regression on character n-grams.

Texts, lower-cased, become hashed counts of 1- to 3-grams of characters, weighted (1 + log tf) * idf and scaled
to length 1. Document frequencies count every training document. Weights are learned by
follow-the-regularised-leader with an elastic net (most stay zero) on a bounded sample, at most PER_LANGUAGE
documents of each language and SAMPLE in all, those with the least hashes of doc_id and text; every fifth is kept back, and
on these one temperature is calibrated. Predictions read whole texts, and nothing but the text. In the pipeline,
texts go whose score is below halfway from chance, 1 / number of languages, to the low scores of rightly told
kept-back documents.

Scale: one pass gathers document frequencies (a vector of DIM counts per task, summed by Spark) and the
sample's count vectors (at most DIM entries each); the driver holds DIM numbers, a row and DIM weights for each
language, of which some hundreds are meant, and the sample. Repeated rows are one document of the sample, and null
ids are told apart by their texts. Prediction is one more pass without a shuffle.

Defined results: a text that is null or has no letter gives `und` with score 0; without any labelled
training document every text gives `und`; repeated rows get equal results; ties go to the language that is
first in code point order; with one language every text with a letter has score 1, so none goes for its score;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import apart, materialize, table

DIM_BITS = 14
DIM = 1 << DIM_BITS
#: Bounds of the training sample, for each language and in all; one document of each language at least.
PER_LANGUAGE, SAMPLE = 1000, 8000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.05
UNKNOWN = "und"
#: Share of the rightly told kept-back documents whose scores are passed over as low ones when the least score is set.
LOW = 0.01


def gram_counts(text: str) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-grams, one for each of DIM buckets."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
    one = c * np.uint64(0x9E3779B97F4A7C15)
    mixed = [one]
    if len(c) > 1:
        mixed.append((one[:-1] ^ (c[1:] * np.uint64(0xC2B2AE3D27D4EB4F) << np.uint64(1))) * np.uint64(0x165667B19E3779F9))
    if len(c) > 2:
        mixed.append((mixed[1][:-1] ^ (c[2:] * np.uint64(0x27D4EB2F165667C5))) * np.uint64(0x85EBCA77C2B2AE63))
    out = np.zeros(DIM, dtype=np.int64)
    for m in mixed:
        out += np.bincount((m >> np.uint64(64 - DIM_BITS)).astype(np.int64), minlength=DIM)
    return out


def weighted(idx: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(tf)) * idf[idx]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float
    least: float

    def probabilities(self, text: str) -> np.ndarray:
        counts = gram_counts(text)
        idx = np.flatnonzero(counts)
        return _softmax(weighted(idx, counts[idx], self.idf) @ self.weights[idx] / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (DIM, classes) of softmax regression by FTRL-proximal, one row at a time in the order given."""
    z, n = np.zeros((DIM, n_classes)), np.zeros((DIM, n_classes))

    def active(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) > L1, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for idx, x, label in rows:
            zi, ni = z[idx], n[idx]
            w = active(zi, ni)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            n[idx] = ni + g * g
            z[idx] = zi + g - (np.sqrt(n[idx]) - np.sqrt(ni)) / ALPHA * w
    return active(z, n)


def calibrate(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, from a fixed grid."""
    grid = np.exp(np.linspace(np.log(0.1), np.log(5), 120))
    loss = [-np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def least_score(scores: np.ndarray, n_languages: int) -> float:
    """What a text must reach to be kept, from the scores of rightly told kept-back documents; chance if there are none."""
    chance = 1 / n_languages
    return (chance + float(np.quantile(scores, LOW))) / 2 if len(scores) else chance


def bounded(rows: DataFrame, per_language: int) -> DataFrame:
    """Of (h, lang, ...) the rows with the least h, so many of each lang at most; a task drops the others before the shuffle."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    return rows.withColumn("_place", place).where(F.col("_place") <= per_language).drop("_place")


def fit(train: DataFrame, per_language: int = PER_LANGUAGE) -> LanguageModel | None:
    """Learns from (doc_id, text, lang); None if nothing is labelled."""
    train = train.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.xxhash64("doc_id", "text")
    sizes = {r["lang"]: max(1, r["n"]) for r in train.groupBy("lang").agg(F.approx_count_distinct(h).alias("n")).collect()}
    if not sizes:
        return None
    languages = sorted(sizes)
    per_language = max(1, min(per_language, SAMPLE // len(languages)))
    # hash below this: looked at more closely; all if a language has few different documents
    shares = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, 1.3 * per_language / sizes[k])))])
    rows = train.select(h.alias("h"), "text", "lang", (F.pmod(h, F.lit(1 << 40)) < F.element_at(shares, F.col("lang")) * float(1 << 40)).alias("drawn"))

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df = np.zeros(DIM, dtype=np.int64)
        seen, known = 0, set()
        for batch in batches:
            sample = []
            for h, text, lang, take in zip(batch["h"], batch["text"], batch["lang"], batch["drawn"], strict=True):
                counts = gram_counts(text)
                idx = np.flatnonzero(counts)
                df[idx] += 1
                seen += 1
                if take and (h, lang) not in known:
                    known.add((h, lang))
                    sample.append((h, lang, idx, counts[idx]))
            yield pd.DataFrame(sample, columns=["h", "lang", "idx", "tf"])
        if seen:
            yield pd.DataFrame([(seen, None, np.flatnonzero(df), df[df > 0])], columns=["h", "lang", "idx", "tf"])

    gathered = materialize(rows.mapInPandas(gather, "h bigint, lang string, idx array<int>, tf array<bigint>"))
    sums = gathered.where("lang IS NULL")
    seen = sums.agg(F.sum("h")).first()[0] or 0
    df = np.zeros(DIM)
    pairs = sums.select(F.explode(F.arrays_zip("idx", "tf")).alias("p")).groupBy("p.idx").agg(F.sum("p.tf").alias("n"))
    for r in pairs.collect():  # at most DIM rows
        df[r["idx"]] = r["n"]
    idf = np.log((1 + seen) / (1 + df)) + 1
    sample = bounded(gathered.where("lang IS NOT NULL").dropDuplicates(["lang", "h"]), per_language).orderBy("h", "lang").select("lang", "idx", "tf")
    data = []
    for batch in sample.toArrow().to_batches():  # arrays all the way: as Python numbers the sample takes ten times as much
        for lang, idx, tf in zip(batch["lang"].to_pylist(), batch["idx"], batch["tf"], strict=True):
            at = idx.values.to_numpy()
            if len(at):
                data.append((at, weighted(at, tf.values.to_numpy().astype(float), idf), languages.index(lang)))
    learn = [d for i, d in enumerate(data) if i % 5] or data
    held = [d for i, d in enumerate(data) if i % 5 == 0]
    w = fit_ftrl(learn, len(languages))
    logits = np.array([x @ w[idx] for idx, x, _ in held]).reshape(-1, len(languages))
    labels = np.array([y for *_, y in held], dtype=int)
    temperature = calibrate(logits, labels) if held else 1.0
    p = _softmax(logits / temperature) if held else logits
    right = p[p.argmax(axis=1) == labels].max(axis=1)
    return LanguageModel(languages, idf, w, temperature, least_score(right, len(languages)))


def predict(text: Column, model: LanguageModel | None) -> Column:
    """struct(lang_pred, score) of a text column."""
    if model is None:
        return F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    @F.pandas_udf("lang_pred string, score double")
    def told(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch:
                if text is None:
                    out.append((UNKNOWN, 0.0))
                else:
                    p = model.probabilities(text)
                    out.append((model.languages[int(p.argmax())], float(p.max())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return told(F.when(text.rlike(r"\p{L}"), text))


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """docs with lang_pred and score; train is what to learn from."""
    # the model is bounded by DIM and the number of languages, and goes along with the tasks' code
    return docs.withColumn("_told", predict(F.col("text"), fit(train))).withColumns({"lang_pred": F.col("_told.lang_pred"), "score": F.col("_told.score")}).drop("_told")


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 3 == 1


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out())
    return identify(docs, docs.where(~F.col("held_out"))).select("doc_id", "held_out", "lang_pred", "score")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told with some certainty."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    slim, whole = apart(docs, "text")
    told = slim.withColumn("_told", predict(F.col("text"), model))
    return whole(told.where((F.col("_told.lang_pred") != UNKNOWN) & (F.col("_told.score") >= (model.least if model else 0.0))))
