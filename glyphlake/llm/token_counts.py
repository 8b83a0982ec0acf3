"""Operator 1, token counts of whole texts, huge ones by overlap resynchronisation.

A text longer than a chunk is encoded in overlapping chunks with offsets. Between two chunks the count is
spliced at a boundary that both encodings have and that is proven stable: no piece of the vocabulary holds the
two characters that meet there side by side, so no merge can ever cross it and the pieces on either side do
not depend on each other. Where an overlap has no such boundary, what lies before the last stable boundary is
counted and let go, and the overlap is doubled, on both sides, until it has one or the text ends; so a call of
the tokenizer sees more than two chunks only where the text has a run without a boundary, and then no more
than a few times that run.

Shorter texts: a space after another character, and a line feed, are such boundaries in a vocabulary without a
piece across them, so equal words of a batch are encoded once and a text's count is the sum over its words.
Texts with other runs of spaces are encoded whole.

Scale: no shuffle; a task streams Arrow batches, a few megabytes at a time, and each executor process loads the
vocabulary once.

Defined results: null counts as empty, empty has 0 tokens; repeated rows are counted alike; other columns
are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

MODEL = "piece_bpe_32k.model"
CHUNK, OVERLAP = 16_384, 256
LIMIT = 4096
#: Bytes of text that are worked on at a time.
SLICE = 8 << 20
#: Words that go to the library as one text.
JOINED = 512
#: A space that isn't a single one between two words, or the space's own mark in the text.
ODD = r"^[ \n]|  | $| \n|▁"


class SplicingCounter:
    """Counts tokens of texts of any length with one sentencepiece model."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        self.chunk, self.overlap = chunk, overlap
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.joined = {pair for p in pieces for pair in zip(p, p[1:], strict=False)}
        probe = "A  b\nﬁ c"
        crossed = any((b == "▁" and a != "▁") or "\n" in (a, b) for a, b in self.joined)
        self.by_word = not crossed and self.model.decode(self.model.encode(probe)) == probe and len(self.model.encode("\n")) == 2
        #: Bytes of text that each piece stands for.
        self.sizes = np.array([1 if self.model.is_byte(i) else len(p.replace("▁", " ").encode()) for i, p in enumerate(pieces)])
        self.opens = np.array([p.startswith("▁") for p in pieces])

    def stable(self, text: str, at: int) -> bool:
        """No piece can reach over the boundary before text[at]."""
        pair = (text[at - 1].replace(" ", "▁"), text[at].replace(" ", "▁"))
        return pair not in self.joined

    def starts(self, text: str, begin: int, end: int) -> np.ndarray:
        """Where in the text each token of the chunk begins; the library gives offsets in bytes."""
        chunk = text[begin:end]
        found = self.model.encode(chunk, return_type="proto").pieces
        return begin + _places(chunk)[np.fromiter((p.begin for p in found), dtype=np.int64, count=len(found))]

    def long_count(self, text: str, known: dict[int, np.ndarray]) -> int:
        """Tokens of a long text; known holds encodings of the chunks that begin at multiples of the chunk."""
        total, cut, begin, end = 0, 0, 0, min(len(text), self.chunk + self.overlap)
        left = known[0]
        while end < len(text):
            following, width = end - self.overlap, self.overlap
            stop = min(len(text), following + self.chunk + self.overlap)
            right = known[following] if following in known else self.starts(text, following, stop)
            while (splice := self._splice(text, left, right, max(cut, following), end)) is None and end < len(text):
                # alignment failed: what is settled is let go, and both sides get a wider overlap
                settled = next((int(p) for p in left[::-1] if cut < p <= following and self.stable(text, p)), None)
                if settled is not None:
                    total += int(np.count_nonzero((left >= cut) & (left < settled)))
                    cut, begin = settled, settled - 1  # a chunk's first piece has a space of its own before it
                width *= 2
                end = min(len(text), following + width)
                left = self.starts(text, begin, end)
                if end < len(text) and end + self.overlap > stop:
                    stop = min(len(text), end + self.chunk)
                    right = self.starts(text, following, stop)
            if splice is None:
                break
            total += int(np.count_nonzero((left >= cut) & (left < splice)))
            cut, begin, end, left = splice, following, stop, right
        return total + int(np.count_nonzero(left >= cut))

    def _splice(self, text: str, left: np.ndarray, right: np.ndarray, after: int, before: int) -> int | None:
        """The first stable boundary that both encodings have within the overlap."""
        within = lambda x: x[np.searchsorted(x, after, side="right") : np.searchsorted(x, before)]
        return next((int(p) for p in np.intersect1d(within(left), within(right)) if self.stable(text, p)), None)

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; nulls are empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        long = pc.greater(pc.utf8_length(texts), self.chunk)
        long_texts = texts.filter(long).to_pylist()
        chunks = [(i, b) for i, t in enumerate(long_texts) for b in range(0, len(t), self.chunk)]
        cut = pa.array([long_texts[i][b : b + self.chunk + self.overlap] for i, b in chunks], pa.large_string())
        parts = pa.concat_arrays([pc.if_else(long, "", texts), cut])
        odd = pc.or_(pc.match_substring_regex(parts, ODD), not self.by_word).to_numpy(zero_copy_only=False)
        ids, at, n, words, offsets = self._coded(pc.if_else(pa.array(odd), "", parts))
        out = np.diff(np.concatenate([[0], n[words].cumsum()])[offsets[: len(texts) + 1]])
        whole = np.flatnonzero(odd[: len(texts)])
        out[whole] = [len(x) for x in self.model.encode(texts.take(pa.array(whole)).to_pylist(), num_threads=1)]
        known: list[dict[int, np.ndarray]] = [{} for _ in long_texts]
        for k, (i, b) in enumerate(chunks, len(texts)):
            own = words[offsets[k] : offsets[k + 1]]
            if odd[k]:
                known[i][b] = self.starts(long_texts[i], b, b + self.chunk + self.overlap)
            else:
                each = n[own]
                sizes = self.sizes[ids[np.repeat(at[own] - np.cumsum(each) + each, each) + np.arange(each.sum())]]
                begin = np.maximum(np.cumsum(sizes) - sizes - 1, 0)  # the space before the first word is not in the chunk
                known[i][b] = b + _places(cut[k - len(texts)].as_py())[begin]
        out[long.to_numpy(zero_copy_only=False)] = [self.long_count(t, x) for t, x in zip(long_texts, known, strict=True)]
        return out

    def _coded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of the distinct words of texts that aren't odd, where each word's begin, how many they are, the
        texts' words by number, and where each text's begin.

        A word holds the space before it; after a line feed it holds that instead. In joined words just the first
        piece of each word begins with a space.
        """
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        coded = lists.flatten().dictionary_encode()
        words, some = coded.dictionary, pc.not_equal(coded.dictionary, "")
        sent = words.filter(some)
        bounds = pa.array([*range(0, len(sent), JOINED), len(sent)], pa.int64())
        joined = pc.binary_join(pa.LargeListArray.from_arrays(bounds, sent), pa.scalar(" ", pa.large_string())).to_pylist()
        ids = np.concatenate([np.empty(0, np.int64), *[np.array(x, dtype=np.int64) for x in self.model.encode(joined, num_threads=1)]])
        starts = np.flatnonzero(self.opens[ids])
        at, n = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        filled = some.to_numpy(zero_copy_only=False)
        at[filled], n[filled] = starts, np.diff(np.append(starts, len(ids)))
        after_line = pc.starts_with(words, "\n").to_numpy(zero_copy_only=False)
        return ids, at + after_line, n - after_line, coded.indices.to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()


def _places(text: str) -> np.ndarray:
    """Of each byte, the place of its character; one more at the end."""
    return np.cumsum((np.frombuffer(text.encode() + b".", dtype=np.uint8) & 0xC0) != 0x80) - 1


@lru_cache(maxsize=2)
def _counter(path: str, chunk: int, overlap: int) -> SplicingCounter:
    return SplicingCounter(path, chunk, overlap)


def token_count(text: Column, model: str = MODEL, chunk: int = CHUNK, overlap: int = OVERLAP) -> Column:
    """Number of tokens of a text column; model is the name of a public tokenizer's file."""

    @F.arrow_udf("bigint")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = _counter(public_tokenizers.path(model), chunk, overlap)
        for batch in batches:
            yield pa.array(np.concatenate([np.empty(0, np.int64), *map(counter.count, slices(batch, SLICE))]), pa.int64())

    return counted(F.coalesce(text, F.lit("")))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit."""
    docs = table(spark, sf_dir, "documents")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes")
    counted = docs.select("doc_id", n_bytes, token_count(F.col("text")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
