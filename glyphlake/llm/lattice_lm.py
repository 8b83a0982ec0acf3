"""Operator 3, language-model scores from a subword lattice.

The pieces of an existing vocabulary are the units of a unigram model: their probabilities come from how the
training words are cut into them. A text's probability sums over all its segmentations, so a forward
recursion in log space runs over each word's lattice; pieces never cross words, hence a text's score is the
sum over its words and the end. Characters that no piece holds are spelt in byte pieces. The base score is
an add-half unigram model over whole words of the same training documents.

No vocabulary at hand has unigram scores (those of a BPE model are merge ranks), hence the estimate.

Scale: texts are read once and never shuffled. A task cuts its rows into chunks of about CHUNK_BYTES and writes
each document as numbers of the chunk's distinct words, and those words, with their training counts, by the part
of the hash space they fall in. Parts add up the counts, block of chunks by block; a part computes each lattice
once and answers every chunk in the order asked, and a chunk's documents are summed from its answers. A frequent
word costs one entry per chunk however often it occurs, and chunks are of rows, not of ids. A part with more
than ENTRIES of them (its words are in most chunks of a very large table) is dealt in shares of the chunks, each of
which gets the part's words. The driver holds one number per piece.

Defined results: null is empty and has only the end; the rest of a text is lower-cased A-Z only; without
training documents the base score is 0 (of one kind of token) and pieces are equally likely; repeated rows
are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, mixed, slices, table

MODEL = "piece_bpe_32k.model"
CHUNK_BYTES, SLICE = 8 << 20, 2 << 20
LEAST_PARTS = 64
#: Added to each piece's count.
SMOOTHING = 0.5
LONGEST_VECTORISED = 64
#: Positions of a longer word whose pieces are looked up at a time.
POSITIONS = 65_536
#: Entries of a part, one for each of its words in each chunk, that are answered at a time; chunks whose counts are added up at a time.
ENTRIES, CHUNKS = 1 << 21, 4096
_P = np.uint64(0x9E3779B97F4A7C15)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a text column, lower-cased A-Z, and where each text's words begin (one more at the end)."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    lists = pc.ascii_split_whitespace(trimmed)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    flat = lists.flatten()
    some = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)  # a text without words gives one empty string
    return flat.filter(pa.array(some)), np.concatenate([[0], np.cumsum(some)])[offsets]


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings, from their bytes."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[words.offset : words.offset + len(words) + 1]
    if not len(words):
        return np.empty(0, np.uint64)
    data = np.frombuffer(words.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    out = np.zeros(len(words), dtype=np.uint64)
    lengths = np.diff(offsets)
    for i in range(int(min(lengths.max(initial=0), 64))):
        on = lengths > i
        out[on] = out[on] * _P + data[offsets[:-1][on] + i] + np.uint64(1)
    for j in np.flatnonzero(lengths > 64):
        for block in range(64, int(lengths[j]), 4096):
            part = data[offsets[j] + block : min(offsets[j] + block + 4096, offsets[j + 1])].astype(np.uint64)
            out[j] = mixed(np.array([out[j]]) + (mixed(part + np.arange(len(part), dtype=np.uint64) * _P)).sum(dtype=np.uint64))[0]
    return mixed(out + lengths.astype(np.uint64))


class PieceLattice:
    """Marginal log10 probabilities of words under piece log probabilities (natural, by id)."""

    def __init__(self, pieces: list[str], is_byte: list[bool], log_p: np.ndarray) -> None:
        self.bytes = {int(p[3:5], 16): log_p[i] for i, (p, b) in enumerate(zip(pieces, is_byte, strict=True)) if b}
        self.log_p = {p: float(log_p[i]) for i, (p, b) in enumerate(zip(pieces, is_byte, strict=True)) if p and not b}
        self.longest = max(map(len, self.log_p))
        # all beginnings of pieces by hash; -inf for one that is no piece itself
        lengths = np.array([len(p) for p in self.log_p])
        codes = np.frombuffer("".join(p.ljust(self.longest, "\0") for p in self.log_p).encode("utf-32-le"), dtype="<u4").reshape(-1, self.longest)
        own, h, keys, scores = np.array(list(self.log_p.values())), np.zeros(len(codes), np.uint64), [], []
        for i in range(self.longest):
            h = mixed(h * _P + codes[:, i] + np.uint64(1))
            keys.append(h[lengths > i])
            scores.append(np.where(lengths == i + 1, own, -np.inf)[lengths > i])
        self.keys, place = np.unique(np.concatenate(keys), return_inverse=True)
        self.scores = np.full(len(self.keys), -np.inf)
        np.maximum.at(self.scores, place, np.concatenate(scores))
        # a sparse table finds nearly all; the few keys that share a slot with another are searched for
        self.shift = np.uint64(64 - int(len(self.keys) * 16 - 1).bit_length())
        slot = (self.keys >> self.shift).astype(np.int64)
        self.table = np.full(1 << (64 - int(self.shift)), -1, dtype=np.int32)
        self.table[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.more = np.flatnonzero(self.table[slot] != np.arange(len(slot)))

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Places of hashes among the beginnings of pieces, -1 for others."""
        place = self.table[(h >> self.shift).astype(np.int64)]
        miss = np.flatnonzero((place >= 0) & (self.keys[place] != h))
        if len(miss):
            place[miss] = -1
            if len(self.more):
                at = self.more[np.minimum(np.searchsorted(self.keys[self.more], h[miss]), len(self.more) - 1)]
                same = self.keys[at] == h[miss]
                place[miss[same]] = at[same]
        return place

    def _spelt(self, char: str) -> float:
        return float(sum(self.bytes[b] for b in char.encode("utf-8", "replace")))

    def _one(self, text: str) -> float:
        """The forward recursion for one word, of any length: pieces are looked up for a block of positions at a time,
        and only that block's sums are kept."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        n, alpha = len(codes), [0.0]
        for start in range(0, n, POSITIONS):
            stop = min(n, start + POSITIONS)
            on, h = np.arange(start, stop), np.zeros(stop - start, dtype=np.uint64)
            begins, lengths, scores = [], [], []
            for length in range(1, self.longest + 1):
                inside = on + length <= n
                on, h = on[inside], h[inside]
                if not len(on):
                    break
                h = mixed(h * _P + codes[on + length - 1] + np.uint64(1))
                place = self._find(h)
                edge = np.where(place >= 0, self.scores[place], -np.inf)
                if length == 1:
                    bare = np.isneginf(edge)
                    chars, which = np.unique(codes[on[bare]], return_inverse=True)
                    edge[bare] = np.array([self._spelt(chr(c)) for c in chars])[which] if len(chars) else 0.0
                hit = edge > -np.inf
                begins.append(on[hit] - start)
                lengths.append(np.full(int(hit.sum()), length))
                scores.append(edge[hit])
                on, h = on[place >= 0], h[place >= 0]
            first = np.concatenate(begins)
            order = np.argsort(first, kind="stable")
            alpha += [-math.inf] * (stop - start + self.longest + 1 - len(alpha))
            for i, j, e in zip(first[order].tolist(), (first + np.concatenate(lengths))[order].tolist(), np.concatenate(scores)[order].tolist(), strict=True):
                one, other = alpha[i] + e, alpha[j]
                if one < other:
                    one, other = other, one
                alpha[j] = one + math.log1p(math.exp(other - one))
            alpha = alpha[stop - start :]
        return alpha[0]

    def log10(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words))
        lengths = np.array([len(w) + 1 for w in words], dtype=np.int64)
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            if n > LONGEST_VECTORISED:
                for i in at:
                    out[i] = self._one("▁" + words[i])
                continue
            for some in np.array_split(at, -(-len(at) // 20_000)):
                out[some] = self._many(["▁" + words[i] for i in some], int(n))
        return out / np.log(10)

    def _many(self, texts: list[str], n: int) -> np.ndarray:
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").reshape(len(texts), n).T.astype(np.uint64)
        alpha = np.full((n + 1, len(texts)), -np.inf)
        alpha[0] = 0
        for i in range(n):
            on, h = np.arange(len(texts)), np.zeros(len(texts), dtype=np.uint64)
            for j in range(i, min(n, i + self.longest)):
                h = mixed(h * _P + codes[j, on] + np.uint64(1))
                place = self._find(h)
                edge = np.where(place >= 0, self.scores[place], -np.inf)
                if j == i:
                    for t in np.flatnonzero(np.isneginf(edge)):
                        edge[t] = self._spelt(texts[t][i])
                hit = edge > -np.inf
                to = on[hit]
                alpha[j + 1, to] = np.logaddexp(alpha[j + 1, to], alpha[i, to] + edge[hit])
                on, h = on[place >= 0], h[place >= 0]
                if not len(on):
                    break
        return alpha[n]


@lru_cache(maxsize=1)
def _model(name: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))


@lru_cache(maxsize=1)
def _lattice(name: str, counts: bytes) -> PieceLattice:
    m, n = _model(name), np.frombuffer(counts)
    ids = range(m.get_piece_size())
    log_p = np.log((n + SMOOTHING) / (n.sum() + SMOOTHING * len(n)))
    # only the end is a control piece with a probability; it is no edge of a word
    pieces = ["" if m.is_control(i) or m.is_unknown(i) else m.id_to_piece(i) for i in ids]
    return PieceLattice(pieces, [m.is_byte(i) for i in ids], log_p)


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1


def _by_part(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of distinct words by (part, hash), the parts that occur and where each begins in that order."""
    h = word_hashes(words)
    part = (h % np.uint64(parts)).astype(np.int64)
    order = np.lexsort((h, part))
    present, starts = np.unique(part[order], return_index=True)
    return order, present, np.append(starts, len(order))


def _lists(values: pa.Array, starts: np.ndarray) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    return pa.LargeListArray.from_arrays(pa.array(starts, pa.int64()), values).cast(pa.list_(values.type))


def coded(docs: DataFrame, parts: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, text, held_out) as two kinds of rows: (chunk, doc_id, held_out, codes) for each document, codes being
    numbers of words, and (chunk, part, words, c) for the chunk's words in each part of the hash space, c their count
    in training documents. The chunk's words are numbered by part, then as in words."""
    schema = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("words", pa.list_(pa.string())), ("c", pa.list_(pa.int64())), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("codes", pa.list_(pa.int32()))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        chunk, held = TaskContext.get().partitionId() << 32, 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pa.concat_tables(waiting).combine_chunks()
            waiting.clear()
            texts = rows["text"].combine_chunks() if isinstance(rows["text"], pa.ChunkedArray) else rows["text"]
            words, starts = words_of(texts)
            found = words.dictionary_encode()
            codes = found.indices.to_numpy()
            order, present, bounds = _by_part(found.dictionary, parts)
            number = np.empty(len(order), np.int32)
            number[order] = np.arange(len(order), dtype=np.int32)
            training = np.repeat(~rows["held_out"].to_numpy(), np.diff(starts))
            c = np.bincount(codes[training], minlength=len(order))[order]
            doc = {"chunk": pa.repeat(chunk, len(rows)), "doc_id": rows["doc_id"].combine_chunks(), "held_out": rows["held_out"].combine_chunks(), "codes": _lists(pa.array(number[codes]), starts)}
            yield filled(doc)
            asked = {"chunk": pa.repeat(chunk, len(present)), "part": pa.array(present), "words": _lists(found.dictionary.take(pa.array(order)).cast(pa.string()), bounds), "c": _lists(pa.array(c, pa.int64()), bounds)}
            yield filled(asked)

        def filled(columns: dict[str, pa.Array]) -> pa.RecordBatch:
            n = len(columns["chunk"])
            return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

        for batch in batches:
            at = 0
            for texts in slices(batch["text"], SLICE):
                waiting.append(pa.table({"doc_id": batch["doc_id"].slice(at, len(texts)), "held_out": batch["held_out"].slice(at, len(texts)), "text": texts}))
                at += len(texts)
                held += texts.nbytes
                if held >= chunk_bytes:
                    yield from flush()
                    chunk, held = chunk + 1, 0
        if waiting:
            yield from flush()

    return docs.select("doc_id", "text", "held_out").mapInArrow(cut, "chunk bigint, part bigint, words array<string>, c array<bigint>, doc_id bigint, held_out boolean, codes array<int>")


def word_counts(asked: DataFrame, blocks: int = 1) -> DataFrame:
    """One row per part of the hash space: part, words (of all documents), c (their count in training documents), entries
    (of the part in all chunks). With blocks of chunks, each block is added up before they meet, so that a part with words
    that most chunks hold is in no task at once."""

    def merged(group: pa.Table) -> pa.Table:
        flat = pa.table({"w": pc.list_flatten(group["words"]), "c": pc.list_flatten(group["c"])})
        t = flat.group_by("w").aggregate([("c", "sum")]).combine_chunks()
        words, c, ends = t["w"].combine_chunks(), t["c_sum"].combine_chunks(), np.array([0, len(t)])
        return pa.table({"part": group["part"][:1], "words": _lists(words.cast(pa.string()), ends), "c": _lists(c, ends), "entries": [pc.sum(group["entries"]).as_py()]})

    out = "part bigint, words array<string>, c array<bigint>, entries bigint"
    rows = asked.select("part", "words", "c", F.size("words").cast("bigint").alias("entries"), F.pmod(F.xxhash64("chunk"), F.lit(blocks)).alias("block"))
    if blocks > 1:
        rows = rows.groupBy("part", "block").applyInArrow(merged, out)
    return rows.drop("block").groupBy("part").applyInArrow(merged, out)


def piece_counts(counts: DataFrame, ends: int, model: str) -> bytes:
    """How often each piece (by id) is used in the training words, as doubles; the end piece once per document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        total = np.zeros(m.get_piece_size())
        for batch in batches:
            words, c = batch["words"].flatten(), batch["c"].flatten().to_numpy(zero_copy_only=False)
            for at in range(0, len(words), 50_000):
                n = c[at : at + 50_000]
                ids = m.encode(words[at : at + 50_000].filter(pa.array(n > 0)).to_pylist(), num_threads=1)
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int64)
                total += np.bincount(flat, weights=np.repeat(n[n > 0], [len(x) for x in ids]), minlength=len(total))
        yield pa.RecordBatch.from_pydict({"piece": np.flatnonzero(total), "n": total[total > 0]})

    out = np.zeros(_model(model).get_piece_size())
    for r in counts.mapInArrow(cut, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():  # one row per piece
        out[r["piece"]] = r["n"]
    out[_model(model).eos_id()] = ends
    return out.tobytes()


def score(docs: DataFrame, model: str = MODEL, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Scores of (doc_id, text, held_out): n_tokens, n_known, train_tokens, base_score and score."""
    size = docs.agg(F.sum(F.octet_length("text")), F.count_if(~F.col("held_out"))).first()
    parts, ends = max(LEAST_PARTS, (size[0] or 0) // (2 * chunk_bytes)), size[1]
    rows = materialize(coded(docs, parts, chunk_bytes))
    asked = rows.where("part IS NOT NULL").select("part", "chunk", "words", "c")
    counts = materialize(word_counts(asked, max(1, (size[0] or 0) // (CHUNKS * chunk_bytes))))
    known = F.aggregate(F.transform("c", lambda x: (x > 0).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    used = F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x)
    v, n = counts.agg(F.coalesce(F.sum(known), F.lit(0)), F.coalesce(F.sum(used), F.lit(0))).first()
    v, n = v + (ends > 0), n + ends
    pieces = piece_counts(counts, ends, model)
    end_p = np.frombuffer(pieces)[_model(model).eos_id()] + SMOOTHING
    end_score = float(np.log10(end_p / (np.frombuffer(pieces).sum() + SMOOTHING * (len(pieces) // 8))))
    base = lambda c: np.log10((c + 0.5) / (n + 0.5 * (v + 1)))

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("chunk", pa.int64()), ("part", pa.int64()), ("c", pa.list_(pa.int64())), ("s", pa.list_(pa.float64()))])
        if not len(left) or not len(right):
            return schema.empty_table()
        words, c = pc.list_flatten(left["words"]).combine_chunks(), pc.list_flatten(left["c"]).to_numpy()
        scores = _lattice(model, pieces).log10(words.to_pylist())
        at = pc.index_in(pc.list_flatten(right["words"]), value_set=words).to_numpy()
        starts = np.concatenate([[0], np.cumsum(pc.list_value_length(right["words"]).to_numpy())])
        return pa.table([right["chunk"], right["part"], _lists(pa.array(c[at]), starts), _lists(pa.array(scores[at]), starts)], schema=schema)

    def sums(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("part")
        c, s = pc.list_flatten(right["c"]).to_numpy(), pc.list_flatten(right["s"]).to_numpy()
        lengths, index = pc.list_value_length(left["codes"]).to_numpy(), pc.list_flatten(left["codes"]).to_numpy()
        if len(index) and index.max() >= len(c):
            raise RuntimeError("a chunk's answers are incomplete")
        doc = np.repeat(np.arange(len(left)), lengths)
        total = lambda x: np.bincount(doc, weights=x[index], minlength=len(left))
        return pa.table(
            {
                "doc_id": left["doc_id"],
                "held_out": left["held_out"],
                "n_tokens": lengths.astype(np.int64) + 1,
                "n_known": total((c > 0).astype(float)).astype(np.int64) + int(ends > 0),
                "train_tokens": np.full(len(left), n, np.int64),
                "base_score": total(base(c)) + base(ends),
                "score": total(s) + end_score,
            }
        )

    # A part with words that most chunks hold is answered in several shares of its chunks. Such parts are few: written, their
    # size is known, so that Spark need not shuffle what is asked to find them.
    shares = materialize(counts.select("part", F.ceil(F.col("entries") / ENTRIES).alias("shares")).where("shares > 1"))
    share = lambda n: F.pmod(F.xxhash64("chunk"), F.coalesce(n, F.lit(1)))
    dealt = asked.select("part", "chunk", "words").join(shares, "part", "left").withColumn("share", share(F.col("shares"))).drop("shares")
    known_words = counts.select("part", "words", "c", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("entries") / ENTRIES) - 1)).alias("share"))
    answers = known_words.groupBy("part", "share").cogroup(dealt.groupBy("part", "share")).applyInArrow(answer, "chunk bigint, part bigint, c array<bigint>, s array<double>")
    documents = rows.where("part IS NULL").select("chunk", "doc_id", "held_out", "codes")
    out = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return documents.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(sums, out)


def op3_lattice_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return score(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out().alias("held_out")))
