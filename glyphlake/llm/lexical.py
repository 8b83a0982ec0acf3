"""Operator 11, ranked lexical search by dual-sorted wavelet trees per shard, exact.

Each text becomes its terms with their counts (of the terms asked), written once; document frequencies and lengths of the
whole corpus follow from that, and from them each posting's impact. A shard is a run of some thousand documents, numbered
by ascending doc_id. All its posting lists, each ordered by falling impact, are laid end to end, and a wavelet tree is
built over their document numbers. In it a range of numbers is a node, a list's postings there are an interval that keeps
its order, and so the interval's first posting has the largest impact of that term below the node: weights times these,
summed, bound every score below. The search opens the nodes with the highest bounds first, some at a time, halves the
intervals of all terms together, and stops where no bound reaches the k-th score found. At a single document the bound is
its score. A task carries the k best of an item from shard to shard, so later shards are pruned by earlier ones.

Scale: no text is shuffled; a task holds one shard, and gives at most k rows an item. Terms asked go to the tasks by
blocks of at most about ITEM_BLOCK items, each block a pass, so what the driver sends is bounded; what it gathers is a
count for each term of a block. A lost executor repeats its own files.

Defined results: null, empty and term-less texts and items take no part; each row of the items is an item of its own, also
where ids are null or repeated; each row of the documents is a document; equal scores go by ascending doc_id, null last;
empty tables give an empty result. Only ids and texts are read, so other columns, whatever their names, change nothing.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, slices, table

K = 10
#: A term is a run of these bytes after A-Z are lower-cased: ASCII digits and letters, and every byte above ASCII.
TERM = rb"[0-9a-z\x80-\xff]+"
SPACED = bytes(b if re.fullmatch(TERM, bytes([b])) else 32 for b in bytes(range(256)).lower())
SHARD_DOCS, SHARD_POSTINGS, ITEM_BLOCK = 8192, 2_000_000, 2048
#: Nodes opened at once, and bytes of text held at once.
OPENED, SLICE = 64, 4_000_000
SCHEMA = "item_id bigint, rank int, doc_id bigint, score bigint"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(SPACED).split()


def forward_index(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, counts) of the texts that have terms: n counts all, terms are the numbers of those asked."""
    width = max(1, len(numbers))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for part in slices(batch.column(1), SLICE):
                lengths, keys = [], []
                for k, text in enumerate(part.cast(pa.large_binary()).to_pylist()):
                    words = terms_of(text or b"")
                    lengths.append(len(words))
                    keys.append(np.array([numbers[w] for w in words if w in numbers], dtype=np.int64) + k * width)
                pairs, counts = np.unique(np.concatenate(keys), return_counts=True)
                ends = np.searchsorted(pairs, np.arange(len(part) + 1) * width)
                as_list = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))  # noqa: B023, E731
                found = pa.RecordBatch.from_arrays([ids.slice(at, len(part)), pa.array(lengths, pa.int64()), as_list(pairs % width), as_list(counts)], names=["doc_id", "n", "terms", "counts"])
                yield found.filter(pa.array(np.array(lengths) > 0))
                at += len(part)

    return docs.mapInArrow(counted, "doc_id bigint, n bigint, terms array<int>, counts array<int>")


class WaveletShard:
    """Posting lists of one shard over document numbers 0 to docs - 1, each ordered by falling impact, in one tree.

    Level h holds all postings ordered by the top h bits of their document's number and, within equal ones, as laid out.
    """

    def __init__(self, docs: int, terms: np.ndarray, owners: np.ndarray, impacts: np.ndarray) -> None:
        order = np.lexsort((owners, -impacts, terms))
        terms, owners, impacts = terms[order], owners[order], impacts[order]
        self.terms, self.starts = np.unique(terms, return_index=True)
        self.ends = np.append(self.starts[1:], len(terms))
        self.height = max(0, int(docs - 1).bit_length())
        #: postings of the documents before each number
        self.before = np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=1 << self.height))])
        self.impacts, self.zeros = [impacts], []
        for h in range(self.height):
            # within a node the next bit parts its postings stably: zeros to the left child, ones to the right
            bit = (owners >> (self.height - 1 - h)) & 1
            self.zeros.append(np.concatenate([[0], np.cumsum(bit == 0, dtype=np.int64)]).astype(np.int32))
            step = np.argsort(owners >> (self.height - 1 - h), kind="stable")
            owners, impacts = owners[step], impacts[step]
            self.impacts.append(impacts)

    def children(self, h: int, node: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """The intervals of both children, from intervals of one level's nodes."""
        span = self.height - h
        zeros, start, end = self.zeros[h], self.before[node << span], self.before[(node + 1) << span]
        base, of_left, of_right = zeros[start], zeros[left] - zeros[start], zeros[right] - zeros[start]
        middle = start + zeros[end] - base
        return (start + of_left, start + of_right), (middle + left - start - of_left, middle + right - start - of_right)

    def best(self, asked: np.ndarray, weights: np.ndarray, k: int, floor: int = 1, opened: int = OPENED) -> list[tuple[int, int]]:
        """The k best (score, document) of at least floor, equal scores by ascending number. weights: of the terms asked, repeats counted."""
        place = np.searchsorted(self.terms, asked)
        there = (place < len(self.terms)) & (self.terms[np.minimum(place, len(self.terms) - 1)] == asked) if len(self.terms) else np.zeros(len(asked), bool)
        place, w = place[there], weights[there]
        if not len(place):
            return []
        left, right = self.starts[place], self.ends[place]
        bound = int((w * self.impacts[0][left]).sum())
        # waiting nodes by level: number, bound, and how many of the level's intervals (term's place in w, left, right) are theirs
        waiting = {0: (np.array([0]), np.array([bound]), np.array([len(w)]), np.arange(len(w)), left, right)}
        found: list[tuple[int, int]] = []
        while waiting:
            least = max(floor, found[-1][0]) if len(found) == k else floor
            h = max(waiting, key=lambda x: (waiting[x][1].max(), x))
            nodes, bounds, sizes, term, left, right = waiting.pop(h)
            if bounds.max() < least:
                break
            live = bounds >= least
            take = live & (bounds >= np.partition(bounds, len(bounds) - opened)[len(bounds) - opened]) if len(bounds) > opened else live
            own, rest = np.repeat(take, sizes), np.repeat(live & ~take, sizes)
            if rest.any():
                keep = live & ~take
                waiting[h] = nodes[keep], bounds[keep], sizes[keep], term[rest], left[rest], right[rest]
            nodes, bounds, sizes, term, left, right = nodes[take], bounds[take], sizes[take], term[own], left[own], right[own]
            if h == self.height:
                found = sorted([*found, *((int(b), int(d)) for b, d in zip(bounds, nodes, strict=True))], key=lambda x: (-x[0], x[1]))[:k]
                continue
            of = np.repeat(np.arange(len(nodes)), sizes)
            (l0, r0), (l1, r1) = self.children(h, nodes[of], left, right)
            term, left, right = np.concatenate([term, term]), np.concatenate([l0, l1]), np.concatenate([r0, r1])
            of = np.concatenate([2 * of, 2 * of + 1])
            full = left < right
            of, term, left, right = of[full], term[full], left[full], right[full]
            order = np.argsort(of, kind="stable")
            of, term, left, right = of[order], term[order], left[order], right[order]
            sums = np.bincount(of, minlength=2 * len(nodes))
            value = np.zeros(2 * len(nodes), dtype=np.int64)
            np.add.at(value, of, w[term] * self.impacts[h + 1][left])
            some = (sums > 0) & (value >= least)
            own = some[of]
            child = (2 * np.repeat(nodes, 2) + np.tile([0, 1], len(nodes)))[some]
            new = child, value[some], sums[some], term[own], left[own], right[own]
            if h + 1 in waiting:
                new = tuple(np.concatenate(x) for x in zip(waiting[h + 1], new, strict=True))
            if len(new[0]):
                waiting[h + 1] = new
        return found


def _shards(batches: Iterator[pa.RecordBatch], docs: int, postings: int) -> Iterator[pa.Table]:
    """Runs of rows of at most so many documents, and of about so many postings."""
    held, n, size = [], 0, 0
    for batch in batches:
        sizes = np.cumsum(np.diff(batch.column(2).offsets.to_numpy()))
        at = 0
        while at < len(batch):
            done = int(sizes[at - 1]) if at else 0
            to = min(len(batch), at + docs - n, max(at + (not n), int(np.searchsorted(sizes, done + postings - size, side="right"))))
            if to > at:
                held.append(batch.slice(at, to - at))
                n, size = n + to - at, size + int(sizes[to - 1]) - done
            if to < len(batch) or n >= docs or size >= postings:
                yield pa.Table.from_batches(held)
                held, n, size = [], 0, 0
            at = to
    if held:
        yield pa.Table.from_batches(held)


def search(index: DataFrame, items: list[tuple[int, int | None, dict[int, int]]], weights: np.ndarray, documents: int, length: int, k: int = K, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """(item, item_id, doc_id, score): each task's k best of every item (number, id, times it has each term)."""
    asked = [(number, item_id, t := np.array(sorted(times), dtype=np.int64), np.array([times[x] for x in t.tolist()], dtype=np.int64) * weights[t]) for number, item_id, times in items]

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none_last = lambda x: (-x[0], x[1] is None, x[1] or 0)
        best: dict[int, list[tuple[int, int | None]]] = {}
        for part in _shards(batches, shard_docs, SHARD_POSTINGS):
            part = part.sort_by("doc_id").combine_chunks().to_batches()[0]  # nulls last
            sizes = np.diff(part.column(2).offsets.to_numpy())
            terms, tf = (part.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            owners = np.repeat(np.arange(len(part)), sizes)
            m = 25 + 75 * part.column(1).to_numpy() * documents // length
            shard = WaveletShard(len(part), terms, owners, 1_000_000_000 * tf // (1000 * tf + 8 * m[owners]))
            ids = part.column(0)
            for number, _, own, w in asked:
                known = best.get(number, [])
                floor = known[-1][0] if len(known) == k else 1
                if new := shard.best(own, w, k, floor):
                    best[number] = sorted([*known, *((s, ids[d].as_py()) for s, d in new)], key=none_last)[:k]
        id_of = {number: item_id for number, item_id, *_ in asked}
        rows = [(number, id_of[number], d, s) for number, found in best.items() for s, d in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["item", "item_id", "doc_id", "score"])

    return index.mapInArrow(searched, "item bigint, item_id bigint, doc_id bigint, score bigint")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, item_block: int = ITEM_BLOCK, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """SCHEMA's columns: the k best documents of each row of items (item_id, text), scores above 0."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text IS NOT NULL")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    results = []
    blocks = -(-items.count() // item_block)
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        words = [terms_of(r["text"].encode()) for r in rows]
        numbers = {w: i for i, w in enumerate(sorted({w for ws in words for w in ws}))}
        index = materialize(forward_index(docs, numbers))
        documents, length = index.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(numbers), dtype=np.int64)
        for term, n in index.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # at most the block's terms
            df[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(n) + 1))) for n in df], dtype=np.int64)
        asked = []
        for i, (row, ws) in enumerate(zip(rows, words, strict=True)):
            times: dict[int, int] = {}
            for w in ws:
                times[numbers[w]] = times.get(numbers[w], 0) + 1
            asked.append((i, row["item_id"], times))
        found = search(index, asked, weights, documents, max(1, length), k, shard_docs)
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        results.append(found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))
    return functools.reduce(DataFrame.unionByName, results) if results else spark.createDataFrame([], SCHEMA)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents of each benchmark item: item_id, rank, doc_id, score."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents WHERE text IS NOT NULL
), i AS (
  SELECT row_number() OVER () AS q, item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL
), c AS (
  SELECT count(*)::BIGINT AS docs, sum(len(ws))::BIGINT AS length FROM d WHERE len(ws) > 0
), p AS (
  SELECT r, w, count(*)::BIGINT AS tf FROM (SELECT r, unnest(ws) AS w FROM d) GROUP BY r, w
), t AS (
  SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY w, docs
), a AS (
  SELECT q, w, count(*)::BIGINT AS times FROM (SELECT q, unnest(ws) AS w FROM i) GROUP BY q, w
), s AS (
  SELECT a.q, p.r, sum(a.times * t.weight * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (100 - 75 + (75 * len(d.ws)::BIGINT * c.docs) // c.length))))::BIGINT AS score
  FROM a JOIN p USING (w) JOIN t USING (w) JOIN d USING (r), c GROUP BY a.q, p.r
), o AS (
  SELECT i.item_id, (row_number() OVER (PARTITION BY s.q ORDER BY s.score DESC, d.doc_id NULLS LAST))::INTEGER AS rank, d.doc_id, s.score
  FROM s JOIN d USING (r) JOIN i USING (q) WHERE s.score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {K}
"""
