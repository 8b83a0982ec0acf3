"""Operator 9, near-duplicates by BagMinHash on five-word shingles, verified by multiset overlap.

Signatures: every shingle has a Poisson process in time over its weight axis; register j of a document is the
first point in time that falls on j below the weights of its shingles, so two documents agree on a register
with the probability of their weighted Jaccard similarity. Weights are counts, discretised to whole numbers:
the axis is cut into [0, 1), [1, 2), [2, 4), [4, 8)... and an interval of length above 1 splits in halves,
hierarchically, when its next point is due; intervals whose next point comes after every register's are
never split. The tree of a shingle doesn't depend on the document, which keeps signatures comparable.

Grouping: exact copies become one class first. BANDS bands of ROWS registers put classes into buckets. Each
bucket links its members to one of them, the one that shares most of its shingles with others, as the
original of a group of copies does (no pairs among all); the links are verified on the texts, and components
are found. For buckets that still hold several components, the members outside the bucket's largest
component meet the members of other components, each pair once, so no link between components is lost; they
are dealt over parts of at most about PART members, so the pairs of one bucket are made in many tasks.
Pairs that cannot be similar are left out as they are made: shingles that no other document has bound the
overlap, and a few bits of each register bound the similarity.

Scale: signatures take one pass; buckets, links and components are Spark joins and aggregations; only texts
of documents in a bucket with others are shuffled again. Each round is written to the shared folder.

Defined results: documents without a word (null, empty or blank) and null ids are groups of their own; a
text of fewer than five words is one shingle; rows with the same doc_id and text are one document, different
texts of one doc_id are documents of their own; class and group are named by their smallest doc_id; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import apart, materialize, mixed, table

SHINGLE = 5
SIMILARITY = 0.8
#: 32 bands of 5: a pair at 0.8 shares a bucket with probability 1 - 3e-6.
BANDS, ROWS = 32, 5
#: Bits of each register in a document's sketch.
PLANES = 4
#: Pairs whose sketches agree on fewer registers aren't verified. At 0.8 the mean is 130; this is 4.5 standard
#: deviations below, so a pair at 0.8 is as unlikely (3e-6) to be left out here as to share no bucket.
LEAST_AGREEMENT = 108
#: Members of a bucket whose pairs one task makes with the bucket, in the last step.
PART = 1000
SLICE = 2 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    ones = lambda p: np.concatenate([[np.uint64(1)], np.full(n, p, dtype=np.uint64)]).cumprod(dtype=np.uint64)
    return ones(_P), ones(inverse)


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """64-bit hashes of the k-word shingles of each text, repeats kept; text i is data[offsets[i]:offsets[i + 1]]."""
    if not len(data):
        return [np.empty(0, np.uint64)] * (len(offsets) - 1)
    word = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.concatenate([[False], word[:-1]]) & ~first[:-1]
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~(np.concatenate([word[1:], [False]]) & ~first[1:])) + 1
    up, down = _powers(max(SLICE, 1 << int(len(data)).bit_length()))
    sums = np.concatenate([[np.uint64(0)], ((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]).cumsum(dtype=np.uint64)])
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, offsets)
    out = []
    total = np.zeros(max(len(words) - k + 1, 0), dtype=np.uint64)
    for i in range(k):
        total = (total + words[i : len(words) - k + 1 + i]) * _P
    total = mixed(total)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= k:
            out.append(total[a : b - k + 1])
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for w in words[a:b]:
                short = (short + w) * _P
            out.append(mixed(short))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _exponential(seed: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    steps = np.atleast_1d(np.asarray(k, dtype=np.uint64)) * np.uint64(2)
    u = (mixed(seed + steps * _P) >> np.uint64(11)).astype(np.float64)
    return -np.log((u + 0.5) / 2.0**53)


def bag_minhash(elements: np.ndarray, counts: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """Signature of m registers (times, as float64) of a multiset of 64-bit elements."""
    regs = np.full(m, np.inf)
    seed, begin, end, top = [elements], [np.zeros(len(elements), np.int64)], [np.ones(len(elements), np.int64)], [counts]
    shell = 1
    while (more := counts > shell).any():  # the intervals [1, 2), [2, 4), ... as far as counts reach
        seed.append(mixed(elements[more] ^ mixed(np.array([shell], dtype=np.uint64))))
        begin.append(np.full(int(more.sum()), shell)), end.append(np.full(int(more.sum()), 2 * shell)), top.append(counts[more])
        shell *= 2
    s, a, b, w = (np.concatenate(x) for x in (seed, begin, end, top))
    x = _exponential(s, 1) / (b - a)
    k = np.ones(len(s), np.uint64)
    one = b - a == 1
    leaves = [(s[one], x[one], k[one])]
    s, x, a, b, w = s[~one], x[~one], a[~one], b[~one], w[~one]
    latest = np.inf
    while True:
        for ls, lx, lk in leaves:
            while len(ls):
                # as many points of each process at a time as fill the registers
                n = int(min(64, max(1, np.ceil(m * 4 / len(ls)))))
                steps = np.arange(n, dtype=np.uint64)
                ks = lk[:, None] + steps
                times = np.empty((len(ls), n + 1))
                times[:, 0] = lx
                times[:, 1:] = _exponential(ls[:, None], ks + np.uint64(1))
                times = times.cumsum(axis=1)
                place = (mixed(ls[:, None] + (np.uint64(2) * ks + np.uint64(1)) * _P) % np.uint64(m)).astype(np.int64)
                due = times[:, :n] < latest
                np.minimum.at(regs, place[due], times[:, :n][due])
                latest = regs.max()
                on = times[:, n] < latest
                ls, lx, lk = ls[on], times[on, n], lk[on] + np.uint64(n)
        on = (x < latest) & (a < w)
        s, x, a, b, w = s[on], x[on], a[on], b[on], w[on]
        if not len(s):
            return regs
        # the point due lies in one half; the other half's next point comes later, at its own rate
        half = (b - a) // 2
        right = mixed(s + np.uint64(0xA5A5A5A5)) & np.uint64(1) == 1
        ss = [mixed(s * np.uint64(2) + np.uint64(1)), mixed(s * np.uint64(2) + np.uint64(0x8000000000000001) + np.uint64(6))]
        later = [x + _exponential(t, 0) / half for t in ss]
        xs = [np.where(right, later[0], x), np.where(right, x, later[1])]
        s, x = np.concatenate(ss), np.concatenate(xs)
        a, b, w = np.concatenate([a, a + half]), np.concatenate([a + half, b]), np.concatenate([w, w])
        one = (b - a == 1) & (a < w)
        leaves = [(s[one], x[one], np.ones(int(one.sum()), np.uint64))]
        rest = b - a > 1
        s, x, a, b, w = s[rest], x[rest], a[rest], b[rest], w[rest]


def band_keys(regs: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = regs.view(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        key = mixed(key * _P + parts[:, i])
    return key.view(np.int64)


def sketch(regs: np.ndarray) -> np.ndarray:
    """PLANES bit planes over the registers, each as 64-bit words one after another."""
    low = mixed(regs.view(np.uint64))
    bits = np.zeros((PLANES, -(-len(regs) // 64) * 64), dtype=np.uint8)
    for i in range(PLANES):
        bits[i, : len(regs)] = (low >> np.uint64(i)) & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.int64).ravel()


def agreement(x: str, y: str, m: int = BANDS * ROWS) -> Column:
    """How many registers of two sketch columns have equal bits."""
    words = -(-m // 64)
    apart = F.lit(0)
    for w in range(words):
        differ = F.lit(0).cast("bigint")
        for i in range(PLANES):
            at = i * words + w
            differ = differ.bitwiseOR(F.get(F.col(x), F.lit(at)).bitwiseXOR(F.get(F.col(y), F.lit(at))))
        apart = apart + F.bit_count(differ)
    return F.lit(m) - apart


def _texts(column: pa.Array) -> Iterator[list[np.ndarray]]:
    """Shingles of each text of an Arrow column, some megabytes at a time."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, side="right")) - 1)
        part = data[offsets[at] : offsets[to]]
        yield shingle_hashes(part, (offsets[at : to + 1] - offsets[at]).astype(np.int64))
        at = to


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, content, size, bands, sketch) of (doc_id, text); bands is null for a text without a word.

    content tells exact copies, size counts shingles, sketch has PLANES bits of each register.
    """

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sketches, sizes = [], [], []
            for part in _texts(batch["text"]):
                for h in part:
                    regs = bag_minhash(*np.unique(h, return_counts=True)) if len(h) else None
                    sizes.append(len(h))
                    keys.append(None if regs is None else band_keys(regs))
                    sketches.append(None if regs is None else sketch(regs))
            arrays = [batch["doc_id"], batch["content"], pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "content", "size", "bands", "sketch"])

    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _content(F.col("text")).alias("content"), "text")
    return slim.mapInArrow(signed, "doc_id bigint, content binary, size bigint, bands array<bigint>, sketch array<bigint>")


def own_shingles(texts: DataFrame) -> DataFrame:
    """(id, own): how many shingles of each text (doc_id, text), repeats counted, no other of the texts has."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _texts(batch["text"]):
                found = [np.unique(h, return_counts=True) for h in part]
                ids = pc.take(batch["doc_id"], pa.array(np.repeat(np.arange(at, at + len(part)), [len(h) for h, _ in found])))
                h, c = (np.concatenate(x) for x in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([ids, pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["id", "h", "c"])
                at += len(part)

    rows = texts.select("doc_id", "text").mapInArrow(listed, "id bigint, h bigint, c bigint")
    by = rows.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.max("c").alias("c"))  # a text may stand here twice
    return by.where("id = last").groupBy("id").agg(F.sum("c").alias("own"))


def can_match(x: str, y: str, least: float) -> Column:
    """Whether two members may be similar: what either shares with any document bounds their overlap, and sketches must agree."""
    most = F.least(F.col(f"{x}.shared"), F.col(f"{y}.shared"))
    bound = most >= least * (F.col(f"{x}.size") + F.col(f"{y}.size") - most) - 1e-9
    return bound & (agreement(f"{x}.sketch", f"{y}.sketch") >= LEAST_AGREEMENT)


def verified(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Those of pairs (a, b) whose texts have a weighted Jaccard similarity of at least `least`, SIMILARITY or more."""

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = _texts(batch["left"]), _texts(batch["right"])
            flat = lambda parts: (h for part in parts for h in part)
            for x, y in zip(flat(left), flat(right), strict=True):
                both, place = np.unique(np.concatenate([x, y]), return_inverse=True)
                cx, cy = np.bincount(place[: len(x)], minlength=len(both)), np.bincount(place[len(x) :], minlength=len(both))
                keep.append(bool(np.minimum(cx, cy).sum() >= least * np.maximum(cx, cy).sum() - 1e-9))
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sides = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("left")), "a")
    sides = sides.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("right")), "b")
    return sides.select("a", "b", "left", "right").mapInArrow(overlap, "a bigint, b bigint")


def components(links: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, root) of every id in links (a, b): root is the smallest id of its component.

    Alternating stars: every node hands its larger neighbours, then its smaller ones, to the smallest it
    knows. Only edges move, by key, and the number of rounds is logarithmic.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    seen = None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def _split_buckets(members: DataFrame, roots: DataFrame) -> DataFrame:
    """members of buckets that hold several components, with their root, main, the bucket's largest component, and parts."""
    placed = members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    by = placed.groupBy("k", "root").count().groupBy("k")
    by = by.agg(F.max_by("root", F.struct("count", -F.col("root"))).alias("main"), F.count("*").alias("n"), F.ceil(F.sum("count") / PART).alias("parts"))
    by = by.where("n > 1").drop("n")
    return materialize(placed.join(by, "k"))


def _dealt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members outside their bucket's main component, each in one part of it, and all members, in every part."""
    outside = placed.where("root <> main").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    return outside, placed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))


def _content(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _numbered(classes: DataFrame) -> DataFrame:
    """classes (content, class_id) with a number of their own as id: class_id, or a hash where a smaller content has that one."""
    shared = classes.groupBy("class_id").agg(F.min("content").alias("_least"), F.count("*").alias("_n"))
    shared = materialize(shared.where("_n > 1").select("class_id", "_least"))
    own = F.col("_least").isNull() | (F.col("content") == F.col("_least"))
    numbered = classes.join(shared, "class_id", "left")
    return numbered.withColumn("id", F.when(own, F.col("class_id")).otherwise(F.xxhash64("class_id", "content"))).drop("_least")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, group_id): class_id names the exact copies, group_id the near ones, both by the smallest doc_id."""
    return grouped(docs, least).select("doc_id", "class_id", "group_id")


def grouped(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """near_duplicates with content and root, which tells groups apart whatever their names; null for texts without a word."""
    signed = materialize(signatures(docs))
    worded = signed.where("bands IS NOT NULL AND doc_id IS NOT NULL")
    first = [F.first(c).alias(c) for c in ("size", "bands", "sketch")]
    firsts = _numbered(materialize(worded.groupBy("content").agg(F.min("doc_id").alias("class_id"), *first)))
    rows = firsts.select("id", F.explode("bands").alias("k"))
    crowded = rows.groupBy("k").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("k")
    members = materialize(rows.join(crowded, "k"))
    some = materialize(members.select("id").distinct())
    wanted = firsts.join(some, "id", "left_semi").select(F.col("class_id").alias("doc_id"), "content", "id")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), _content(F.col("text")).alias("content"), "text")
    texts = materialize(texts.join(wanted, ["doc_id", "content"]).select(F.col("id").alias("doc_id"), "text"))
    known = firsts.join(some, "id", "left_semi").join(own_shingles(texts), "id", "left")
    known = materialize(known.select("id", "size", "bands", "sketch", (F.col("size") - F.coalesce("own", F.lit(0))).alias("shared")))
    members = materialize(members.join(known.drop("bands"), "id"))
    lead = F.max_by(F.struct("id", "size", "shared", "sketch"), F.struct(F.col("shared") / F.col("size"), -F.col("id")))
    leads = members.groupBy("k").agg(lead.alias("lead")).select("k", "lead.*").alias("y")
    pairs = members.alias("x").join(leads, F.col("x.k") == F.col("y.k")).where((F.col("x.id") != F.col("y.id")) & can_match("x", "y", least))
    ends = [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]
    pairs = materialize(pairs.select(*ends).distinct())
    links = materialize(verified(pairs, texts, least))
    roots = components(links)
    # those outside a bucket's largest component meet one more of its members, another one in each bucket
    placed = _split_buckets(members, roots)
    other = F.min_by(F.struct("id", "size", "shared", "sketch"), F.xxhash64("id", "k"))
    others = placed.where("root = main").groupBy("k").agg(other.alias("other")).select("k", "other.*").alias("y")
    again = placed.where("root <> main").alias("x").join(others, F.col("x.k") == F.col("y.k")).where(can_match("x", "y", least))
    again = materialize(again.select(*ends).distinct().join(pairs, ["a", "b"], "left_anti"))
    links = links.unionByName(materialize(verified(again, texts, least)))
    roots = components(links)
    # what the stars may have missed: buckets with several components. A pair is made in the first bucket
    # that both are in, and once if both are outside
    placed = materialize(_split_buckets(members, roots).join(known.select("id", "bands"), "id"))
    first_met = F.array_min(F.array_intersect("x.bands", "y.bands")) == F.col("x.k")
    once = (F.col("y.root") == F.col("x.main")) | (F.col("x.id") < F.col("y.id"))
    outside, everywhere = _dealt(placed)
    met = outside.alias("x").join(everywhere.alias("y"), (F.col("x.k") == F.col("y.k")) & (F.col("x.part") == F.col("y.part")))
    met = met.where((F.col("x.root") != F.col("y.root")) & once & can_match("x", "y", least) & first_met).select(*ends)
    met = materialize(met.join(pairs.unionByName(again), ["a", "b"], "left_anti"))
    more = materialize(verified(met, texts, least))
    groups = components(links.unionByName(more)) if more.limit(1).count() else roots
    classes = firsts.select("content", "class_id", "id")
    names = groups.join(classes, "id").groupBy("root").agg(F.min("class_id").alias("group_id"))
    named = classes.join(groups.join(names, "root"), "id", "left")
    named = named.select("content", "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("root", "id").alias("root"))
    alone = signed.where("bands IS NULL OR doc_id IS NULL").select("doc_id", "content", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("group_id"), F.lit(None).cast("bigint").alias("root"))
    return worded.select("doc_id", "content").join(named, "content").select(*alone.columns).unionByName(alone)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: doc_id, class_id, group_id."""
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that with the smallest doc_id; documents without an id stay.

    A document is a doc_id and a text, so another text under a repeated doc_id is judged by itself.
    """
    content = F.coalesce(F.col("content"), F.lit(b"")).alias("_content")
    groups = materialize(grouped(docs.select("doc_id", "text")).select("doc_id", content, "root"))
    of_groups = groups.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "_content")).alias("m")).select("m.*")
    kept = of_groups.unionByName(groups.where("root IS NULL AND doc_id IS NOT NULL").select("doc_id", "_content").distinct())
    slim, whole = apart(docs, "doc_id", "text")
    keyed = slim.withColumn("_content", F.coalesce(_content(F.col("text")), F.lit(b"")))
    one = F.row_number().over(Window.partitionBy("doc_id", "_content").orderBy("text"))
    first = whole(keyed.join(kept, ["doc_id", "_content"], "left_semi").withColumn("_one", one).where("_one = 1"))
    return first.unionByName(docs.where("doc_id IS NULL"))
