"""Operator 6, chat formatting: a hidden Markov model recovers the turns of plain transcripts.

A transcript is lines of text, some with a speaker marker, some without. Hidden states are a role and
whether the line begins a turn; a line is seen through features: its marker, its length, a question mark at
its end, blank. Tables of the model are counts over transcripts with known roles, made by Spark. Viterbi
finds the best path, and runs of lines become canonical turns.

Scale: no conversation is sorted or decoded in one task. Lines are range-partitioned and sorted by (conversation,
turn, text, line), so a partition holds a stretch of a conversation however long it is. A conversation that lies
within one partition and one block of BLOCK lines is decoded there. Of the others, each block gives a max-plus
matrix (best score from the state before to its last state), FAN of them multiply to one of the next level until a
conversation is one node; states then go down level by level, and each block is decoded between its two known
states. That is exactly Viterbi over the whole. A turn that runs over a block's end is put together by its first
line; it is the result, so it is held whole.

Defined results: null and empty texts are one blank line; null roles count as unknown in training and are
recovered like any other; different texts of one (conv_id, turn) stand in the order of their md5, and in training
each follows each of the turn before; null conv_ids are one conversation, a null turn comes first; the first line
always begins a turn; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, md5_number, table

ROLES = ("system", "user", "assistant")
#: Lines of a block, and the power of two of blocks that meet in one node.
BLOCK, FAN_BITS = 256, 8
#: Speaker markers of common transcript styles, by role.
MARKERS = {
    "system": ("System", "### System", "[system]", "Instructions"),
    "user": ("User", "### User", "[user]", "Human"),
    "assistant": ("Assistant", "### Assistant", "[assistant]", "AI"),
}
#: Number of values of each feature; a line's features are one number, the last feature its lowest digit.
FEATURES = {"marker": len(ROLES) + 1, "length": 5, "asks": 2, "blank": 2}
SEEN = int(np.prod(list(FEATURES.values())))
S = 2 * len(ROLES)  # state 2 * role: begins a turn; 2 * role + 1: goes on with it
START = S
NO_CONV = -(1 << 63)
#: Scores are whole multiples of this, so that their sums are exact however lines are cut into blocks.
UNIT = 2.0**-24


def marker_of(line: Column) -> Column:
    """0 without a marker, else 1 + the place of its role in ROLES."""
    out = F.lit(0)
    for i, role in enumerate(ROLES):
        names = "|".join(m.replace("[", r"\[").replace("]", r"\]") for m in MARKERS[role])
        out = F.when(line.rlike(rf"^(?:{names}):"), F.lit(i + 1)).otherwise(out)
    return out


ANY_MARKER = "^(?:" + "|".join(m.replace("[", r"\[").replace("]", r"\]") for ms in MARKERS.values() for m in ms) + "):"


def without_marker(line: Column) -> Column:
    return F.regexp_replace(line, ANY_MARKER + r"\s*", "")


def conversation() -> Column:
    return F.coalesce(F.col("conv_id").cast("bigint"), F.lit(NO_CONV)).alias("conv")


def lines_of(transcripts: DataFrame, *more: str) -> DataFrame:
    """One row per line of (conv_id, turn, text): conv, turn, key (of the text), copy (of the row), line_no, line, seen."""
    text = F.coalesce("text", F.lit(""))
    rows = transcripts.select(conversation(), F.col("turn").cast("bigint").alias("turn"), F.md5(text).alias("key"), F.monotonically_increasing_id().alias("copy"), F.split(text, "\n").alias("lines"), *more)
    df = rows.select("*", F.posexplode("lines").alias("line_no", "line")).drop("lines")
    n = F.length("line")
    values = {
        "marker": marker_of(F.col("line")),
        "length": F.when(n < 40, 0).when(n < 120, 1).when(n < 240, 2).when(n < 480, 3).otherwise(4),
        "asks": F.btrim("line").endswith("?").cast("int"),
        "blank": (F.btrim("line") == "").cast("int"),
    }
    seen = F.lit(0)
    for name, size in FEATURES.items():
        seen = seen * size + values[name]
    return df.withColumn("seen", seen.cast("int"))


def learn(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log transitions (from each state and START) and log emissions (state, seen), from (conv_id, turn, role, text) with
    known roles.

    The last line of a turn and the first of the next are neighbours by turn number. Turns are counted by
    (conversation, turn, role) before they meet, so repeated turns multiply counts and not rows.
    """
    known = labelled.where(F.col("role").isin(*ROLES))
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1
    state = (2 * role + (F.col("line_no") > 0).cast("int")).cast("int")
    counts = np.zeros((S, SEEN))
    for r in lines_of(known, "role").groupBy(state.alias("state"), "seen").count().collect():  # states x SEEN rows at most
        counts[r["state"], r["seen"]] = r["count"]
    counts = counts.reshape(S, *FEATURES.values())
    emissions = np.zeros_like(counts)
    for axis in range(1, counts.ndim):
        of_feature = counts.sum(axis=tuple(i for i in range(1, counts.ndim) if i != axis), keepdims=True) + 1
        emissions += np.log(of_feature / of_feature.sum(axis=axis, keepdims=True))
    moves = np.ones((S + 1, S))
    for r in range(len(ROLES)):
        for other in range(len(ROLES)):
            if r != other:  # a turn goes on in its own role only
                moves[2 * r, 2 * other + 1] = moves[2 * r + 1, 2 * other + 1] = 0
    moves[START, 1::2] = 0
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    turns = known.groupBy(conversation(), "turn", role.cast("int").alias("role"))
    turns = materialize(turns.agg(*[F.sum(x).cast("double").alias(k) for k, x in {"n": F.lit(1), "more": (n > 1).cast("int"), "inner": F.greatest(n - 2, F.lit(0))}.items()]))
    for r in turns.groupBy("role").agg(F.sum("more").alias("more"), F.sum("inner").alias("inner")).collect():
        moves[2 * r["role"], 2 * r["role"] + 1] += r["more"]
        moves[2 * r["role"] + 1, 2 * r["role"] + 1] += r["inner"]
    before = turns.select("conv", (F.col("turn") + 1).alias("turn"), F.col("role").alias("was"), F.col("n").alias("was_n"), F.col("more").alias("was_more"))
    pairs = turns.join(before, ["conv", "turn"], "left").groupBy("was", "role")
    for r in pairs.agg(F.sum("n").alias("first"), F.sum(F.expr("n * was_more")).alias("long"), F.sum(F.expr("n * (was_n - was_more)")).alias("short")).collect():
        if r["was"] is None:
            moves[START, 2 * r["role"]] += r["first"]
        else:
            moves[2 * r["was"], 2 * r["role"]] += r["short"]
            moves[2 * r["was"] + 1, 2 * r["role"]] += r["long"]
    with np.errstate(divide="ignore"):
        moves = np.log(moves / moves.sum(axis=1, keepdims=True))
    return np.round(moves / UNIT) * UNIT, np.round(emissions.reshape(S, SEEN) / UNIT) * UNIT


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _path(steps: list[np.ndarray], begin: int, end: int) -> list[int]:
    """States after each step on the best way from begin to end (-1: any); a step is a matrix of scores."""
    best, back = steps[0][begin], []
    for m in steps[1:]:
        total = best[:, None] + m[: len(best)]
        back.append(total.argmax(axis=0))
        best = total.max(axis=0)
    states = [int(best.argmax()) if end < 0 else end]
    for pick in reversed(back):
        states.append(int(pick[states[-1]]))
    return states[::-1]


class Decoder:
    """The steps within a task: blocks of lines to matrices, and lines between known states to turns."""

    def __init__(self, moves: np.ndarray, emissions: np.ndarray) -> None:
        self.steps = [moves + emissions[:, seen] for seen in range(SEEN)]

    def matrix(self, seen: list[int]) -> np.ndarray:
        m = self.steps[seen[0]]
        for x in seen[1:]:
            m = _times(m, self.steps[x][:S])
        return m

    def turns(self, seen: list[int], turn: list, line_no: list, line: list, before: int = START, last: int = -1) -> list[tuple]:
        """(part, first_turn, first_line, role, n_lines, text) of the lines' turns; part 0 goes on with an earlier one."""
        path = np.array(_path([self.steps[x] for x in seen], before, last))
        part = np.cumsum(path % 2 == 0)
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
        return [(int(part[i]), turn[i], line_no[i], ROLES[path[i] // 2], j - i, "\n".join(line[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]


TURN = "part int, first_turn bigint, first_line int, role string, n_lines bigint, text string"
TURN_FIELDS = [("part", pa.int32()), ("first_turn", pa.int64()), ("first_line", pa.int32()), ("role", pa.string()), ("n_lines", pa.int64()), ("text", pa.string())]
LINE_FIELDS = [("seen", pa.int32()), ("turn", pa.int64()), ("line_no", pa.int32()), ("line", pa.string())]


def _batch(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], schema=pa.schema(fields))


def blocks_of(lines: DataFrame, decoder: Decoder, block: int = BLOCK) -> DataFrame:
    """Two kinds of rows: turns of conversations that end within their partition and block (p is null), and blocks of the
    others, numbered by partition p and b, with their matrix m and lines."""
    fields = [("conv", pa.int64()), ("p", pa.int64()), ("b", pa.int64()), ("m", pa.list_(pa.float64())), *[(n, pa.list_(t)) for n, t in LINE_FIELDS], *TURN_FIELDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, b, conv, edge, out = TaskContext.get().partitionId(), 0, None, True, []
        held: list[list] = [[] for _ in LINE_FIELDS]

        def put() -> None:
            nonlocal b
            out.append((conv, p, b, decoder.matrix(held[0]).ravel(), *map(list, held), *[None] * len(TURN_FIELDS)))
            b += 1
            for x in held:
                x.clear()

        for batch in batches:
            convs = batch["conv"].to_numpy()
            columns = [batch[n].to_pylist() for n, _ in LINE_FIELDS]
            starts = np.flatnonzero(np.diff(convs, prepend=convs[:1] - 1, append=convs[-1:] - 1)).tolist()
            for i, j in zip(starts[:-1], starts[1:], strict=True):
                if convs[i] != conv:
                    if held[0] and (edge or b):
                        put()
                    elif held[0]:
                        out += [(conv, *[None] * (3 + len(LINE_FIELDS)), *t) for t in decoder.turns(*held)]
                        for x in held:
                            x.clear()
                    edge, conv, b = conv is None, int(convs[i]), 0
                while i < j:
                    if len(held[0]) == block:
                        put()
                    k = min(j, i + block - len(held[0]))
                    for x, column in zip(held, columns, strict=True):
                        x += column[i:k]
                    i = k
            yield _batch(out, fields)
            out.clear()
        if held[0]:  # the last one may go on in the next partition
            put()
            yield _batch(out, fields)

    order = ["conv", "turn", "key", "copy", "line_no"]
    schema = "conv bigint, p bigint, b bigint, m array<double>, seen array<int>, turn array<bigint>, line_no array<int>, line array<string>, " + TURN
    ordered = lines.select(*order, "seen", "line").repartitionByRange(*order).sortWithinPartitions(*order)
    return ordered.drop("key", "copy").mapInArrow(run, schema)


def block_states(nodes: DataFrame, bits: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """(conv, seq, before, last) of nodes (conv, seq, m) with seq of so many bits: the state before each and its last state."""
    grid = lambda kids: np.array([k["m"] for k in kids]).reshape(len(kids), S + 1, S)
    state = [("conv", pa.int64()), ("seq", pa.int64()), ("before", pa.int32()), ("last", pa.int32())]
    schema = "conv bigint, seq bigint, before int, last int"

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                m, *rest = grid(r["kids"])
                for x in rest:
                    m = _times(m, x[:S])
                out.append((r["conv"], r["seq"], m.ravel()))
            yield _batch(out, [*state[:2], ("m", pa.list_(pa.float64()))])

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(r["conv"], r["seq"], START, _path([np.reshape(r["m"], (S + 1, S))], START, -1)[-1]) for r in batch.to_pylist()], state)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                path = _path(list(grid(r["kids"])), r["before"], r["last"])
                out += zip([r["conv"]] * len(path), [k["seq"] for k in r["kids"]], [r["before"], *path[:-1]], path, strict=True)
            yield _batch(out, state)

    if bits <= 0:  # one node of each conversation
        return nodes.mapInArrow(ends, schema)
    kids = F.array_sort(F.collect_list(F.struct("seq", "m"))).alias("kids")  # 2 ** fan_bits at most
    level = materialize(nodes.groupBy("conv", F.shiftright("seq", fan_bits).alias("up")).agg(kids).withColumnRenamed("up", "seq"))
    above = block_states(level.mapInArrow(up, "conv bigint, seq bigint, m array<double>"), bits - fan_bits, fan_bits)
    return level.join(above, ["conv", "seq"]).mapInArrow(down, schema)


def last_before(own: DataFrame, bits: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """(conv, seq, earlier) of (conv, seq, own): the last own that isn't null of smaller seq. No window holds more than 2 ** fan_bits rows."""
    up = F.shiftright("seq", fan_bits)
    within = Window.partitionBy("conv", up).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    near = own.select("conv", "seq", F.last("own", ignorenulls=True).over(within).alias("earlier"))
    if bits <= fan_bits:
        return near
    groups = own.groupBy("conv", up.alias("up")).agg(F.max_by("own", F.when(F.col("own").isNotNull(), F.col("seq"))).alias("own"))
    above = last_before(groups.withColumnRenamed("up", "seq"), bits - fan_bits, fan_bits).select("conv", F.col("seq").alias("up"), F.col("earlier").alias("above"))
    return near.withColumn("up", up).join(above, ["conv", "up"]).select("conv", "seq", F.coalesce("earlier", "above").alias("earlier"))


def decode(transcripts: DataFrame, moves: np.ndarray, emissions: np.ndarray, block: int = BLOCK, fan_bits: int = FAN_BITS) -> DataFrame:
    """One row per recovered turn: conv_id, first_turn, first_line, role, n_lines, text."""
    decoder = Decoder(moves, emissions)
    line = F.when(F.col("line").rlike(ANY_MARKER), without_marker(F.col("line"))).otherwise(F.col("line"))
    rows = materialize(blocks_of(lines_of(transcripts).withColumn("line", line), decoder, block))
    names = ["conv", "first_turn", "first_line", "role", "n_lines", "text"]
    whole = rows.where("p IS NULL").select(*names)
    most_p, most_b = rows.agg(F.max("p"), F.max("b")).first()
    if most_p is not None:
        bits = int(most_b).bit_length()
        blocks = rows.where("p IS NOT NULL").withColumn("seq", F.shiftleft("p", bits) + F.col("b"))
        bits += int(most_p).bit_length()
        states = block_states(blocks.select("conv", "seq", "m"), bits, fan_bits)

        def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(r["conv"], r["seq"], *t) for r in batch.to_pylist() for t in decoder.turns(*(r[n] for n, _ in LINE_FIELDS), r["before"], r["last"])]
                yield _batch(out, [("conv", pa.int64()), ("seq", pa.int64()), *TURN_FIELDS])

        lines = blocks.select("conv", "seq", *(n for n, _ in LINE_FIELDS)).join(states, ["conv", "seq"])
        parts = materialize(lines.mapInArrow(told, "conv bigint, seq bigint, " + TURN))
        # where a part goes on with an earlier block's turn, the block and part of that turn's first line
        own = F.when(F.col("part") > 0, F.struct("seq", "part"))
        earlier = last_before(parts.groupBy("conv", "seq").agg(F.max(own).alias("own")), bits, fan_bits)
        parts = parts.join(earlier, ["conv", "seq"]).withColumn("start", F.coalesce(own, F.col("earlier")))
        pieces = F.array_sort(F.collect_list(F.struct("seq", "part", *names[1:]))).alias("p")
        joined = parts.groupBy("conv", "start").agg(pieces)
        n_lines = F.aggregate("p", F.lit(0).cast("bigint"), lambda a, x: a + x["n_lines"]).alias("n_lines")
        text = F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text")
        whole = whole.unionByName(joined.select("conv", *[F.col("p")[0][n].alias(n) for n in names[1:4]], n_lines, text))
    return whole.select(F.when(F.col("conv") != NO_CONV, F.col("conv")).alias("conv_id"), *names[1:])


def rendered(turns: DataFrame) -> DataFrame:
    """turns with column rendered: the canonical form of each."""
    return turns.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), "text", F.lit("\n<|end|>\n")))


def as_transcripts(conversations: DataFrame, unmarked_percent: int = 25) -> DataFrame:
    """Plain transcripts of conversations: each has a marker style of its own, and some turns lose their marker."""
    conv, turn = F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.coalesce(F.col("turn").cast("string"), F.lit(""))
    style = F.pmod(md5_number(F.lit("style:"), conv), F.lit(4)).cast("int")
    marker = F.lit("")
    for role, names in MARKERS.items():
        marker = F.when(F.col("role") == role, F.concat(F.element_at(F.array(*map(F.lit, names)), style + 1), F.lit(": "))).otherwise(marker)
    plain = F.pmod(md5_number(F.lit("plain:"), conv, F.lit("/"), turn), F.lit(100)) < unmarked_percent
    return conversations.withColumn("text", F.concat(F.when(plain, F.lit("")).otherwise(marker), F.coalesce("text", F.lit(""))))


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit(""))) % 3 == 1


def parse(transcripts: DataFrame, labelled: DataFrame, block: int = BLOCK, fan_bits: int = FAN_BITS) -> DataFrame:
    """Recovered turns of transcripts (conv_id, turn, text), with the model learnt from labelled ones (with role)."""
    return rendered(decode(transcripts, *learn(labelled), block, fan_bits))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per recovered turn of every conversation: conv_id, first_turn, first_line, role, n_lines, rendered."""
    plain = as_transcripts(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return parse(plain.select("conv_id", "turn", "text"), plain.where(~held_out())).drop("text")
