"""The ten operators: against SQL or brute force, over ordinary, odd and empty tables."""

from __future__ import annotations

import functools
import itertools
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from glyphlake.llm import chat_format, language, lattice_lm, length_buckets, mixing, near_dup, token_counts, token_files
from glyphlake.llm.queries import ORACLE_SQL, QUERIES

from ..conftest import DATA
from .conftest import LINE, LONG, TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").collect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, same, odd, nameless, name):
    same(QUERIES[name](spark, DATA), ORACLE_SQL[name])
    same(QUERIES[name](spark, odd), ORACLE_SQL[name], odd)
    same(QUERIES[name](spark, nameless), ORACLE_SQL[name], nameless)


def test_token_counts(spark, odd, nameless):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for folder in (DATA, odd, nameless):
        want = sorted(((r["doc_id"], len((t := r["text"] or "").encode()), n := len(model.encode(t)), n > 4096) for r in documents(spark, folder)), key=str)
        assert sorted(map(tuple, QUERIES["op1_token_counts"](spark, folder).collect()), key=str) == want


def test_splices_of_small_chunks():
    counter = token_counts.SplicingCounter(public_tokenizers.path("piece_bpe_32k.model"), chunk=50, overlap=4)
    texts = [(t or "")[:4_000] for t in TEXTS]
    assert counter.count(pa.array(texts)).tolist() == [len(counter.model.encode(t)) for t in texts]


@pytest.mark.parametrize(("chunk", "overlap"), [(20, 2), (50, 4), (100, 16)])
def test_splices_of_random_texts(chunk, overlap):
    rng = random.Random(chunk)
    parts = ["a", "the ", " ", "\n", "x" * 30, "é", "▁", "word", "  ", "中", ".", "\r\n", "<s>", "\t", " \n"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(150))) for _ in range(300)]
    counter = token_counts.SplicingCounter(public_tokenizers.path("piece_bpe_32k.model"), chunk, overlap)
    assert counter.count(pa.array(texts)).tolist() == [len(counter.model.encode(t)) for t in texts]


def test_a_run_without_a_boundary_widens_no_further_than_it_must():
    counter = token_counts.SplicingCounter(public_tokenizers.path("piece_bpe_32k.model"))
    text = "the quick brown fox jumps over it " * 4_500 + "x" * 45_000 + " lazy dogs and other words" * 5_700
    calls, starts = [], counter.starts
    counter.starts = lambda t, a, b: calls.append(min(b, len(t)) - a) or starts(t, a, b)
    assert counter.count(pa.array([text])).tolist() == [len(counter.model.encode(text))]
    assert max(calls) < 2 * 45_000 and sum(calls) < 2 * len(text)


def test_filters_on_a_judgement_end(spark):
    began = time.monotonic()
    rows = QUERIES["op2_quality_rules"](spark, DATA).collect()
    for condition, want in (("kept", [r for r in rows if r["kept"]]), ("base_failed", [r for r in rows if r["base_failed"]]), ("kept AND n_words > 100", [r for r in rows if r["kept"] and r["n_words"] > 100])):
        judged = QUERIES["op2_quality_rules"](spark, DATA).where(condition)
        assert sorted(map(tuple, judged.collect())) == sorted(map(tuple, want)) and judged.count() == len(want)
    assert time.monotonic() - began < 120


def test_lattice_scores(spark, odd):
    for folder in (DATA, odd):
        docs = documents(spark, folder)
        lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        words = [[*WORD.findall(lower(r["text"])), None] for r in docs]
        held = [zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in docs]
        c = Counter(w for ws, h in zip(words, held, strict=True) if not h for w in ws)
        n, v = sum(c.values()), len(c)
        base = lambda ws: sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        want = sorted((r["doc_id"], h, len(ws), sum(c[w] > 0 for w in ws), n, base(ws)) for r, ws, h in zip(docs, words, held, strict=True))
        got = QUERIES["op3_lattice_score"](spark, folder).collect()
        got_rows = sorted(tuple(r)[:6] for r in got)
        assert [r[:5] for r in got_rows] == [r[:5] for r in want]
        assert [r[5] for r in got_rows] == pytest.approx([r[5] for r in want])
        assert {r["doc_id"]: r["score"] for r in got if r["doc_id"] % 7 == 0} == pytest.approx(plain_scores(docs, words, held))


def plain_scores(docs, words, held):
    """log10 probabilities by the forward recursion over each word, with pieces counted in the training words."""
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    used = Counter(i for ws, h in zip(words, held, strict=True) if not h for w in ws for i in ([model.eos_id()] if w is None else model.encode(w)))
    n = model.get_piece_size()
    p = {i: (used[i] + lattice_lm.SMOOTHING) / (used.total() + lattice_lm.SMOOTHING * n) for i in range(n)}
    ids = {model.id_to_piece(i): i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}

    @functools.cache
    def log10(word):
        if word is None:
            return np.log10(p[model.eos_id()])
        text, alpha = "▁" + word, [0.0]
        for j, ch in enumerate(text):
            terms = [alpha[i] + np.log(p[ids[text[i : j + 1]]]) for i in range(max(0, j - 20), j + 1) if text[i : j + 1] in ids]
            if ch not in ids:
                terms.append(alpha[j] + sum(np.log(p[model.piece_to_id(f"<0x{b:02X}>")]) for b in ch.encode()))
            alpha.append(np.logaddexp.reduce(terms))
        return alpha[-1] / np.log(10)

    return {r["doc_id"]: sum(map(log10, ws)) for r, ws in zip(docs, words, strict=True) if r["doc_id"] % 7 == 0}


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "a", "b", "ab", "▁a", "▁ab", "<0xE4>", "<0xB8>", "<0xAD>"]
    p = np.array([0.2, 0.2, 0.1, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05])
    lattice = lattice_lm.PieceLattice(pieces, [x[0] == "<" for x in pieces], np.log(p))
    prob = dict(zip(pieces, p, strict=True))

    def total(s: str) -> float:
        return 1.0 if not s else sum(prob[s[:i]] * total(s[i:]) for i in range(1, len(s) + 1) if s[:i] in prob)

    words = ["ab", "aab", "b", "ba" * 5, "ab" * 60]
    assert lattice.log10(words) == pytest.approx([np.log10(total("▁" + w)) for w in words[:4]] + [lattice._one("▁" + words[4]) / np.log(10)])
    assert lattice.log10(["中"])[0] == pytest.approx(np.log10(0.2 * 0.1 * 0.05 * 0.05))


def test_lattice_of_long_words(monkeypatch):
    """Words over many blocks of positions, with characters that no piece holds, by the plain recursion; a word of 1 MB in seconds."""
    model = lattice_lm._model(lattice_lm.MODEL)
    rng = np.random.default_rng(1)
    lattice = lattice_lm._lattice(lattice_lm.MODEL, rng.integers(0, 1000, model.get_piece_size()).astype(float).tobytes())
    text = "".join(rng.choice(list("abcdefghiklmnorstuABC0123+/=é中😀\u0b95"), 1500))
    alpha = [0.0]
    for j in range(1, len(text) + 1):
        ends = [alpha[i] + lattice.log_p[text[i:j]] for i in range(max(0, j - lattice.longest), j) if text[i:j] in lattice.log_p]
        ends += [] if text[j - 1] in lattice.log_p else [alpha[-1] + lattice._spelt(text[j - 1])]
        alpha.append(np.logaddexp.reduce(ends))
    for positions in (1, 7, 499, 1500, 65_536):
        monkeypatch.setattr(lattice_lm, "POSITIONS", positions)
        assert lattice._one(text) == pytest.approx(alpha[-1], rel=1e-12)
    large = "".join(rng.choice(list("abcdefghiklmnorstuABC0123+/="), 1 << 20))
    began = time.perf_counter()
    assert np.isfinite(lattice.log10([large])).all()
    assert time.perf_counter() - began < 8  # 13 s before, with one look-up for each character and length


def test_lattice_scores_with_shares_and_blocks(spark, monkeypatch):
    """Parts dealt in shares of chunks, and counts added up by blocks of chunks, give the same scores."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", lattice_lm.held_out().alias("held_out"))
    rounded = lambda rows: sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in rows)
    want = rounded(lattice_lm.score(docs).collect())
    monkeypatch.setattr(lattice_lm, "ENTRIES", 40)
    monkeypatch.setattr(lattice_lm, "CHUNKS", 3)
    monkeypatch.setattr(lattice_lm, "LEAST_PARTS", 5)
    monkeypatch.setattr(lattice_lm, "SLICE", 20_000)
    assert rounded(lattice_lm.score(docs, chunk_bytes=40_000).collect()) == want


def test_token_files(spark, odd):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for folder in (DATA, odd):
        at, want = 0, []
        for r in sorted(documents(spark, folder), key=lambda r: r["doc_id"]):
            ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
            want.append((r["doc_id"], at, len(ids), zlib.crc32(ids.tobytes())))
            at += len(ids)
        assert sorted(map(tuple, QUERIES["op4_token_files"](spark, folder).collect())) == sorted(want)


@pytest.mark.parametrize("vocabulary", [2, 50_257, 1 << 16, 1 << 31])
def test_packing_round_trip(tmp_path, vocabulary):
    ids = np.random.default_rng(1).integers(0, vocabulary, 1_003).astype(np.uint32)
    writer = token_files.PackedWriter(f"file://{tmp_path}/x.bin", vocabulary, block=64)
    writer.append(ids, np.array([7]), np.array([False]), np.array([len(ids)]))
    writer.close()
    reader = token_files.PackedReader(f"file://{tmp_path}/x.bin")
    for a, b in ((0, 1_003), (63, 65), (500, 500), (1_002, 1_003)):
        assert (reader.ids(a, b) == ids[a:b]).all()


@pytest.mark.parametrize("name", ["op3_lattice_score", "op4_token_files", "op5_language_id", "op8_length_buckets", "op9_near_duplicates"])
def test_documents_without_an_id_are_rows_like_others(spark, odd, nameless, name):
    rows = QUERIES[name](spark, nameless).collect()
    assert len(rows) == spark.read.parquet(f"{nameless}/documents.parquet").count()
    assert sum(r["doc_id"] is None for r in rows) == 4


def test_language(spark, odd):
    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in documents(spark, DATA)}
    got = QUERIES["op5_language_id"](spark, DATA).collect()
    held = [r for r in got if r["held_out"] and truth[r["doc_id"]][0] and any(c.isalpha() for c in truth[r["doc_id"]][1] or "")]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]][0] for r in held]) > 0.9
    assert all(0 <= r["score"] <= 1 for r in got)
    rows = {r["doc_id"]: r["lang_pred"] for r in QUERIES["op5_language_id"](spark, odd).collect()}
    assert [rows[i] for i in range(3)] == ["und"] * 3 and rows[9] == "en"


def test_language_stage_drops_other_languages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    strange = ["中文字符。" * 50, "Привет мир как дела сегодня", "안녕하세요 세계", "漢", "ελληνικά γράμματα είναι εδώ"]
    more = spark.createDataFrame([(10_000_000 + i, t) for i, t in enumerate(strange)], "doc_id bigint, text string")
    kept = {r["doc_id"] for r in language.language_stage(spark, docs.unionByName(more, allowMissingColumns=True), DATA).collect()}
    assert kept == {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}


def test_ftrl_equals_a_plain_one():
    """Per-coordinate FTRL-proximal with an elastic net, in plain numbers; most weights stay zero."""
    rng, a, b, l1, l2 = np.random.default_rng(6), language.ALPHA, language.BETA, language.L1, language.L2
    rows = []
    for _ in range(60):
        idx = np.sort(rng.choice(40, 6, replace=False))
        x = rng.random(6)
        rows.append((idx, x / np.sqrt(x @ x), int(idx[0] % 3)))
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= l1:
            return 0.0
        return -(z[k] - (l1 if z[k] > 0 else -l1)) / ((b + n[k] ** 0.5) / a + l2)

    for _ in range(language.EPOCHS):
        for idx, x, label in rows:
            w = {(i, c): weight((i, c)) for i in idx for c in range(3)}
            e = [np.exp(sum(xi * w[i, c] for i, xi in zip(idx, x, strict=True))) for c in range(3)]
            for i, xi in zip(idx, x, strict=True):
                for c in range(3):
                    g = xi * (e[c] / sum(e) - (c == label))
                    before = n.get((i, c), 0.0)
                    n[i, c] = before + g * g
                    z[i, c] = z.get((i, c), 0.0) + g - (n[i, c] ** 0.5 - before**0.5) / a * w[i, c]
    got = language.fit_ftrl(rows, 3)
    assert got[:40] == pytest.approx(np.array([[weight((i, c)) for c in range(3)] for i in range(40)]))
    assert not got[40:].any() and (got[:40] != 0).any()


def test_calibration_finds_the_temperature():
    rng = np.random.default_rng(7)
    logits = rng.normal(0, 2, (4_000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=x) for x in p])
    assert language.calibrate(logits, labels) == pytest.approx(1, rel=0.1)
    assert language.calibrate(logits * 3, labels) == pytest.approx(3, rel=0.1)


def test_sample_is_bounded_whatever_repeats(spark):
    rows = [(None, f"{LINE} {i}", "en") for i in range(200)] + [(1, LINE, "en")] * 300 + [(2, "der die das", "de")] * 300
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("h", F.xxhash64("doc_id", "text"))
    assert sorted(tuple(r) for r in language.bounded(docs, 50).groupBy("lang").count().collect()) == [("de", 50), ("en", 50)]
    model = language.fit(docs, per_language=50)
    assert model.languages == ["de", "en"] and model.probabilities(LINE).argmax() == 1


def test_least_score_lies_above_chance():
    for n in (2, 3, 4, 20):
        assert 1 / n < language.least_score(np.linspace(0.9, 1, 50), n) < 0.9
    assert language.least_score(np.empty(0), 4) == 0.25


def viterbi(seen, moves, emissions):
    """Plain Viterbi over all lines of a conversation at once."""
    best, back = moves[chat_format.START] + emissions[:, seen[0]], []
    for x in seen[1:]:
        total = best[:, None] + moves[: chat_format.S]
        back.append(total.argmax(axis=0))
        best = total.max(axis=0) + emissions[:, x]
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def assert_best(got, talk, moves, emissions):
    """The turns cover every line in order, and score as much as plain Viterbi's path over each whole conversation."""
    lines, turns = {}, {}
    for r in chat_format.lines_of(talk.select("conv_id", "turn", "text")).collect():
        order = (r["turn"] is not None, r["turn"], r["key"], r["copy"], r["line_no"])
        lines.setdefault(r["conv"], []).append((order, r))
    for r in got:
        turns.setdefault(chat_format.NO_CONV if r["conv_id"] is None else r["conv_id"], []).append(r)
    assert set(lines) == set(turns)
    for conv, own in lines.items():
        own = [r for _, r in sorted(own, key=lambda x: x[0])]
        seen = [r["seen"] for r in own]
        at = {(r["first_turn"], r["first_line"], r["text"].partition("\n")[0]): r for r in turns[conv]}
        path, i = [], 0
        if len({(r["turn"], r["line_no"], r["line"]) for r in own}) < len(own):  # nothing tells repeated rows apart
            assert sum(r["n_lines"] for r in turns[conv]) == len(own)
            continue
        while i < len(own):
            r = at[own[i]["turn"], own[i]["line_no"], re.sub(chat_format.ANY_MARKER + r"\s*", "", own[i]["line"])]
            path += [2 * chat_format.ROLES.index(r["role"]), *[2 * chat_format.ROLES.index(r["role"]) + 1] * (r["n_lines"] - 1)]
            i += r["n_lines"]
        total = lambda p: moves[chat_format.START, p[0]] + sum(moves[a, b] for a, b in itertools.pairwise(p)) + sum(emissions[s, x] for s, x in zip(p, seen, strict=True))  # noqa: B023, E731
        assert len(path) == len(own) and total(path) == total(viterbi(seen, moves, emissions))


def test_chat_of_hot_conversations(spark):
    """Null ids, a turn of very many lines, repeated and null turns: as if each conversation were decoded whole."""
    rng = random.Random(4)
    line = lambda: rng.choice(["User: what now?", "Assistant: this", "", "some more of it", "Is it?", "x" * 130])
    rows = [(None, i, rng.choice(["user", "assistant"]), "\n".join(line() for _ in range(i % 4))) for i in range(300)]
    rows += [(1, 0, "user", "\n".join(line() for _ in range(3_000))), (1, 1, "assistant", "fine")]
    rows += [(2, None, "user", f"{i} {line()}") for i in range(100)] + [(3, 4, "system", "same\nagain")] * 200
    rows += [(k, t, "user" if t % 2 == 0 else "assistant", line()) for k in range(10, 60) for t in range(4)]
    talk = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    moves, emissions = chat_format.learn(talk)
    for block, fan_bits in ((16, 2), (256, 8)):
        got = chat_format.decode(talk.select("conv_id", "turn", "text"), moves, emissions, block, fan_bits).collect()
        assert_best(got, talk, moves, emissions)
    assert sum(r["n_lines"] for r in got) == sum(r[3].count("\n") + 1 for r in rows)


def test_chat_counts(spark):
    """Transition counts by hand: repeated turns count each with each of the turn before."""
    talk = spark.createDataFrame([(None, 0, "user", "a")] * 3 + [(None, 1, "assistant", "b\nc")] * 2 + [(7, 0, "assistant", "x")], "conv_id bigint, turn bigint, role string, text string")
    moves = np.exp(chat_format.learn(talk)[0])
    assert moves[chat_format.START, [0, 2, 4]] == pytest.approx([1 / 7, 4 / 7, 2 / 7])
    assert moves[2, 4] / moves[2, 2] == pytest.approx(7) and moves[4, 5] / moves[4, 4] == pytest.approx(3)


def test_chat(spark, odd):
    for folder in (DATA, odd):
        talk = chat_format.as_transcripts(spark.read.parquet(f"{folder}/conversations.parquet"))
        moves, emissions = chat_format.learn(talk)
        got = chat_format.decode(talk.select("conv_id", "turn", "text"), moves, emissions, block=2, fan_bits=2).collect()
        assert_best(got, talk, moves, emissions)
    rows = QUERIES["op6_chat_format"](spark, DATA).collect()
    truth = {(r["conv_id"], r["turn"]): r["role"] for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    held = [r for r in rows if zlib.crc32(str(r["conv_id"]).encode()) % 3 == 1]
    assert np.mean([truth[r["conv_id"], r["first_turn"]] == r["role"] for r in held]) > 0.9


def test_mixing(spark, odd):
    for folder in (DATA, odd):
        rows = QUERIES["op7_source_mixing"](spark, folder).collect()
        assert all(r["taken"] <= 3 * r["size"] and r["target"] <= 3 * r["source_size"] + 1e-6 for r in rows)
        targets = {(r["source_size"], r["target"]) for r in rows}
        assert sum(t for _, t in targets) == pytest.approx(sum(s for s, _ in targets))
    drawn = mixing.mix_stage(spark, spark.read.parquet(f"{DATA}/documents.parquet"), DATA).collect()
    taken = {r["doc_id"]: r["taken"] for r in QUERIES["op7_source_mixing"](spark, DATA).collect()}
    words = Counter()
    for r in drawn:
        words[r["doc_id"]] += len(WORD.findall(r["text"] or ""))
    assert all(words[k] == n for k, n in taken.items())


def test_best_boundaries():
    rng = np.random.default_rng(2)
    for _ in range(20):
        grid = np.sort(rng.choice(60, 7, replace=False)) + 1
        counts = rng.integers(1, 9, 7)
        cost = lambda bounds: sum(c * (min(b for b in bounds if b >= g) - g) for g, c in zip(grid, counts, strict=True))
        for k in (1, 2, 3, 9):
            best = min(cost([*b, grid[-1]]) for b in itertools.combinations(grid[:-1], min(k, 7) - 1))
            assert cost(length_buckets.best_boundaries(grid.tolist(), counts.tolist(), (counts * grid).tolist(), k)) == best


def least_padding(lengths, k):
    """By plain dynamic programming over distinct lengths, of k boundaries at most."""
    cells = sorted(Counter(max(1, n) for n in lengths).items())
    cost = {0: 0}
    for _ in range(k):
        cost = {j: min(cost[i] + sum((cells[j - 1][0] - n) * c for n, c in cells[i:j]) for i in cost if i < j) if j else 0 for j in range(len(cells) + 1)}
    return cost[len(cells)] + sum(n == 0 for n in lengths)


def test_buckets(spark, odd):
    for folder in (DATA, odd):
        rows = QUERIES["op8_length_buckets"](spark, folder).collect()
        assert sum(r["padding"] for r in rows) == least_padding([r["length"] for r in rows], length_buckets.N_BUCKETS)
        assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in documents(spark, folder))
        assert all(r["length"] <= r["boundary"] and r["padding"] == r["boundary"] - r["length"] for r in rows)
        batches = Counter((r["bucket"], r["boundary"], r["batch"]) for r in rows)
        assert all(n == 1 or n * boundary <= length_buckets.TOKEN_BUDGET for (_, boundary, _), n in batches.items())


def test_bucket_lengths_are_tokens(spark, odd):
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for folder in (DATA, odd):
        want = sorted((r["doc_id"], len(model.encode(r["text"] or ""))) for r in documents(spark, folder))
        packed = length_buckets.packing_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        for df in (QUERIES["op8_length_buckets"](spark, folder), packed):
            rows = df.collect()
            assert sorted((r["doc_id"], r["length"]) for r in rows) == want
            full = Counter()
            for r in rows:
                full[r["bucket"], r["batch"]] += r["length"]
            alone = Counter((r["bucket"], r["batch"]) for r in rows)
            assert all(n <= length_buckets.TOKEN_BUDGET or alone[b] == 1 for b, n in full.items())
            # no more batches than the budget asks for, each but a bucket's last one full
            for bucket, boundary in {(r["bucket"], r["boundary"]) for r in rows}:
                size, own = max(1, length_buckets.TOKEN_BUDGET // boundary), [n for (b, _), n in sorted(alone.items()) if b == bucket]
                assert len(own) == -(-sum(own) // size) and all(n == size for n in own[:-1])


def bag(text):
    w = WORD.findall(text or "")
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def components(rows):
    """The smallest id of each document's group, over all pairs of (doc_id, text)."""
    docs = {r["doc_id"]: bag(r["text"]) for r in rows}
    root = {i: i for i in docs}
    for a, b in itertools.combinations(sorted(docs), 2):
        x, y = docs[a], docs[b]
        if x and y and 0.8 * max(x.total(), y.total()) <= min(x.total(), y.total()) and (x & y).total() >= 0.8 * (x | y).total() - 1e-9:
            low, high = sorted((root[a], root[b]))
            root = {k: low if v == high else v for k, v in root.items()}
    return root


def test_near_duplicates(spark, odd):
    for folder in (DATA, odd):
        got = {r["doc_id"]: r["group_id"] for r in QUERIES["op9_near_duplicates"](spark, folder).collect()}
        assert got == components(documents(spark, folder))


def test_hot_bucket_is_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "PART", 20)
    members = spark.range(400).selectExpr("7L AS k", "id")
    placed = near_dup._split_buckets(members, spark.range(100).selectExpr("id", "0L AS root"))
    outside, everywhere = near_dup._dealt(placed)
    met = outside.alias("x").join(everywhere.alias("y"), ["k", "part"]).selectExpr("part", "x.id AS a", "y.id AS b")
    sizes = [r["count"] for r in met.groupBy("part").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 400 * 40
    assert met.select("a", "b").distinct().count() == met.count() == 300 * 400


def test_texts_of_a_repeated_id(spark):
    line = [f"{LINE} {' '.join(f'{k}{i}' for i in range(40))}" for k in "abc"]
    rows = [(1, line[0]), (2, line[0] + " z"), (2, line[1]), (2, line[2]), (2, line[2]), (3, line[1] + " z"), (4, line[2]), (4, None), (4, " "), (None, line[0])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = near_dup.near_dup_stage(spark, docs, DATA).collect()
    want = [(1, line[0]), (2, line[1]), (2, line[2]), (4, None), (4, " "), (None, line[0])]
    assert sorted(map(tuple, kept), key=str) == sorted(want, key=str)
    got = sorted((tuple(r) for r in near_dup.near_duplicates(docs.where("text LIKE '%40%' OR text LIKE '%39%'")).where("doc_id IS NOT NULL").collect()))
    assert got == [(1, 1, 1), (2, 2, 1), (2, 2, 2), (2, 2, 2), (2, 2, 2), (3, 3, 2), (4, 2, 2)]


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(3)
    names = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    x, y = rng.integers(1, 12, 40), rng.integers(0, 12, 40)
    want = np.minimum(x, y).sum() / np.maximum(x, y).sum()
    a = near_dup.bag_minhash(names, x, m=4096)
    b = near_dup.bag_minhash(names[y > 0], y[y > 0], m=4096)
    assert np.mean(a == b) == pytest.approx(want, abs=0.04)


def test_agreement_of_edges():
    assert len(near_dup.shingle_hashes(np.empty(0, np.uint8), np.array([0, 0]))[0]) == 0
    data = np.frombuffer(f"{LINE}{LONG[:50]}".encode(), dtype=np.uint8)
    parts = near_dup.shingle_hashes(data, np.array([0, len(LINE), len(LINE) + 50]))
    assert len(parts[0]) == len(LINE.split()) - 4
    assert (parts[0] == near_dup.shingle_hashes(data[: len(LINE)], np.array([0, len(LINE)]))[0]).all()
