import json
import struct
import zlib

import numpy as np
import pytest

from glyphlake.operators import browse
from glyphlake.schemas import TABLES
from glyphlake.sources import files, images, npy
from glyphlake.operators import activity, sequences
from glyphlake.streaming import activity as streams

from .conftest import DATA


def test_files(spark, tmp_path):
    (tmp_path / "index.json").write_text(json.dumps({"U+9451": 1, "U+91D1": 0}))
    assert sorted(map(tuple, files.read_class_index(spark, str(tmp_path / "index.json")).collect())) == [("U+91D1", 0), ("U+9451", 1)]
    np.save(tmp_path / "anchors.npy", np.eye(3, dtype="float32"))
    rows = files.read_npy(spark, str(tmp_path / "*.npy")).orderBy("idx").collect()
    assert [list(r["embedding"]) for r in rows] == np.eye(3).tolist()
    stats = spark.createDataFrame([("U+9451", None)], "codepoint string, gloss string")
    files.write_json(stats, str(tmp_path / "out"))
    assert [json.loads(r[0]) for r in spark.read.text(str(tmp_path / "out")).collect()] == [{"codepoint": "U+9451", "gloss": None}]
    lists = spark.createDataFrame([('["a"]',), ("{",), (None,)], "v string")
    assert [r["items"] for r in files.read_list(lists, "v").collect()] == [["a"], [], []]


def test_dictionary_round_trip(spark, tmp_path):
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert tuple(browse.db_stats(files.read_dictionary(spark, str(tmp_path))).first()) == (0, 0, 0, 0, 0)


def test_a_matrix_in_many_files_and_tasks(spark, tmp_path):
    """Written in files of a few rows by several tasks and read by ranges: each row once, in the order of idx."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(1000, 7)).astype("float32")
    rows = spark.createDataFrame([(int(i) * 3 - 500, values[i].tolist()) for i in rng.permutation(1000)], "idx bigint, embedding array<float>")
    npy.write_matrix(rows.repartition(3), str(tmp_path / "m"), file_bytes=28 * 90)
    listed = json.loads((tmp_path / "m" / npy.LIST).read_text())
    assert len(listed) > 4 and sum(f["rows"] for f in listed) == 1000
    assert np.array_equal(np.vstack([np.load(tmp_path / "m" / f["name"]) for f in listed]), values)
    back = npy.read_matrix(spark, str(tmp_path / "m"), task_bytes=28 * 40)
    assert back.rdd.getNumPartitions() >= 25
    got = sorted(back.collect())
    assert [r["idx"] for r in got] == list(range(1000)) and np.array_equal(np.array([r["embedding"] for r in got], dtype="float32"), values)


def test_one_file_is_a_matrix(spark, tmp_path):
    for dtype in ("<f4", "<f8", ">f4"):
        path = tmp_path / f"one{dtype[1:]}{ord(dtype[0])}.npy"
        np.save(path, np.arange(60).reshape(20, 3).astype(dtype))
        got = npy.read_matrix(spark, str(path), task_bytes=100)
        assert got.rdd.getNumPartitions() > 1
        assert [(r["idx"], list(r["embedding"])) for r in sorted(got.collect())] == [(i, [3.0 * i, 3.0 * i + 1, 3.0 * i + 2]) for i in range(20)]


def test_odd_matrices(spark, tmp_path):
    empty = spark.createDataFrame([], "idx bigint, embedding array<float>")
    npy.write_matrix(empty, str(tmp_path / "empty"))
    assert npy.read_matrix(spark, str(tmp_path / "empty")).count() == 0
    for n, rows in enumerate(([(0, [1.0]), (1, [1.0, 2.0])], [(0, None)], [(0, [None])])):
        with pytest.raises(Exception, match="one length"):
            npy.write_matrix(spark.createDataFrame(rows, "idx bigint, embedding array<float>"), str(tmp_path / f"odd{n}"))
        assert not (tmp_path / f"odd{n}" / npy.LIST).exists()
    np.save(tmp_path / "column.npy", np.asfortranarray(np.ones((3, 2), "float32")))
    with pytest.raises(Exception, match="by column: True"):
        npy.read_matrix(spark, str(tmp_path / "column.npy")).count()


def png(pixels):
    """A PNG of (height, width, 3) bytes."""
    h, w, _ = pixels.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    lines = b"".join(b"\0" + row.tobytes() for row in pixels)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_images_of_a_folder(spark, tmp_path):
    """Images in path order, labelled by their stems; what is no image, or of another suffix, is left out."""
    rng = np.random.default_rng(2)
    made = {name: rng.integers(0, 256, (4 + n, 6 - n, 3), dtype=np.uint8) for n, name in enumerate(("U+91D1", "U+4E00", "a.b"))}
    for name, pixels in made.items():
        (tmp_path / f"{name}.png").write_bytes(png(pixels))
    (tmp_path / "broken.png").write_bytes(b"no image")
    (tmp_path / "other.txt").write_bytes(png(made["a.b"]))
    rows = files.read_glyphs(spark, str(tmp_path)).collect()
    assert [r["label"] for r in rows] == ["U+4E00", "U+91D1", "a.b"] and [r["path"] for r in rows] == sorted(r["path"] for r in rows)
    for r in rows:
        assert np.array_equal(images.rgb(r["data"], r["height"], r["width"], r["channels"]), made[r["label"]])


def test_image_preparation():
    black = images.prepared(np.zeros((10, 4, 3), dtype=np.uint8))
    assert black.shape == (3, 128, 128) and black.dtype == np.float32
    assert black[0, 64, 64] == -1.0 and black[0, 64, 0] == 1.0  # padded with white at the sides
    assert images.rgb(bytes([1, 2, 3, 9]), 1, 1, 4).tolist() == [[[3, 2, 1]]]


def run(stream, mode, tmp_path, name):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return stream.sparkSession.table(name).collect()


@pytest.fixture
def events(spark, tmp_path):
    spark.read.parquet(f"{DATA}/events.parquet").selectExpr("user_id", "event_type AS key", "ts", "event_id").write.parquet(str(tmp_path / "events"))
    return spark.readStream.schema("user_id bigint, key string, ts timestamp_ntz, event_id bigint").parquet(str(tmp_path / "events"))


def test_streams(spark, tmp_path, events):
    rows = spark.read.parquet(f"{DATA}/events.parquet").toPandas().sort_values(["ts", "event_id"])
    recent = {r["user_id"]: list(r["keys"]) for r in run(streams.recent_stream(events, 3), "update", tmp_path, "recent")}
    for user, own in rows.groupby("user_id"):
        assert recent[user] == own["event_type"][::-1].drop_duplicates().tolist()[:3]
    stacks = {r["user_id"]: (r["current"], list(r["trail"])) for r in run(streams.back_stack_stream(events, home="signup", back="error"), "update", tmp_path, "stack")}
    for user, own in rows.groupby("user_id"):
        current, trail = None, []
        for k in own["event_type"]:
            if k == "signup":
                current, trail = None, []
            elif k == "error":
                current = trail.pop() if trail else current
            elif k != current:
                trail += [current] if current else []
                current = k
        assert stacks[user] == (current, trail)


def test_back_stack_keeps_the_whole_trail(spark, tmp_path):
    keys = [f"k{i}" for i in range(2_500)]
    rows = spark.range(2_500).selectExpr("1L AS user_id", "concat('k', id) AS key", "timestamp_ntz'2024-01-01 00:00:00' AS ts", "id AS event_id")
    rows.write.parquet(str(tmp_path / "many"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "many"))
    (row,) = run(streams.back_stack_stream(stream), "update", tmp_path, "whole")
    assert (row["current"], list(row["trail"])) == (keys[-1], keys[:-1])
    (row,) = run(streams.back_stack_stream(stream, depth=3), "update", tmp_path, "cut")
    assert list(row["trail"]) == keys[-4:-1]


def test_windows(spark, tmp_path, events):
    settled = run(streams.settled_stream(events, "1 hour"), "append", tmp_path, "settled")
    counts = run(streams.counts_stream(events), "append", tmp_path, "counts")
    assert 0 < len(settled) <= 1000 and 0 < sum(r["n"] for r in counts) <= 1000


def test_streams_over_several_batches(spark, tmp_path):
    """One file a batch, in order of time: what the batch operators give over all files."""
    rows = spark.read.parquet(f"{DATA}/events.parquet").selectExpr("user_id", "concat(event_type, event_id % 3) AS key", "ts", "event_id")
    for since, day in (("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2025-01-01")):
        rows.where(f"ts >= '{since}' AND ts < '{day}'").coalesce(1).write.mode("append").parquet(str(tmp_path / "days"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "days"))
    steps = streams.run_once(streams.back_steps_stream(stream, "signup0", "error1"), f"file://{tmp_path}/steps")
    assert steps.select("batch").distinct().count() == 3
    want = sequences.back_stack(rows, "signup0", "error1")
    assert sorted(map(tuple, steps.drop("batch").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    states = streams.run_once(streams.recent_stream(stream, 4), f"file://{tmp_path}/recent", "update")
    last = {r["user_id"]: r["keys"] for r in sorted(states.collect(), key=lambda r: r["batch"])}
    want = {}
    for r in activity.recent(rows, 4).orderBy("user_id", "place").collect():
        want.setdefault(r["user_id"], []).append(r["key"])
    assert last == want
