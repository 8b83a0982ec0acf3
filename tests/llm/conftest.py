from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h bigint, _size string"
LINE = "the quick brown fox jumps over the lazy dog and it was not in a hurry to be there"
LONG = " ".join(f"w{i % 977} of the {i % 13}" for i in range(3_000))
TEXTS = [None, "", "  \n\t ", "a", "one two three four", LINE, LINE, f"{LINE} ", "\n".join([LINE] * 20), LONG, "x" * 20_000, "中文字符。" * 4_000, "é#*$%&|<>\x0b\x85 　z\r\n<s> </s> <|endoftext|>", " ".join([LINE] * 3 + [str(i) for i in range(60)]), "a b " * 1_500]
MARKED = [
    "<P>x", "a<S>b", "c<M>", "ends in <", "<S<P <M< 中<<", "Licensed under CC BY-NC 4.0. All rights reserved", "cc by cc by general public license all rights",
    " ".join(["released under the MIT license x y z"] * 400), "filler " * 15 + "This work is licensed under the GNU General Public License, version 3." + " filler" * 40,
]


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """A folder whose documents have nulls in every column, empty and very long texts, copies and clashing names."""
    folder = tmp_path_factory.mktemp("odd")
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else f"s{i % 2}", None, 1, "x") for i, t in enumerate(TEXTS)]
    rows += [(200 + i, t, "en", None, 1, 1, "x") for i, t in enumerate(MARKED)]
    rows += [(5, LINE, "en", "s1", 1, 1, "x"), (100, LINE.replace("quick", "slow"), None, "s0", 1, 1, None)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    vectors = [(i, [float((i * j) % 7 - 3) / 4 for j in range(1, 9)], 0) for i in range(0, 120, 3)]
    vectors += [(50, None, 0), (150, [None] * 8, 1), (100, [float("nan")] * 8, 1), (200, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (250, [0.0] * 8, 1), (300, [1.0, 2.0], 0), (301, [1.0, 2.0], 0), (300, [1.0, 2.0], 0), (350, [], 0)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    items = [(0, LINE), (1, "of the 3 w7 中文字符 nothing"), (1, "of the"), (2, None), (3, ""), (None, "A b a"), (4, "!?"), (0, LINE)]
    spark.createDataFrame([(*x, "y") for x in items], "item_id bigint, text string, score string").write.parquet(f"{folder}/benchmark.parquet")
    talk = [(1, 0, "user", "User: hi\nthere?"), (1, 1, "assistant", None), (1, 1, None, "x"), (None, None, "user", ""), (2, 5, "system", "a\n\nb" * 200), (2, 6, "user", "Human: q?"), (2, 6, "user", "Human: q?")]
    spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def nameless(spark, odd, tmp_path_factory):
    """The odd tables, with documents without an id too."""
    folder = tmp_path_factory.mktemp("nameless")
    more = spark.createDataFrame([(None, t, None, None, None, None, None) for t in (LINE, None, MARKED[0], LINE)], DOCS)
    spark.read.parquet(f"{odd}/documents.parquet").unionByName(more).write.parquet(f"{folder}/documents.parquet")
    for name in ("benchmark", "embeddings", "conversations"):
        spark.read.parquet(f"{odd}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", DOCS), ("benchmark", "item_id bigint, text string"), ("embeddings", "vec_id bigint, embedding array<float>, label int"), ("conversations", "conv_id bigint, turn bigint, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
