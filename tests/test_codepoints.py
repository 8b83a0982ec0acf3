import pytest
from pyspark.sql import functions as F

from glyphlake.functions import codepoints as cp
from glyphlake.functions import display, vectors


def values(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string").withColumn("out", f(F.col("s")))
    return [r["out"] for r in sorted(rows.collect())]


def test_normalize_query(spark):
    given = {
        "U+9451": "U+9451", "9451": "U+9451", "face": "U+FACE", "鑑賞": "U+9451", "u9451": "U+0075", "U+zz": None, "U+20000": "U+20000",
        "a": "U+0061", " 𠀀 ": "U+20000", "": None, "  ": None, "U+": None, "abc": "U+0061", "123456789": None, "0000000041": "U+0041",
        "　鑑": "U+9451", "94ZZ": "U+0039", "U+110000": "U+110000", None: None, "u+9451": "U+9451",
    }
    assert dict(zip(given, values(spark, given, cp.normalize_query), strict=True)) == given


def test_characters_of_codepoints(spark):
    given = {"U+9451": "鑑", "U+20000": "𠀀", "U+0041": "A", "9451": "", "U+D800": "", "U+110000": "", "U+ZZ": "", "U+FFFFFFFFF": "", None: "", "U+10FFFF": "\U0010ffff"}
    assert dict(zip(given, values(spark, given, cp.codepoint_char), strict=True)) == given


def test_format(spark):
    assert values(spark, ["65", "131072", "38993"], lambda s: cp.format_codepoint(s.cast("bigint"))) == ["U+0041", "U+20000", "U+9851"]


def test_routes(spark):
    given = {"u9451": True, "U+9451": True, "鑑": True, "𠀀": True, "9451": False, "鑑賞": False, "mirror": False, "": False}
    assert dict(zip(given, values(spark, given, cp.is_codepoint_query), strict=True)) == given
    assert values(spark, ["u9451", "鑑"], cp.routed_query) == ["U+9451", "鑑"]


def test_components(spark):
    assert values(spark, ["⿰金監金a", "", None, "㇯𠀀⿱"], cp.component_names) == [["U+91D1", "U+76E3"], [], [], ["U+20000"]]


def test_display(spark):
    assert values(spark, ['<a & "b">', None], display.escape_html) == ["&lt;a &amp; &quot;b&quot;&gt;", ""]
    assert values(spark, ["ehanja_simple", "ehanja_new", "other"], display.label) == ["간체", "new", "other"]
    assert values(spark, ["0.125", "-0.005"], lambda s: display.percent(s.cast("double"))) == [13, 0]
    assert values(spark, ["1", "6", "7", "9", None], lambda s: display.school_grade(s.cast("int"))) == ["1학년 (교육한자)", "6학년 (교육한자)", "상용한자 (중등)", "인명용한자", None]
    assert values(spark, ["a,b", ",".join("abcdefghij")], lambda s: display.last_items(F.split(s, ","))) == [["a", "b"], list("cdefghij")]
    assert values(spark, ["/x/鑑.png", "b.tar.gz"], display.file_stem)[0] == "鑑"


def test_vectors(spark):
    row = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("v")).select(vectors.norm(F.col("v")), vectors.scaled(F.col("v")), vectors.dot(F.col("v"), F.col("v"))).first()
    assert (row[0], list(row[1]), row[2]) == (5.0, pytest.approx([0.6, 0.8]), 25.0)
