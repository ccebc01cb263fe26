import math
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import numeric as N
from siltstone.functions import seams
from siltstone.functions import text as T

ID = "01890a5d-ac96-774b-bcce-b302099a8057"


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f, value, want",
    [
        (T.basename, "a\\b\\c.txt?x=1#f", "c.txt"),
        (T.basename, "http://h/d/", "d"),
        (T.basename, "/a/?q", "?q"),
        (T.display_name, f"/in/{ID}__name.pdf", "name.pdf"),
        (T.directory, "/a/b/c.txt", "/a/b"),
        (T.directory, "/c.txt", "/"),
        (T.directory, "c.txt", ""),
        (T.stem, "/a/.bashrc", ".bashrc"),
        (T.stem, "/a/B.tar.GZ", "b.tar"),
        (T.base_stem, "/a/Report_v2.txt", "report"),
        (T.base_stem, "/a/Report_summary_v2.txt", "report_summary"),
        (T.base_stem, "/a/강의_3부.mp4", "강의"),
        (T.extension, "/a/b.TXT", "txt"),
        (T.extension, "/a/b.", None),
        (T.extension, "/a/b", None),
        (T.source_dataset, "x/sample_data/data2/f", "data2"),
        (T.source_dataset, "Wikipedia_x", "wikipedia"),
        (T.source_dataset, "x", "unknown"),
        (T.clean_file_name, "youtube_사막_HAi1OZD1OMM_strength.jpg", "youtube 사막 strength"),
        (T.topic_of_filename, f"{ID}__제목_(전통주).svg", "전통주"),
        (T.topic_of_filename, "youtube_사막_x.jpg", "사막"),
        (T.topic_of_filename, "등산_입문.mp4", "등산"),
        (T.tidy_text, "a​  b\t c \r\n\n\n\n d\x07 ", "a b c\n\nd"),
        (T.topic_word, " ,한국 음식. ", "한국"),
        (T.topic_word, "·a·", "a"),
        (T.topic_words_en, "Deep Sea fishing", "deep"),
        (T.topic_words_en, "Deep Sea", "deep sea"),
        (T.usable_kind, " Same_Series ", "same_series"),
        (T.usable_kind, "medical", None),
        (T.usable_kind, "1x", None),
        (T.kind_label, "same_series", "same series"),
        (T.kind_label, "_", "기타"),
        (T.squeeze, "　a \n b ", "a b"),
        (T.nfkc, "①ﬁ", "1fi"),
        (T.casefold, "Straße", "strasse"),
    ],
)
def test_text(spark, f, value, want):
    assert one(spark, f, value) == want


@pytest.mark.parametrize("token, want", [("HAi1OZD1OMM", True), ("strength", False), ("Maintenance", False), ("SAMSUNG", False), ("QWXZBKLMN", True), ("Qi2", False), ("abc-def-ghi", False), ("abcde123", True)])
def test_id_like(spark, token, want):
    assert one(spark, T.is_id_like, token) is want


def test_arrays(spark):
    df = spark.createDataFrame([(["A", " a", "b ", "", None, "영상", "B"], "t", "s"), ([], None, "s")], "k array<string>, t string, s string")
    rows = df.select(T.keywords(F.col("k"), ["영상"]).alias("k"), T.keywords(F.col("k"), limit=1).alias("one"), T.distinct_texts(F.col("k")).alias("d"), T.topic_pair(F.col("t"), F.col("s")).alias("p")).collect()
    assert rows[0] == (["A", "b"], ["A"], ["A", "a", "b", "영상", "B"], "t>s")
    assert rows[1] == ([], [], [], "")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="aB ①ﬀ é\t", max_size=12), min_size=1, max_size=5))
def test_nfkc_is_python_nfkc(spark, texts):
    got = [r.y for r in spark.createDataFrame([(t,) for t in texts], "x string").coalesce(1).select(T.nfkc("x").alias("y")).collect()]
    assert got == [unicodedata.normalize("NFKC", t) for t in texts]


@pytest.mark.parametrize("value, want", [("0.5", 0.5), ("x", 0.0), (None, 0.0), ("NaN", 0.0), ("Infinity", 0.0), ("7", 1.0), ("-1", 0.0)])
def test_confidence(spark, value, want):
    assert one(spark, N.confidence, value) == want


def test_scores(spark):
    assert one(spark, N.cosine_of_score, 0.75, "double") == 0.5
    assert one(spark, N.cosine_of_score, float("nan"), "double") == 0.0
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, float("nan")), (2, 5.0), (2, 5.0)], "g int, x double")
    assert sorted(tuple(r) for r in df.select("g", N.min_max(F.col("x"), "g").alias("y")).collect()) == [(1, 0.0), (1, 1 / 3), (1, 1.0), (2, 1.0), (2, 1.0)]


def test_wilson(spark):
    df = spark.createDataFrame([(0, 69), (5, 10), (0, 0)], "h int, n int").select(N.wilson(F.col("h"), F.col("n")).alias("w"))
    a, b, c = (r.w for r in df.collect())
    assert a.low == 0 and round(a.high, 3) == 0.053
    assert 0 < b.low < 0.5 < b.high < 1
    assert (c.low, c.high) == (0, 1)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(N.cosine(F.col("a"), F.col("b")).alias("c"), N.unit(F.col("a")).alias("u"), N.padded(F.col("a"), 3).alias("p"), N.softmax(F.col("a")).alias("s")).collect()
    assert r[0].c == 0.96 and r[0].u == [0.6, 0.8] and r[0].p == [3, 4, 0] and math.isclose(sum(r[0].s), 1)
    assert r[1].c is None and r[1].u == [0, 0]


def test_nearest_rank_and_bands(spark):
    df = spark.createDataFrame([([float(x) for x in range(1, 21)],), ([],)], "v array<double>")
    assert [r.y for r in df.select(N.nearest_rank(F.col("v"), 0.95).alias("y")).collect()] == [19.0, None]
    assert [one(spark, N.band, x, "double") for x in (0.5, 0.6, 0.9, 0.99, None)] == ["<.60", ".60-.75", ".90-.95", ">=.95", ">=.95"]


def test_seams(spark):
    df = spark.createDataFrame([("a b",), ("",), (None,)], "t string").coalesce(1)
    rows = df.select(seams.embedder()("t").alias("v")).collect()
    assert all(math.isclose(sum(x * x for x in r.v), 1) for r in rows)
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) == 1:
            raise OSError
        return [[1.0]] * len(texts)

    assert [r.v for r in df.select(seams.embedder(flaky)("t").alias("v")).collect()] == [[1.0]] * 3
    with pytest.raises(Exception, match="number of vectors"):
        df.select(seams.embedder(lambda t: [[1.0]])("t").alias("v")).collect()
    assert one(spark, lambda c: seams.pair_scorer()(F.lit("a b"), c), "b c") == 0.5
    assert seams.json_object("[1]") == {} and seams.json_object("x") == {} and seams.json_object('{"a": 1}') == {"a": 1}
    chunks = spark.createDataFrame([(1, 1, "bb"), (1, 0, "aa"), (2, 0, "c")], "asset_id int, chunk_index int, chunk string")
    assert {r.asset_id: r.summary for r in seams.summarise(chunks, str.upper, least=2).collect()} == {1: "AA\nBB", 2: None}
    with pytest.raises(ValueError):
        seams.backend("x")
