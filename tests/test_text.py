import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.functions import text as t


def one(spark, expr, **columns):
    df = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} string" for c in columns)) if columns else spark.range(1)
    return df.select(expr.alias("v")).first()[0]


def test_normalize_ws_composes_and_squeezes(spark):
    nfd = unicodedata.normalize("NFD", "Điều  khoản\n thẻ ")
    assert one(spark, t.normalize_ws(F.col("x")), x=nfd) == "Điều khoản thẻ"


def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("  \n",)], "x string")
    rows = df.select(t.squeeze(F.col("x")), t.squash(F.col("x")), t.content_tokens(F.col("x")), t.vietnamese_ratio(F.col("x")), t.urls(F.col("x"))).collect()
    assert all(tuple(r) == ("", "", [], 0.0, []) for r in rows)


def test_fold_drops_marks_and_bars(spark):
    assert one(spark, t.fold(F.col("x")), x="Đường phố Hồ Chí Minh") == "Duong pho Ho Chi Minh"
    assert one(spark, t.fold(F.col("x")), x=unicodedata.normalize("NFD", "thẻ đỏ")) == "the do"


@settings(max_examples=20, deadline=None)
@given(st.text(alphabet="aăâbđeêiơưáàảãạ \n\t", max_size=40))
def test_fold_agrees_with_decomposition(spark, x):
    bare = "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)).replace("đ", "d")
    assert one(spark, t.fold(F.col("x")), x=x) == bare


def test_answer_cell(spark):
    assert one(spark, t.answer_cell(F.col("x")), x="  Không có  trong kho văn bản. ") == "không có trong kho văn bản"


def test_clip_marks_what_it_cuts(spark):
    assert one(spark, t.clip(F.col("x"), 4), x="abc ef") == "abc\n" + t.TRUNCATED
    assert one(spark, t.clip(F.col("x"), 6), x="abc ef") == "abc ef"


def test_windows_are_even(spark):
    words = [f"w{i}" for i in range(40)]
    got = one(spark, t.windows(F.col("x"), 8, 24), x=" ".join(words))
    n = 40 - 8 + 1
    assert got == [" ".join(words[int(i * n / 24) : int(i * n / 24) + 8]) for i in range(24)]
    assert one(spark, t.windows(F.col("x"), 8, 24), x="a b") == ["a b"]


def test_urls_keep_order_and_are_distinct(spark):
    cell = "http://a.vn/x.\n\nhttps://b.vn/y?z=1, http://a.vn/x"
    assert one(spark, t.urls(F.col("x")), x=cell) == ["http://a.vn/x", "https://b.vn/y?z=1"]


def test_looks_reversed(spark):
    assert one(spark, t.looks_reversed(F.col("x")), x="\n".join(["abcd "] * 100))
    assert not one(spark, t.looks_reversed(F.col("x")), x="a line that is long enough to be one\n" * 20)


def test_notes_round_trip(spark):
    notes = t.notes_text({"a": F.lit("1(x=2)"), "b": F.lit(None).cast("string"), "c": F.lit("z")})
    assert one(spark, t.notes_map(notes)) == {"a": "1(x=2)", "c": "z"}
    assert one(spark, t.notes_map(F.lit("a=1; a=2; junk"))) == {"a": "2"}


def test_let_computes_once_and_binds(spark):
    assert one(spark, t.let(F.lit(3), lambda x: x * x + x)) == 12
