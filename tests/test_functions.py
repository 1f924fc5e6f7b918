import pytest
from pyspark.sql import functions as F

from canvass.functions import scales, text
from canvass.functions.jsontext import is_json, scalar_text, string_only, with_json_object
from canvass.functions.stats import pearson


def evaluate(spark, value, function):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(function(F.col("v"))).first()[0]


@pytest.mark.parametrize("value,down,up,top", [
    (None, 0, 0, 3), ("", 0, 0, 3), ("brak", 0, 0, 3), ("1 - Słabo", 1, 1, 3), ("2", 2, 2, 3),
    ("3", 3, 3, 3), ("4", 4, 4, 4), ("5 - Doskonale", 5, 5, 5),
    ("4 lub 5", 5, 4, 5), ("1 lub 5", 5, 1, 5), ("12345", 5, 1, 5),
])
def test_rating_scales(spark, value, down, up, top):
    assert evaluate(spark, value, lambda c: scales.rating(c, scales.DESCENDING)) == down
    assert evaluate(spark, value, lambda c: scales.rating(c, scales.ASCENDING)) == up
    assert evaluate(spark, value, lambda c: scales.rating(c, scales.TOP_TWO)) == top


@pytest.mark.parametrize("value,contains,exact", [
    ("Tak, zdecydowanie", 2, 2), ("Raczej tak", 1, 1), ("Raczej nie", -1, -1), ("Nie", -2, -2),
    ("Nie wiem", -2, 0), (None, 0, 0), ("nie", 0, 0),
])
def test_usefulness(spark, value, contains, exact):
    assert evaluate(spark, value, scales.usefulness) == contains
    assert evaluate(spark, value, lambda c: scales.usefulness(c, "exact")) == exact


@pytest.mark.parametrize("value,score", [
    ("super", 1.0), ("dobre", 1.0), ("świetny", 1.0), ("słaba", -1.0), ("kiepsko", -1.0),
    ("problem", -1.0), ("super, ale problem", 1.0), ("Super", 0.0), ("", 0.0), (None, 0.0),
])
def test_sentiment(spark, value, score):
    assert evaluate(spark, value, scales.sentiment) == score


@pytest.mark.parametrize("value,words", [
    ("a b", 2), ("a  b", 3), ("", 1), (" ", 2), ("zażółć", 1), (None, None), (" a ", 3), ("😀 x", 2),
])
def test_word_count_is_size_of_split(spark, value, words):
    assert evaluate(spark, value, text.word_count) == words
    if value is not None:
        assert evaluate(spark, value, lambda c: F.size(F.split(c, " "))) == words


@pytest.mark.parametrize("value,kept,tail", [
    ("a,b,", ["a", "b", ""], ["a", "b"]), ("", [""], [""]), ("x,,y", ["x", "", "y"], ["x", "", "y"]),
    (",,", ["", "", ""], []), ("a", ["a"], ["a"]), (",a", ["", "a"], ["", "a"]), ("a, ,", ["a", " ", ""], ["a", " "]),
])
def test_splits(spark, value, kept, tail):
    assert evaluate(spark, value, text.split_options) == kept
    assert evaluate(spark, value, text.split_options_trimmed_tail) == tail


def test_trims(spark):
    assert evaluate(spark, "\t x\n", F.trim) == "\t x\n"
    assert evaluate(spark, "\t x\n\x01", text.trim_controls) == "x"


@pytest.mark.parametrize("value,query,hit", [
    ("The quick fox", "QUICK", True), ("quicker", "quick", False), ("a quick", "slow quick", True),
    ("a", "", True), ("a", "!!!", False), ("żółw-1", "żółw", True), (None, "a", False), ("v1_x", "v1", True),
])
def test_term_match(spark, value, query, hit):
    assert evaluate(spark, value, lambda c: text.matches_any(c, query)) is hit


def test_half_up(spark):
    rows = [(0.25,), (2.449,), (2.45,), (3.0,), (0.0,)]
    df = spark.createDataFrame(rows, "x double").select(scales.half_up_1(F.col("x")))
    assert [r[0] for r in df.collect()] == [0.3, 2.4, 2.5, 3.0, 0.0]


@pytest.mark.parametrize("value,is_object,valid", [
    ("{}", True, True), ('{"a":1}', True, True), ('{"a":1} x', False, False), ('{"a":1}{"a":2}', False, False),
    ('{"a":1},{"a":2}', False, False), ("[1]", False, True), ("5", False, True), ("null", False, True),
    ('"s"', False, True), ("oops", False, False), ('{"a":', False, False), ("", False, False),
    ("{'a':1}", False, False), (" {} ", True, True),
])
def test_json_objects(spark, value, is_object, valid):
    df = spark.createDataFrame([(value,)], "v string")
    row = with_json_object(df, "o", F.col("v"), "a: variant").withColumn(
        "valid", F.coalesce(is_json(F.col("v")), F.lit(False))).first()
    assert (row["o"] is not None) is is_object
    assert row["valid"] is valid or is_object


@pytest.mark.parametrize("value,scalar,string", [
    ('{"a":"x"}', "x", "x"), ('{"a":5}', "5", None), ('{"a":true}', "true", None), ('{"a":1.5}', "1.5", None),
    ('{"a":[1]}', None, None), ('{"a":{"b":1}}', None, None), ('{"a":null}', None, None), ("{}", None, None),
    ('{"a":"x","a":"y"}', "y", "y"), ('{"a":"[1]"}', "[1]", "[1]"),
])
def test_json_values(spark, value, scalar, string):
    df = spark.createDataFrame([(value,)], "v string")
    row = with_json_object(df, "o", F.col("v"), "a: variant").select(
        scalar_text(F.col("o.a")), string_only(F.col("o.a"))).first()
    assert tuple(row) == (scalar, string)


@pytest.mark.parametrize("rows,expected", [
    ([], None), ([(1, 2)], None), ([(1, 2), (1, 5), (1, 3)], None),
    ([(1, 2), (2, 4), (3, 6)], 1.0), ([(1, 3), (2, 2), (3, 1)], -1.0),
    ([(1, 2), (2, 4), (3, 5), (9, None)], 0.98198), ([(1, 2), (2, 4), (3, 5), (None, 7), (None, None)], 0.98198),
    ([(1, None), (None, 2)], None),
])
def test_pearson(spark, rows, expected):
    value = spark.createDataFrame(rows, "x int, y int").agg(pearson("x", "y")).first()[0]
    assert value is None if expected is None else value == pytest.approx(expected)
