import math

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gaugeframe.functions.categories import TARGET_GROUP_LABELS, labelled
from gaugeframe.operators import cleaning as cln
from tests.helpers import day, rows


def test_lenient_dates_turn_bad_text_into_null(spark):
    df = spark.createDataFrame([("2024-02-29",), ("2023-02-29",), ("soon",), (None,), ("2024-01-05 13:00:00",)], "d string")
    assert [r.d for r in cln.parse_dates(df, "d").collect()] == [day("2024-02-29"), None, None, None, day("2024-01-05")]
    mixed = spark.createDataFrame([("05/01/2024",), ("2024-01-06",), ("x",)], "d string")
    parsed = cln.parse_dates(mixed, "d", ["yyyy-MM-dd", "dd/MM/yyyy"])
    assert [r.d for r in parsed.collect()] == [day("2024-01-05"), day("2024-01-06"), None]


def test_strict_dates_stop_on_bad_text(spark):
    good = spark.createDataFrame([("2024-02-29",)], "d string")
    assert cln.parse_dates_strict(good, "d").first().d == day("2024-02-29")
    with pytest.raises(PySparkException):
        cln.parse_dates_strict(spark.createDataFrame([("2023-02-29",)], "d string"), "d").collect()


def test_nan_becomes_null_and_names_with_spaces_work(spark):
    df = spark.createDataFrame([(1.0, math.nan), (math.nan, 2.0)], "a double, `Wind Speed` double")
    assert rows(cln.nan_to_null(df)) == [(1.0, None), (None, 2.0)]


def test_fill_constant_touches_only_listed_columns(spark):
    df = spark.createDataFrame([(None, None), (1.0, 2.0)], "a double, b double")
    assert set(rows(cln.fill_constant(df, ["a"]))) == {(0.0, None), (1.0, 2.0)}


def test_fill_medians_is_exact_and_leaves_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (2.0, None), (10.0, None), (11.0, None)], "a double, b double")
    assert sorted(r.a for r in cln.fill_medians(df, ["a", "b"]).collect()) == [1.0, 2.0, 6.0, 10.0, 11.0]
    assert {r.b for r in cln.fill_medians(df, ["a", "b"]).collect()} == {None}


def test_fill_forward_then_back(spark):
    data = [("x", 1, None), ("x", 2, 5.0), ("x", 3, None), ("y", 1, 7.0), ("y", 2, None), ("z", 1, None)]
    df = spark.createDataFrame(data, "k string, i int, v double")
    filled = cln.fill_forward_back(df, "v", ["i"], ["k"])
    assert rows(filled, "k", "i") == [("x", 1, 5.0), ("x", 2, 5.0), ("x", 3, 5.0), ("y", 1, 7.0), ("y", 2, 7.0), ("z", 1, None)]


def test_fill_carries_over_many_chunks_of_one_large_key(spark):
    # One key holds nearly all rows, known values are far apart: the carry crosses chunks.
    df = spark.range(20_000).select(
        "id", F.when(F.col("id") < 19_990, "big").otherwise("small").alias("k"),
        F.when(F.col("id") % 9_000 == 4_000, F.col("id").cast("double")).alias("v"),
    )
    got = {r.id: r.v for r in cln.fill_forward_back(df, "v", ["id"], ["k"]).collect()}
    for i in range(19_990):
        assert got[i] == (4000.0 if i < 13_000 else 13_000.0)
    assert all(got[i] is None for i in range(19_990, 20_000))


def test_fill_with_missing_key(spark):
    df = spark.createDataFrame([(None, 1, 3.0), (None, 2, None), ("a", 1, None), ("a", 2, 4.0)], "k string, i int, v double")
    assert {(r.k, r.i, r.v) for r in cln.fill_forward_back(df, "v", ["i"], ["k"]).collect()} == {
        (None, 1, 3.0), (None, 2, 3.0), ("a", 1, 4.0), ("a", 2, 4.0)}


def test_labels_keep_unknown_and_missing_codes(spark):
    df = spark.createDataFrame([("hcw",), ("unmapped",), (None,)], "c string")
    assert [r.l for r in df.select(labelled(F.col("c"), TARGET_GROUP_LABELS).alias("l")).collect()] == ["Health & care workers", "unmapped", None]
    lookup = spark.createDataFrame(list(TARGET_GROUP_LABELS.items()), "code string, text string")
    joined = cln.label_codes_by_table(df, "c", "l", lookup, "code", "text")
    assert set(rows(joined)) == {("hcw", "Health & care workers"), ("unmapped", "unmapped"), (None, None)}
