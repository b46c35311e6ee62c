import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import ordered
from gaugeframe.operators import profiling as prf
from gaugeframe.operators import selection as sel
from gaugeframe.operators import percentiles as pct
from gaugeframe.operators.percentiles import exact_percentiles
from tests.helpers import day, rows


def test_describe_equals_pandas(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"a": rng.normal(size=501), "b": rng.integers(0, 5, 501).astype(float), "c": np.arange(501.0)})
    pdf.loc[::7, "a"] = None
    expected = pdf.describe().T
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double")
    for r in prf.describe(df).collect():
        e = expected.loc[r["column"]]
        got = [r["count"], r["mean"], r["std"], r["min"], r["p25"], r["p50"], r["p75"], r["max"]]
        assert np.allclose(got, e.to_numpy(), rtol=1e-12)


@pytest.mark.parametrize("keep", [1_000_000, 40, 1])
def test_percentiles_of_few_rows_and_of_a_dominant_value(spark, keep):
    df = spark.createDataFrame([(1.0, 7.0, None), (4.0, None, None)], "a double, b double, e double")
    got = {(r["column"], r["probability"]): r["value"] for r in exact_percentiles(df, ["a", "b", "e"], [0.25, 0.5, 1.0], keep).collect()}
    assert got == {("a", 0.25): 1.75, ("a", 0.5): 2.5, ("a", 1.0): 4.0, ("b", 0.25): 7.0, ("b", 0.5): 7.0, ("b", 1.0): 7.0,
                   ("e", 0.25): None, ("e", 0.5): None, ("e", 1.0): None}
    hot = spark.range(9_000).select(F.when(F.col("id") % 3 == 0, F.lit(0.5)).otherwise(F.col("id").cast("double")).alias("x"))
    values = np.array([0.5 if i % 3 == 0 else float(i) for i in range(9_000)])
    for r in exact_percentiles(hot, ["x"], [0.1, 0.25, 0.34, 0.9], keep).collect():
        assert r["value"] == pytest.approx(np.quantile(values, r["probability"]), rel=1e-12)


@pytest.mark.parametrize("keep", [1_000_000, 300])
def test_percentiles_of_a_million_skewed_values_in_several_columns(spark, keep):
    x = F.xxhash64("id") % 1_000_000 / 1e6
    df = spark.range(1_000_000).select(
        F.exp(20 * x).alias("wide"), F.round(x * 3).alias("few"), F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).when(F.col("id") % 5 > 0, x).alias("gaps"))
    pdf = df.toPandas()
    probabilities = [0.0, 0.001, 0.25, 0.5, 0.7501, 0.999, 1.0]
    for r in exact_percentiles(df, ["wide", "few", "gaps"], probabilities, keep).collect():
        assert r["value"] == pytest.approx(np.quantile(pdf[r["column"]].dropna().to_numpy(), r["probability"]), rel=1e-12)


def test_wrong_brackets_are_mended_by_the_counts(spark, monkeypatch):
    """Whatever the sketch's quantiles, the counts decide: first brackets on the wrong side, too narrow, or the whole range."""
    df = spark.range(5_000).select((F.col("id") % 1_777).cast("double").alias("x"))
    values = np.arange(5_000) % 1_777
    right = pct._bracket
    for low, high, keep in ((0, 0, 1_000_000), (pct.STEPS, pct.STEPS, 20), (0, pct.STEPS, 20), (3, 4, 1_000_000)):
        calls = []

        def wrong(found, rank, a=low, b=high, calls=calls):
            calls.append(rank)
            return right(found, rank) if len(calls) > 3 else (found.quantiles[a], found.quantiles[b])

        monkeypatch.setattr(pct, "_bracket", wrong)
        for r in exact_percentiles(df, ["x"], [0.1, 0.5, 0.99], keep).collect():
            assert r["value"] == pytest.approx(np.quantile(values, r["probability"]), rel=1e-12)


def test_only_values_inside_brackets_are_shuffled(spark):
    df = spark.range(300_000).select((F.xxhash64("id") % 10**12).cast("double").alias("x"))
    found, _ = pct.look(df, [pct.Interval("x")])
    found = found[pct.Interval("x")]
    low, high = pct._bracket(found, 150_000)
    parts = pct.count_inside(df, {"x": [(low, high)]}, 10**6)
    assert len(parts["x", 0]) == len(parts["x", 2]) == 1 and 0 < len(parts["x", 1]) < 0.01 * 300_000


def test_describe_of_dates_and_of_text(spark):
    df = spark.createDataFrame([(day("2024-01-01"), "b"), (day("2024-01-03"), "a"), (None, None), (day("2024-01-05"), "b")], "d date, t string")
    r = prf.describe_dates(df).first()
    assert (r["count"], str(r["mean"]), str(r["p25"]), str(r["max"])) == (3, "2024-01-03 00:00:00", "2024-01-02 00:00:00", "2024-01-05 00:00:00")
    assert rows(prf.describe_text(df)) == [("t", 3, 2, "b", 2)]
    assert rows(prf.summary(df.select("t"))) == [("t", 3, 2, "b", 2)]
    both = {r["column"]: r for r in prf.summary(df.withColumn("n", F.lit(2))).collect()}
    assert set(both) == {"d", "n"} and both["n"]["p50"] == "2.0000" and both["d"]["max"] == "2024-01-05 00:00:00" and both["d"]["std"] is None


def test_choices_and_extents(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("a", 4)], "k string, v int")
    assert {r.k for r in prf.distinct_values(df, "k").collect()} == {"a", "b", None}
    assert [r.k for r in prf.choices(df, "k").collect()] == ["a", "b"]
    assert [r.k for r in prf.choices(df, "k", "All").collect()] == ["All", "a", "b"]
    assert [r.k for r in prf.dependent_choices(df, "k", F.col("v") > 1).collect()] == ["a"]
    assert [r.k for r in prf.dependent_choices(df, "k").collect()] == ["a", "b"]
    assert tuple(prf.extent(df, "v").first()) == (1, 4)
    assert prf.distinct_count(df, "k").first()[0] == 2
    assert prf.distinct_count(df, "k", 0.05).first()[0] == 2
    assert tuple(prf.shape(df).first()) == (4, 2)
    assert [r.v for r in prf.preview(df, ["v"], 2).collect()] == [1, 2]


def test_filters(spark):
    df = spark.createDataFrame([("a", day("2020-01-01")), ("b", day("2020-12-31")), (None, day("2021-01-01")), ("a", None)], "k string, d date")
    assert sel.where_equal(df, {"k": "All"}).count() == 4
    assert sel.where_equal(df, {"k": "a"}).count() == 2
    assert sel.in_period(df, "d", sel.year_range(2020, 2020)).count() == 2
    assert sel.in_period(df, "d", ("2020-01-01", "2021-01-01"), {"k": []}).count() == 3
    assert sel.in_period(df, "d", ("2020-01-01", "2021-01-01"), {"k": ["a", "b"]}).count() == 2
    assert [r.d for r in sel.snapshot(df, "d").collect()] == [day("2021-01-01")]
    assert sel.snapshot(df, "d", "2020-01-01").count() == 1
    assert rows(sel.present_members(df, "k", ["a", "z"])) == [("a",)]
    with pytest.raises(ValueError, match="no column 'ID'"):
        sel.where_equal(df, {"ID": 3})
    with pytest.raises(ValueError, match="two different"):
        sel.two_entities(df, "k", ["a", "a"], "d", ("2020-01-01", "2020-12-31"))


def test_ordinal_over_the_table_and_per_key(spark):
    df = spark.range(5_000).select((F.lit(10_000) - F.col("id")).alias("o"), (F.col("id") % 3 == 0).alias("k"))
    for chunk_rows in (300, 10_000):
        whole = [r.ordinal for r in ordered.with_ordinal(df, ["o"], chunk_rows=chunk_rows).orderBy("o").collect()]
        assert whole == list(range(5_000))
    assert ordered.in_chunks(df, [], ["o"], 300).select(ordered.CHUNK).distinct().count() > 10
    for key, size in ((True, 1667), (False, 3333)):
        got = ordered.with_ordinal(df, ["o"], ["k"], chunk_rows=400).where(F.col("k") == key).orderBy("o").collect()
        assert [r.ordinal for r in got] == list(range(size))
