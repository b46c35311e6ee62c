import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import aggregation as agg
from gaugeframe.operators import comparison as cmp
from gaugeframe.operators import latest as lat
from tests.helpers import day, plan_of, rows

SCHEMA = "Date_reported date, Country string, WHO_region string, New_cases double, Cumulative_cases double, Cumulative_deaths double"
D1, D2 = day("2021-01-01"), day("2021-01-02")
DATA = [
    (D1, "France", "EURO", 5.0, 500.0, 10.0), (D2, "France", "EURO", None, 1000.0, 20.0),
    (D1, "Poland", "EURO", 7.0, 600.0, 60.0), (D2, "Poland", "EURO", 1.0, 999.0, 70.0),
    (D1, "Mali", "AFRO", None, 0.0, 0.0), (D2, "Mali", "AFRO", None, 0.0, 5.0),
    (D2, "Nowhere", None, 3.0, 2000.0, 200.0), (D2, None, "AFRO", 9.0, 10.0, 1.0),
]


@pytest.fixture
def cases(spark):
    return spark.createDataFrame(DATA, SCHEMA)


def test_sums_of_missing_values_and_keys(spark, cases):
    assert rows(agg.sum_by(cases, ["Country"], "New_cases")) == [("France", 5.0), ("Mali", 0.0), ("Nowhere", 3.0), ("Poland", 8.0)]
    assert rows(agg.known_sum_by(cases, ["Country"], "New_cases")) == [("France", 5.0), ("Mali", None), ("Nowhere", 3.0), ("Poland", 8.0)]


def test_threshold_is_inclusive(cases):
    got = agg.metric_over_time(cases, "Fatality_rate", "Date_reported", "Country").select("Country", "Date_reported", "Fatality_rate")
    assert rows(got) == [("France", D2, 2.0), ("Nowhere", D2, 10.0)]


def test_split_regions_add_up_to_the_total(cases):
    names = ["West Europe", "East Europe"]
    split = agg.region_over_time(cases, "New_cases", names, "WHO_region", "Country", "Date_reported")
    assert {r.WHO_region for r in split.collect()} == {"West Europe", "East Europe", "AFRO", "nan"}
    per_date = {r.Date_reported: r.n for r in split.groupBy("Date_reported").agg(F.sum("New_cases").alias("n")).collect()}
    assert per_date == {r.Date_reported: r.New_cases for r in agg.metric_over_time(cases, "New_cases", "Date_reported").collect()}
    rate = agg.region_over_time(cases, "Fatality_rate", names, "WHO_region", "Country", "Date_reported")
    assert {(r.WHO_region, r.Fatality_rate) for r in rate.collect()} == {("West Europe", 2.0), ("nan", 10.0)}


def test_latest_rows_ties_and_rankings(spark):
    df = spark.createDataFrame([("r", "b", D2, 1.0), ("r", "a", D2, 2.0), ("r", "c", D1, 3.0), ("s", "d", None, 4.0), ("s", "e", D1, None), (None, "f", D2, 9.0)],
                               "k string, n string, d date, v double")
    assert rows(lat.latest_per_key(df, ["k"], "d", ["n"]).select("k", "n")) == [("r", "a"), ("s", "e")]
    assert rows(lat.latest_known_per_key(df, ["k"], "d", "v", ["n"]).select("k", "n")) == [("r", "a"), ("s", "d")]
    names = spark.createDataFrame([("x", 1.0), ("y", 5.0), ("z", 5.0), ("w", None)], "n string, v double")
    assert [r.n for r in lat.top(names, "v", "n", 2).collect()] == ["z", "y"]
    assert [r.n for r in lat.top(names, "v", "n", 9).collect()] == ["x", "z", "y", "w"]
    assert lat.ranking_metric("New_cases") == "Cumulative_cases" and lat.ranking_metric("New_deaths") == "Cumulative_deaths"


def test_top_ratio_drops_rows_below_the_threshold(cases):
    assert [tuple(r) for r in lat.top_latest(cases, "Fatality_rate", 5, "Country", "Date_reported").collect()] == [("France", 2.0), ("Nowhere", 10.0)]


def test_figures(spark, cases):
    latest = lat.latest_per_key(cases, ["Country"], "Date_reported")
    assert tuple(lat.surveillance_figures(latest).first()) == (3999, 295, pytest.approx(295 / 3999 * 100))
    assert tuple(lat.surveillance_figures(latest.where("false")).first()) == (0, 0, 0.0)


def test_weighted_plain_and_empty_means(spark):
    schema = "d date, c double, p bigint"
    data = [(D1, 10.0, 1), (D1, 40.0, 3), (D1, 99.0, None), (D2, 5.0, None), (D2, None, 4)]
    df = spark.createDataFrame(data, schema)
    assert rows(agg.weighted_or_plain_mean_by(df, ["d"], "c", "p")) == [(D1, 32.5)]
    assert rows(agg.weighted_mean_by(df, ["d"], "c", "p")) == [(D1, 32.5)]
    plain = df.withColumn("p", F.lit(None).cast("bigint"))
    assert rows(agg.weighted_or_plain_mean_by(plain, ["d"], "c", "p")) == [(D1, pytest.approx(149 / 3)), (D2, 5.0)]
    assert rows(agg.weighted_or_plain_mean_by(df.withColumn("c", F.lit(None).cast("double")), ["d"], "c", "p")) == []
    zero = spark.createDataFrame([(D1, 10.0, 0)], schema)
    assert rows(agg.weighted_or_plain_mean_by(zero, ["d"], "c", "p")) == [(D1, None)]


def test_correlations_equal_pandas_with_missing_values(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.normal(size=(80, 3)), columns=list("abc"))
    pdf["k"] = 1.0
    pdf.loc[::5, "a"] = None
    pdf.loc[1::7, "b"] = None
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, b double, c double, k double")
    expected = pdf.corr()
    got = {(r.variable, r.other): r.correlation for r in agg.correlation_matrix(df, list("abck")).collect()}
    assert len(got) == 16
    for (x, y), value in got.items():
        assert (value is None and np.isnan(expected.loc[x, y])) or value == pytest.approx(expected.loc[x, y], rel=1e-9)


def test_correlations_of_sixty_columns_with_large_means(spark):
    """One pass, any partitioning: means of a thousand millions over a spread of one, columns that are constant where the other is known."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4000, 1))
    x = 1e9 + base * rng.normal(size=(1, 60)) + rng.normal(size=(4000, 60))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 58] = np.where(np.arange(4000) < 10, 3.25, np.nan)
    x[:10, 57] = 0.1
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(60)])
    df = spark.createDataFrame(pdf)
    expected = pdf.corr()
    expected.loc["c57", "c58"] = expected.loc["c58", "c57"] = np.nan
    for parts in (1, 7):
        got = agg.correlation_matrix(df.repartition(parts), list(pdf.columns)).collect()
        assert len(got) == 3600
        for variable, other, value in got:
            want = expected.loc[variable, other]
            assert (value is None and np.isnan(want)) or value == pytest.approx(want, abs=2e-7)
    plan = plan_of(agg.correlation_matrix(df, list(pdf.columns)))
    assert plan.count("MapInArrow") == 2


def test_correlations_of_an_empty_table_and_of_long_columns(spark):
    df = spark.createDataFrame([], "a long, b double")
    assert {tuple(r) for r in agg.correlation_matrix(df, ["a", "b"]).collect()} == {(x, y, None) for x in "ab" for y in "ab"}
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (None, 5.0), (4, float("nan"))], "a long, b double")
    assert {(r.variable, r.other): r.correlation for r in agg.correlation_matrix(df, ["a", "b"]).collect()}["a", "b"] == pytest.approx(1)


def test_histogram_equals_numpy(spark):
    values = [0.0, 0.1, 1.0, 9.99, 10.0, 10.0, 5.0]
    counts, edges = np.histogram(values, bins=20)
    got = agg.histogram(spark.createDataFrame([(v,) for v in [*values, None]], "x double"), "x").orderBy("bin").collect()
    assert [r["count"] for r in got] == counts.tolist()
    assert np.allclose([r["lower"] for r in got] + [got[-1]["upper"]], edges)
    single = agg.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), "x").collect()
    assert sum(r["count"] for r in single) == 2 and len(single) == 20


def test_maxima_extremes_and_first(spark):
    df = spark.createDataFrame([(1, "cake", 4), (2, "ice", 5), (3, "biscuit", 5), (4, "none", None)], "i int, n string, r int")
    assert tuple(agg.row_of_maximum(df, "r", ["n"], "i").first()) == ("ice",)
    assert [r.r_is_max for r in agg.highlight_maxima(df, ["r"]).orderBy("i").collect()] == [False, True, True, False]
    assert tuple(agg.leader(df, "n", "r").first()) == ("biscuit", 5)
    assert tuple(agg.extremes(df.dropna(), "n", "r").first()) == ("biscuit", "cake")
    assert tuple(agg.mean_and_first(df, "r", ["i"]).first()) == (pytest.approx(14 / 3), 4)


def test_value_counts_and_semi_join(spark, cases):
    counts = agg.value_counts(cases, "WHO_region")
    assert [tuple(r) for r in counts.collect()] == [("EURO", 4), ("AFRO", 3)]
    assert [r.WHO_region for r in agg.value_counts(cases, "WHO_region", by="value").collect()] == ["AFRO", "EURO"]
    kept = agg.in_same_group(cases, "WHO_region", "Country", ["France", "Nowhere"])
    assert {r.Country for r in kept.collect()} == {"France", "Poland"}


def test_zscores_of_a_constant_column_are_zero(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert [(r.zscore, r.anomaly) for r in agg.zscores(df, "v").collect()] == [(0.0, False), (0.0, False), (None, False)]


def test_normalised_values_and_zero_maximum(spark, cases):
    got = cmp.normalised(cases.dropna(subset=["Country"]), "Country", "Cumulative_cases").collect()
    assert all(0 <= r.normalised <= 1 for r in got)
    assert {r.normalised for r in got if r.Country == "Mali"} == {0.0}


def test_map_tables(cases):
    latest = lat.latest_per_key(cases, ["Country"], "Date_reported")
    bubbles = {r.Country: (r.Fatality_rate, r.Fatality_rate_plot) for r in cmp.bubble_map(latest, "Country").collect()}
    assert bubbles == {"France": (2.0, 2.0), "Poland": (0.0, 0.0), "Mali": (0.0, 0.0), "Nowhere": (10.0, 5.0)}
    scatter = cmp.member_scatter(latest, ["West Europe"], ["France"], "WHO_region", "Country")
    assert rows(scatter.select("Country", "Region_group", "Highlight")) == [("France", "West Europe", "Selected"), ("Nowhere", "nan", "Other")]
    regions = cmp.region_scatter(latest, ["West Europe"], ["France", "Mali"], "WHO_region", "Country")
    assert rows(regions.select("Region_group", "Cumulative_cases", "Highlight", "Size")) == [
        ("EURO", 999.0, "Other", 10), ("West Europe", 1000.0, "Selected", 18), ("nan", 2000.0, "Other", 10)]
    plain = cmp.region_scatter(latest, [], [], "WHO_region", "Country")
    assert "Highlight" not in plain.columns and plain.count() == 2


def test_two_regions_by_last_row_and_summed(cases):
    one = cmp.latest_summary(cases, "WHO_region", "Date_reported", ["Country"])
    assert {(r.WHO_region, r.Cumulative_cases) for r in one.collect()} == {("EURO", 1000.0), ("AFRO", 10.0)}
    summed = cmp.latest_region_summary(cases, "WHO_region", "Country", "Date_reported")
    assert {(r.WHO_region, r.Cumulative_cases, r.Fatality_ratio) for r in summed.collect()} == {
        ("EURO", 1999.0, 90.0 / 1999.0 * 100), ("AFRO", 0.0, 0.0)}
