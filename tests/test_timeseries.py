import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeframe.operators import timeseries as tser
from tests.helpers import day, rows

PANDAS_RULES = {"D": "D", "W": "W", "M": "ME", "Q": "QE", "Y": "YE"}
RAW = [("2021-11-30", 1.0), ("2022-01-02", 2.0), ("2022-01-03", None), ("2022-04-30", 4.0), ("2022-04-01", 0.5), ("2024-02-29", 3.0), (None, 9.0)]


@pytest.mark.parametrize("rule", PANDAS_RULES)
@pytest.mark.parametrize("how", ["sum", "mean"])
def test_resample_equals_pandas(spark, rule, how):
    df = spark.createDataFrame([(d and day(d), y) for d, y in RAW], "d date, v double")
    got = [(r.ds, r.y) for r in tser.resample(df, "d", "v", rule, how).orderBy("ds").collect()]
    pdf = pd.DataFrame(RAW, columns=["d", "v"]).dropna(subset=["d"])
    expected = pdf.assign(d=pd.to_datetime(pdf.d)).set_index("d")["v"].resample(PANDAS_RULES[rule]).agg(how)
    assert [g[0] for g in got] == [d.date() for d in expected.index]
    assert np.allclose([np.nan if g[1] is None else g[1] for g in got], expected.to_numpy(), equal_nan=True)


def test_resample_keeps_each_series_to_its_own_extent(spark):
    data = [("a", day("2021-01-15"), 1.0), ("a", day("2021-03-01"), 2.0), ("b", day("2021-05-05"), 3.0), (None, day("2021-05-05"), 4.0)]
    df = spark.createDataFrame(data, "k string, d date, v double")
    assert rows(tser.resample(df, "d", "v", "M", keys=["k"])) == [
        ("a", day("2021-01-31"), 1.0), ("a", day("2021-02-28"), 0.0), ("a", day("2021-03-31"), 2.0), ("b", day("2021-05-31"), 3.0)]
    with pytest.raises(ValueError, match="unknown period rule"):
        tser.resample(df, "d", "v", "H")


def test_resample_many_drops_periods_without_a_mean(spark):
    data = [(day("2021-01-15"), 1.0, 5.0), (day("2021-01-20"), 3.0, 5.0), (day("2021-02-01"), None, 7.0)]
    df = spark.createDataFrame(data, "d date, p double, q double")
    assert rows(tser.resample_many(df, "d", "M", {"p": "mean", "q": "sum"})) == [(day("2021-01-31"), 2.0, 10.0)]


def test_future_periods(spark):
    df = spark.createDataFrame([("end", day("2024-01-31")), ("mid", day("2024-01-15"))], "k string, ds date")
    got = rows(tser.future_periods(df, 2, "M", ["k"]))
    assert got == [("end", day("2024-02-29")), ("end", day("2024-03-31")), ("mid", day("2024-01-31")), ("mid", day("2024-02-29"))]
    gap = spark.createDataFrame([(day("2024-01-01"),), (day("2024-01-08"),)], "ds date")
    assert rows(tser.future_by_gap(gap, 2)) == [(day("2024-01-15"),), (day("2024-01-22"),)]
    assert rows(tser.future_by_gap(gap.limit(1), 1)) == [(day("2024-01-02"),)]


def _lags_in_pandas(pdf, depth, windows):
    out = pdf.copy()
    for k in range(1, depth + 1):
        out[f"lag_{k}"] = out["y"].shift(k)
    for w in windows:
        out[f"roll_mean_{w}"] = out["y"].shift(1).rolling(w, min_periods=1).mean()
    return out


def test_lags_equal_pandas_in_both_forms(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"ds": [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(40)], "y": rng.normal(size=40)})
    df = spark.createDataFrame(pdf, "ds date, y double")
    expected = _lags_in_pandas(pdf, 7, (3, 7)).dropna()
    for got in (
        tser.lag_features(df),
        tser.lag_features_unbounded(df, ["ds"], block_size=8),
    ):
        got = got.orderBy("ds").toPandas()
        assert list(got.columns) == list(expected.columns)
        assert np.allclose(got.iloc[:, 1:].to_numpy(), expected.iloc[:, 1:].to_numpy())


def test_lags_of_one_dominant_series(spark):
    df = spark.range(3_000).select(
        F.when(F.col("id") % 100 == 0, "small").otherwise("big").alias("k"), "id", F.col("id").cast("double").alias("y")
    )
    got = tser.lag_features_unbounded(df, ["id"], (2,), (3,), ["k"], block_size=100, drop_warm_up=False).toPandas()
    assert len(got) == 3_000
    for key, part in got.sort_values("id").groupby("k"):
        expected = _lags_in_pandas(part[["k", "id", "y"]], 2, (3,))
        assert np.allclose(part[expected.columns[3:]].to_numpy(), expected.iloc[:, 3:].to_numpy(), equal_nan=True)
    with pytest.raises(ValueError, match="more than one block"):
        tser.lag_features_unbounded(df, ["id"], (20,), (3,), ["k"], block_size=10)
