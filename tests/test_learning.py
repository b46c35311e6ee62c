import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeframe.learning import forecast as fc
from gaugeframe.learning import models as ml
from gaugeframe.learning import pricing as po
from gaugeframe.operators import timeseries as tser
from tests.helpers import day, rows


@pytest.fixture(scope="module")
def planted(spark):
    """profit = 3 price - 2 size + noise, some features missing."""
    rng = np.random.default_rng(7)
    price, size = rng.uniform(1, 10, 800), rng.uniform(0, 5, 800)
    profit = 3 * price - 2 * size + rng.normal(scale=0.1, size=800)
    data = [(i, float(p), float(s) if i % 20 else None, float(t)) for i, (p, s, t) in enumerate(zip(price, size, profit))]
    return spark.createDataFrame(data, "id bigint, price double, size double, profit double").cache()


def test_split_does_not_depend_on_partitions(planted):
    one = ml.with_test_flag(planted.coalesce(1), ml.row_bucket(["id"])).where("is_test")
    many = ml.with_test_flag(planted.repartition(5), ml.row_bucket(["id"])).where("is_test")
    ids = {r.id for r in one.collect()}
    assert ids == {r.id for r in many.collect()} and 100 < len(ids) < 220
    with pytest.raises(ValueError):
        ml.with_test_flag(planted, ml.row_bucket(["id"]), 0.9)


def test_comparison_beats_the_mean_and_skips_foreign_models(spark, planted, tmp_path):
    folder = str(tmp_path)
    ml.save_model(ml.fit(planted, "profit", ["price"], "linear"), folder, "price_model")
    ml.save_model(ml.fit(planted, "profit", ["id"], "linear"), folder, "id_model")
    assert ml.saved_model_names(spark, folder) == ["id_model", "price_model"]
    assert ml.saved_model_names(spark, folder, ["price"]) == ["price_model"]
    saved = {n: ml.load_model(folder, n) for n in ml.saved_model_names(spark, folder)}
    result = ml.compare_models(planted, "profit", ml.row_bucket(["id"]), ["price", "size"], saved=saved, forest={"trees": 10})
    figures = {r.model: r for r in result.figures.collect()}
    assert set(figures) == {"LinearRegression", "RandomForest", "price_model"} and result.skipped == ["id_model"]
    assert all(f.R2 > 0.5 for f in figures.values())
    assert figures["LinearRegression"].R2 > 0.9
    ordered = [r.RMSE for r in result.figures.collect()]
    assert ordered == sorted(ordered)


def test_error_figures(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 3.0), (None, 1.0)], "y double, p double")
    r = ml.error_figures(df, "y", {"m": "p"}).first()
    assert (r.MAE, r.RMSE, r.R2) == (1.0, pytest.approx((5 / 3) ** 0.5), pytest.approx(1 - 5 / 8))
    flat = spark.createDataFrame([(1.0, 2.0)], "y double, p double")
    assert ml.error_figures(flat, "y", {"m": "p"}).first().R2 is None


def test_score_fills_but_keeps_the_inputs(planted):
    model = ml.fit(planted.dropna(), "profit", ["price", "size"], "linear")
    scored = ml.score(planted, model)
    assert scored.columns == [*planted.columns, "prediction"]
    assert scored.where("size is null").count() == 40 and scored.where("prediction is null").count() == 0
    median = planted.agg(F.percentile("size", F.lit(0.5))).first()[0]
    r = scored.where("size is null").first()
    assert r.prediction == pytest.approx(3 * r.price - 2 * median, abs=0.2)


def test_importances_and_boosted_trees(spark, planted):
    rows_ = planted.dropna()
    model = ml.fit(rows_, "profit", ["size", "price"], "boosted", trees=8)
    got = ml.importances(spark, model).collect()
    assert [r.feature for r in got] == ["price", "size"] and got[0].importance > got[1].importance
    assert ml.error_figures(ml.predict(rows_, model), "profit", {"b": "prediction"}).first().R2 > 0.5
    assert ml.importances(spark, ml.fit(rows_, "profit", ["price"], "linear")).count() == 0
    with pytest.raises(ValueError, match="unknown model"):
        ml.regressor("prophet")


def test_grid_and_best_price_ties(spark):
    df = spark.createDataFrame([(1.0,), (4.0,)], "price double")
    got = [r.price for r in po.price_grid(df, "price").orderBy("point").collect()]
    assert np.array_equal(got, np.linspace(1.0, 4.0, 200)) and len(got) == 200
    curve = spark.createDataFrame([(3.0, 7.0), (2.0, 7.0), (1.0, 5.0)], "price double, pred double")
    assert tuple(po.best_price(curve, "price", "pred").first()) == (2.0, 7.0)


def test_price_curves_find_the_planted_optimum(spark):
    data = [(i, "a", 1.0 + (i % 90) / 10) for i in range(900)] + [(i, "b", 50.0) for i in range(900, 950)]
    df = spark.createDataFrame(data, "id int, sku string, price double").withColumn("profit", 25 - (F.col("price") - 6) ** 2)
    result = po.curve_by_row(df, "price", "profit", {"sku": "a"}, (2.0, 9.0), trees=20, keep=["id"])
    # The top is flat and ties take the lowest price, so the check is the profit lost there.
    chosen = po.best_price(result.curve, "price", "pred_profit").first().optimal_price
    assert 25 - (chosen - 6) ** 2 > 24.5
    points = {r.kind: r for r in po.reference_points(result, "price", ["id"]).collect()}
    assert points["initial"].price == 1.0 and points["average"].price == pytest.approx(5.45)
    assert points["optimal"].pred_profit >= max(points["initial"].pred_profit, points["average"].pred_profit)


def test_linear_curves_are_straight_per_product(spark):
    months = [dt.date(2020, m, 10) for m in range(1, 13)]
    data = [("up", d, 1.0 + i, 10.0 + 2 * i) for i, d in enumerate(months)] + [("down", d, 1.0 + i, 50.0 - i) for i, d in enumerate(months)]
    data += [("flat", d, 5.0, float(i)) for i, d in enumerate(months)]
    df = spark.createDataFrame(data, "sku string, d date, price double, profit double")
    best = po.best_price(po.linear_curves(df, "d", "price", "profit", "sku"), "price", "pred_profit", ["sku"])
    got = {r.sku: (r.optimal_price, r.optimal_profit) for r in best.collect()}
    assert got == {"up": (12.0, pytest.approx(32.0)), "down": (1.0, pytest.approx(50.0)), "flat": (5.0, pytest.approx(5.5))}


def test_recursive_forecast_continues_every_series(spark):
    months = pd.date_range("2018-01-31", periods=48, freq="ME").date
    data = [(k, d, float(level + i % 4)) for k, level in (("a", 10), ("b", 100)) for i, d in enumerate(months)]
    data.append(("short", day("2021-12-31"), 5.0))
    ts = spark.createDataFrame(data, "k string, ds date, y double")
    model = fc.fit_lag_model(ts, ["k"], trees=20, depth=5)
    got = fc.recursive_forecast(ts, model, ["k"], horizon=5)
    assert got.count() == 15
    for r in got.where("k != 'short'").collect():
        assert r.yhat == pytest.approx((10 if r.k == "a" else 100) + (47 + r.step) % 4, abs=2.5)
    assert [r.ds for r in got.where("k = 'a'").orderBy("step").collect()][:2] == [day("2022-01-31"), day("2022-02-28")]
    by_gap = fc.recursive_forecast(ts, model, ["k"], horizon=1, rule=None)
    assert {(r.k, r.ds) for r in by_gap.collect()} == {("a", day("2022-01-31")), ("b", day("2022-01-31")), ("short", day("2022-01-01"))}


def test_first_step_of_the_recursion_uses_the_training_definition(spark):
    months = pd.date_range("2018-01-31", periods=30, freq="ME").date
    ts = spark.createDataFrame([(d, float((i * 7) % 11)) for i, d in enumerate(months)], "ds date, y double")
    model = fc.fit_lag_model(ts, trees=5, depth=4)
    extended = ts.union(spark.createDataFrame([(day("2020-07-31"), 0.0)], "ds date, y double"))
    features = tser.lag_features(extended, range(1, 8), (3, 7)).orderBy(F.desc("ds")).limit(1)
    expected = ml.predict(features, model).first().prediction
    assert fc.recursive_forecast(ts, model, horizon=1).first().yhat == pytest.approx(expected)


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_trend_season_forecast_follows_a_planted_series(spark, mode):
    months = pd.date_range("2015-01-31", periods=84, freq="ME")
    t = np.arange(96)
    season = np.sin(2 * np.pi * t / 12)
    truth = (100 + t) * (1 + 0.3 * season) if mode == "multiplicative" else 100 + t + 20 * season
    ts = spark.createDataFrame([("a", d.date(), float(y)) for d, y in zip(months, truth)] + [("one", dt.date(2020, 1, 31), 1.0)], "k string, ds date, y double")
    got = fc.trend_season_forecast(ts, ["k"], mode=mode).orderBy("ds").toPandas()
    assert len(got) == 96 and set(got.k) == {"a"}
    assert got.ds.iloc[-1] == dt.date(2022, 12, 31)
    assert np.abs(got.yhat.to_numpy() - truth).max() < 0.05 * truth.max()
    assert (got.yhat_lower < got.yhat).all() and (got.yhat < got.yhat_upper).all()
    width = (got.yhat_upper - got.yhat_lower).to_numpy()
    assert width[-1] >= width[0]
    with pytest.raises(ValueError, match="unknown seasonality"):
        fc.trend_season_forecast(ts, mode="daily")
