"""Tree price curves of all products and backtests, against plain Python and planted series."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.learning import backtest as bt
from gaugeframe.learning import forecast as fc
from gaugeframe.learning import price_trees as pt
from gaugeframe.learning import pricing as po
from tests.helpers import plan_of


def plain_tree(cells, depth, least):
    """Value of each bin: cells are (bin, n, total) of one tree, all bins."""
    nodes = [sorted(cells)]
    for _ in range(depth):
        out = []
        for node in nodes:
            n, total = sum(c[1] for c in node), sum(c[2] for c in node)
            best = None
            for i in range(len(node) - 1):
                ln, lt = sum(c[1] for c in node[: i + 1]), sum(c[2] for c in node[: i + 1])
                if node[i][1] and ln >= least and n - ln >= least:
                    gain = lt * lt / ln + (total - lt) ** 2 / (n - ln) - total * total / n
                    if gain > 1e-9 * total * total / n and (best is None or gain > best[0] + 1e-12 * abs(best[0])):
                        best = gain, i
            out += [node] if best is None else [node[: best[1] + 1], node[best[1] + 1 :]]
        nodes = out
    return {c[0]: (sum(c[2] for c in node) / sum(c[1] for c in node)) for node in nodes for c in node}


def sales(n=3000):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        sku = rng.choice(["hot"] * 6 + ["a", "b", "c"])
        price = round(rng.uniform(5, 50), 2)
        best = {"hot": 20, "a": 35, "b": 10, "c": 45}[sku]
        rows.append((i, sku, price, 100 - (price - best) ** 2 / 10 + rng.gauss(0, 3)))
    rows += [(n, "one price", 7.0, 3.0), (n + 1, "one price", 7.0, 5.0), (n + 2, None, 7.0, 5.0), (n + 3, "a", None, 5.0), (n + 4, "a", 9.0, None), (n + 5, "never", None, None)]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(sales(), "id long, sku string, price double, profit double").repartition(4).cache()


@pytest.mark.parametrize("trees,depth,least", [(1, 4, 1), (1, 6, 20), (5, 3, 5)])
def test_trees_equal_plain_python_on_the_same_bins(table, trees, depth, least):
    sums, _ = pt.price_bins(table, "sku", "price", "profit", 32, trees, ["id"])
    cells = {}
    for sku, tree, b, n, total in sums.select("sku", "tree", "bin", "n", "total").collect():
        cells.setdefault((sku, tree), []).append((b, n, total))
    assert len(cells) == 5 * trees and all(len(c) == 32 for c in cells.values())
    found = {}
    for sku, tree, b, value in pt.grow(sums, "sku", depth, least).select("sku", "tree", "bin", "value").collect():
        found[sku, tree, b] = value
    for (sku, tree), c in cells.items():
        if sum(n for _, n, _ in c):
            for b, value in plain_tree(c, depth, least).items():
                assert found[sku, tree, b] == pytest.approx(value, rel=1e-9)


def test_sums_per_bin_are_those_of_the_rows(table):
    sums, _ = pt.price_bins(table, "sku", "price", "profit", 32)
    known = [r for r in sales() if r[1] and r[2] is not None and r[3] is not None]
    assert sums.agg(F.sum("n")).first()[0] == len(known)
    assert sums.agg(F.sum("total")).first()[0] == pytest.approx(sum(r[3] for r in known))


def test_planted_optima_of_all_products(table):
    curves = pt.tree_curves(table, "sku", "price", "profit", bins=64, depth=5, least_rows=5, trees=10, row_key=["id"])
    best = {r["sku"]: r["optimal_price"] for r in po.best_price(curves, "price", "pred_profit", ["sku"]).collect()}
    assert set(best) == {"hot", "a", "b", "c", "one price"}
    for sku, price in {"hot": 20, "a": 35, "b": 10, "c": 45}.items():
        assert abs(best[sku] - price) < 8  # the curve is flat at its top
    assert curves.where("sku = 'one price'").select("price").distinct().count() == 1


def test_bagging_draws_depend_on_keys_alone_and_average_one(table):
    sums, _ = pt.price_bins(table, "sku", "price", "profit", 8, 20, ["id"])
    n = sums.groupBy("tree").agg(F.sum("n")).collect()
    assert len(n) == 20 and all(abs(r[1] - 3002) < 300 for r in n) and len({r[1] for r in n}) > 5
    again, _ = pt.price_bins(table.repartition(7), "sku", "price", "profit", 8, 20, ["id"])
    key = ["sku", "tree", "bin", "n"]
    assert sums.select(key).exceptAll(again.select(key)).isEmpty()
    with pytest.raises(ValueError):
        pt.price_bins(table, "sku", "price", "profit", trees=3)


def test_levels_share_one_shuffle_of_the_sums(table):
    sums, _ = pt.price_bins(table, "sku", "price", "profit", 16)
    one, six = (plan_of(pt.grow(sums, "sku", d)).count("Exchange") for d in (1, 6))
    assert one == six


def months(n, start=2010):
    return [(dt.date(start + (i + 1) // 12, (i + 1) % 12 + 1, 1) - dt.timedelta(days=1)) for i in range(n)]


def planted(spark, series=40, size=96, noise=2.0, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(series):
        level, slope, swing = rng.uniform(50, 100), rng.uniform(-0.2, 0.5), rng.uniform(5, 15)
        rows += [(s, d, float(level + slope * i + swing * np.sin(2 * np.pi * i / 12) + rng.normal(0, noise))) for i, d in enumerate(months(size))]
    return spark.createDataFrame(rows, "k int, ds date, y double")


def test_origins_hold_back_what_they_should(spark):
    days = months(40)
    ts = spark.createDataFrame([("x", d, float(i)) for i, d in enumerate(days)] + [("short", d, 1.0) for d in days[:20]] + [("x", None, 1.0), ("x", dt.date(2030, 1, 31), None)], "k string, ds date, y double")
    found = bt.origins(ts, ["k"], horizon=6, count=3, every=4, least=24).collect()
    assert {r["k"] for r in found} == {"x"}
    by = {}
    for r in found:
        by.setdefault(r["origin"], {}).setdefault(r["step"], []).append(r["y"])
    assert set(by) == {0, 1, 2}
    for origin, steps in by.items():
        end = 40 - 6 - 4 * origin
        assert sorted(steps[0]) == [float(i) for i in range(end)]
        assert [steps[s] for s in range(1, 7)] == [[float(end + s - 1)] for s in range(1, 7)]


def test_backtest_of_planted_series_meets_its_intervals(spark):
    ts = planted(spark)
    forecasts = bt.trend_season(ts, ["k"], horizon=6, count=3, every=4)
    assert forecasts.count() == 40 * 3 * 6
    whole = bt.errors(forecasts, []).first()
    assert 0.7 <= whole["coverage"] <= 0.9 and whole["MAE"] < 3 and abs(whole["bias"]) < 1
    naive = bt.errors(bt.seasonal_naive(ts, ["k"], horizon=6, count=3, every=4), []).first()
    assert whole["MAE"] < naive["MAE"] and naive["n"] == whole["n"]
    assert bt.errors(forecasts).count() == 6


def test_recursive_backtest_learns_nothing_from_what_is_held_back(spark):
    ts = planted(spark, series=6, size=60)
    part = bt.training_part(ts, ["k"], horizon=6, count=2, every=3)
    assert part.groupBy("k").agg(F.max("ds")).select(F.max("max(ds)")).first()[0] == months(60)[60 - 6 - 3 - 1]
    model = fc.fit_lag_model(part, ["k"], "forest", trees=10)
    forecasts = bt.recursive(ts, model, ["k"], horizon=6, count=2, every=3).collect()
    assert len(forecasts) == 6 * 2 * 6
    assert np.mean([abs(r["yhat"] - r["y"]) for r in forecasts]) < 15
    changed = ts.withColumn("y", F.when(F.col("ds") > months(60)[53], 1e6).otherwise(F.col("y")))
    same = bt.recursive(changed, model, ["k"], horizon=6, count=2, every=3).where("origin = 0").collect()
    assert {(r["k"], r["step"]): r["yhat"] for r in same} == pytest.approx({(r["k"], r["step"]): r["yhat"] for r in forecasts if r["origin"] == 0})


def test_seasonal_naive_needs_a_season_behind_the_origin(spark):
    with pytest.raises(ValueError):
        bt.seasonal_naive(planted(spark, 1), ["k"], season=6, horizon=12)
