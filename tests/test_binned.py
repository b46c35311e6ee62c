import numpy as np
import pytest
from pyspark.sql import functions as F

from gaugeframe.learning import binned
from gaugeframe.learning import models as ml
from gaugeframe.plans import learning


@pytest.fixture(scope="module")
def noisy(spark):
    rng = np.random.default_rng(7)
    price, size = rng.uniform(1, 10, 4_000), rng.integers(0, 6, 4_000)
    profit = 3 * price - 2 * size + rng.normal(scale=2, size=4_000)
    data = [(float(p), int(s), float(y)) for p, s, y in zip(price, size, profit)]
    return spark.createDataFrame(data, "price double, size int, profit double").cache()


def _r2(df, model):
    return ml.error_figures(ml.predict(df, model), "profit", {"m": "prediction"}).first().R2


@pytest.mark.parametrize("kind, params", [("forest", {"trees": 4, "depth": 5}), ("boosted", {"trees": 4, "depth": 3})])
def test_trees_of_many_rows_are_fitted_on_cells(spark, noisy, tmp_path, kind, params):
    """Few cells reach the learner, the model is as good as one of the rows, and the same for any partitioning."""
    plain = ml.fit(noisy, "profit", ["price", "size"], kind, bins=16, **params)
    model = ml.fit(noisy, "profit", ["price", "size"], kind, bins=16, rows_at_once=100, **params)
    assert _r2(noisy, model) == pytest.approx(_r2(noisy, plain), abs=0.03)
    assert ml.inputs_of(model) == ["price", "size"] and ml.score(noisy, model).columns == ml.score(noisy, plain).columns
    assert {r.feature for r in ml.importances(spark, model).collect()} == {"price", "size"}
    assert model.stages[-1].getNumTrees == 4 if kind == "forest" else len(model.stages[-1].trees) == 4
    again = ml.fit(noisy.repartition(5), "profit", ["price", "size"], kind, bins=16, rows_at_once=100, **params)
    ml.save_model(model, str(tmp_path), kind)
    sums = [ml.predict(noisy, m).agg(F.sum("prediction")).first()[0] for m in (model, again, ml.load_model(str(tmp_path), kind))]
    assert sums[1:] == pytest.approx([sums[0]] * 2)


def test_bags_draw_every_row_for_every_tree(spark):
    data = [(float(c), float(y)) for c in range(3) for y in range(400)] + [(9.0, 5.0)] * 1_000
    rows = spark.createDataFrame(data, "cell double, _target double")
    got = binned.bags(rows, ["cell"], 5, 42, 3).toPandas()
    assert len(got) == 20 and set(got.tree) == set(range(5))
    assert (got._weight % 1 == 0).all() and got.groupby("tree")._weight.sum().nunique() > 1
    each = got[got.cell < 9]
    assert each._weight.between(300, 500).all() and (each._total / each._weight).between(170, 230).all()
    hot = got[got.cell == 9]
    assert hot._weight.between(850, 1_150).all() and (hot._total == 5 * hot._weight).all()


def test_bounds_part_rows_by_counts(spark):
    far = spark.createDataFrame([(i, float(i) ** 3 if i < 999 else 1e300, i % 5) for i in range(1_000)], "id int, x double, few int")
    bounds, few = binned.bounds(far, ["x", "few"], 10)
    assert few == [0.5, 1.5, 2.5, 3.5] and len(bounds) == 9
    sizes = np.histogram([r.x for r in far.collect()], [-np.inf, *bounds, np.inf])[0]
    assert sizes.min() > 80 and sizes.max() < 120
    assert binned.bounds(far.repartition(7), ["x"], 10) == [bounds]
    same = spark.createDataFrame([(float(min(i % 2000, 40)),) for i in range(2_000)], "x double")
    assert binned.quantile_bounds(same, "x", 10) == [39.5]


def test_partitions_follow_the_rows_where_cells_do_not_pay(noisy):
    assert ml._partitions(1_000, 100, 16) == 16
    assert ml._partitions(200_000_000, 100, 16) * ml.PARTITION_BYTES >= 200_000_000 * 600
    model = ml.fit(noisy, "profit", ["price", "size"], "boosted", bins=128, rows_at_once=100, trees=2, depth=3)
    assert len(model.stages) == 2


def test_boosted_trees_read_cells_whose_number_does_not_grow_with_the_rows(noisy, monkeypatch):
    """Three times the rows reach the learner as the same cells, with three times the weight."""
    seen, plain_fit = [], binned.GBTRegressor.fit

    def fit(self, cells, *more):
        seen.append(cells.agg(F.count(F.lit(1)), F.sum("_weight")).first())
        return plain_fit(self, cells, *more)

    monkeypatch.setattr(binned.GBTRegressor, "fit", fit)
    models = [
        ml.fit(rows, "profit", ["price", "size"], "boosted", bins=16, rows_at_once=100, trees=3, depth=3)
        for rows in (noisy, noisy.union(noisy).union(noisy))
    ]
    (cells, weight), (cells_thrice, weight_thrice) = seen
    assert cells == cells_thrice <= 2 * 16 * 6 and (weight, weight_thrice) == (4_000, 12_000)
    sums = [ml.predict(noisy, m).agg(F.sum("prediction")).first()[0] for m in models]
    assert sums[1] == pytest.approx(sums[0])


@pytest.fixture(scope="module")
def few_sales(spark):
    """Sales rows with missing prices and quantities, some of them twice."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(2_000):
        price, quantity = float(rng.uniform(1, 10)), float(rng.integers(1, 6))
        profit = price * quantity + float(rng.normal())
        data.append((i, i % 3, i % 11, i % 7, None if i % 40 == 0 else price, None if i % 50 == 0 else quantity, profit))
    names = "row_key long, row_line int, row_part long, row_supp long, list_price double, quantity double, profit double"
    return spark.createDataFrame(data + data[:300], names).cache()


def _is_test(rows):
    return [r for r in rows if (r.row_key + r.row_line + r.row_part + r.row_supp) % 100 < 20]


def test_boosted_query_of_many_rows_predicts_every_test_row(few_sales):
    got = learning._one_model(few_sales, "boosted", trees=8, depth=3, bins=8, rate=0.3, rows_at_once=100).collect()
    assert [tuple(r) for r in got] == [("boosted", True, len(_is_test(few_sales.collect())))]


def test_comparison_of_many_rows_fits_its_forest_on_cells(few_sales):
    forest = {"trees": 5, "depth": 4}
    plain, found = (
        ml.compare_models(few_sales, "profit", ml.modulus_bucket(learning.SALES_ROW), ["list_price"], forest=forest | more)
        for more in ({}, {"rows_at_once": 100})
    )
    assert found.models["RandomForest"].stages[-1].getNumTrees == 5
    assert [len(c.models["RandomForest"].stages) for c in (plain, found)] == [2, 3]
    assert found.scored.count() == len(_is_test(few_sales.collect()))
    before, after = ({r.model: r for r in c.figures.collect()} for c in (plain, found))
    assert after["LinearRegression"] == before["LinearRegression"]
    assert after["RandomForest"].R2 == pytest.approx(before["RandomForest"].R2, abs=0.05)


def test_saved_models_are_compared_beside_a_forest_of_many_rows(few_sales, tmp_path):
    """A model of cells is saved and loaded like any other; its inputs, not its bins, decide whether it is skipped."""
    for name, features in (("by_price", ["list_price"]), ("by_both", ["list_price", "quantity"])):
        filled = ml.fill_features(few_sales, ml.medians(few_sales, features))
        ml.save_model(ml.fit(filled, "profit", features, "boosted", bins=8, rows_at_once=100, trees=3, depth=3), str(tmp_path), name)
    names = ml.saved_model_names(few_sales.sparkSession, str(tmp_path))
    saved = {n: ml.load_model(str(tmp_path), n) for n in names}
    forest = {"trees": 3, "depth": 4, "rows_at_once": 100}
    found = ml.compare_models(few_sales, "profit", ml.modulus_bucket(learning.SALES_ROW), ["list_price"], saved=saved, forest=forest)
    assert names == ["by_both", "by_price"] and found.skipped == ["by_both"]
    figures = {r.model: r for r in found.figures.collect()}
    assert set(figures) == {"LinearRegression", "RandomForest", "by_price"}
    assert found.scored.where("prediction_0 is null or prediction_1 is null or prediction_2 is null").isEmpty()
    assert all(r.R2 > 0.2 for r in figures.values())
