"""Model, price and forecast queries.

Linear models are checked exactly. Trees and penalised fits differ between solvers: of these, keys, dates and grids are
checked, and conditions that any good fit meets.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.learning import backtest as bt
from gaugeframe.learning import forecast as fc
from gaugeframe.learning import models as ml
from gaugeframe.learning import price_trees as pt
from gaugeframe.learning import pricing as po
from gaugeframe.operators import timeseries as tser
from gaugeframe.plans.registry import add, rounded
from gaugeframe.plans.views import SALES_ROW
from gaugeframe.session import cut_lineage, shared_folder

TARGET, FEATURES = "profit", ["list_price", "quantity"]
_BUCKET_SQL = f"({' + '.join(SALES_ROW)}) % 100 < 20"


def _row_bucket():
    return ml.row_bucket(SALES_ROW)


def _filled(df: DataFrame) -> DataFrame:
    """Missing features take the median of the table."""
    return ml.fill_features(df, ml.medians(df, FEATURES))


_FILLED_SQL = """filled AS (SELECT * REPLACE (COALESCE(list_price, (SELECT quantile_cont(list_price, 0.5) FROM sales)) AS list_price,
                   COALESCE(quantity, (SELECT quantile_cont(quantity, 0.5) FROM sales)) AS quantity) FROM sales)"""


def _features(df: DataFrame) -> DataFrame:
    names = ml.feature_columns(df.drop(*SALES_ROW), TARGET)
    assembler = ml.VectorAssembler(inputCols=names, outputCol="v")
    array = vector_to_array(F.col("v"))
    return rounded(assembler.transform(_filled(df)).select(*SALES_ROW, *[array[i].alias(n) for i, n in enumerate(names)]), 8)


add(
    "ml_01_feature_vector", "sales", _features,
    f"WITH {_FILLED_SQL} SELECT {', '.join(SALES_ROW)}, ROUND(quantity, 8) AS quantity, ROUND(list_price, 8) AS list_price FROM filled",
)
add(
    "ml_02_split", "sales",
    lambda df: ml.with_test_flag(df, ml.modulus_bucket(SALES_ROW), 0.2).select(*SALES_ROW, "is_test"),
    f"SELECT {', '.join(SALES_ROW)}, {_BUCKET_SQL} AS is_test FROM sales",
)


def _hash_shares(df: DataFrame) -> DataFrame:
    counts = ml.with_test_flag(df, _row_bucket(), 0.2).agg(F.count_if("is_test").alias("t"), F.count("*").alias("n"))
    return counts.select("n", (F.abs(F.col("t") / F.col("n") - 0.2) < 0.03).alias("a_fifth_is_test"))


add("ml_02_split_by_hash", "sales", _hash_shares, "SELECT COUNT(*) AS n, TRUE AS a_fifth_is_test FROM sales")


def _train(df: DataFrame) -> DataFrame:
    return ml.with_test_flag(_filled(df), ml.modulus_bucket(SALES_ROW), 0.2)


_LINE_SQL = f"""{_FILLED_SQL}, flagged AS (SELECT *, {_BUCKET_SQL} AS is_test FROM filled),
        line AS (SELECT REGR_SLOPE(profit, list_price) AS slope, REGR_INTERCEPT(profit, list_price) AS intercept FROM flagged WHERE NOT is_test)"""
add(
    "ml_03_linear_baseline", "sales",
    lambda df: rounded(ml.linear_fit(_train(df).where(~F.col("is_test")), "list_price", TARGET), 4),
    f"WITH {_LINE_SQL} SELECT ROUND(slope, 4) AS slope, ROUND(intercept, 4) AS intercept FROM line",
)
add(
    "ml_03_linear_per_product", "sales",
    lambda df: rounded(ml.linear_fit(_train(df), "list_price", TARGET, ["sku"]), 4),
    f"""WITH {_FILLED_SQL} SELECT sku, ROUND(REGR_SLOPE(profit, list_price), 4) AS slope, ROUND(REGR_INTERCEPT(profit, list_price), 4) AS intercept
       FROM filled GROUP BY 1""",
)


def _linear_errors(df: DataFrame) -> DataFrame:
    flagged = _train(df)
    line = ml.linear_fit(flagged.where(~F.col("is_test")), "list_price", TARGET)
    fitted = line.select(F.struct("slope", "intercept")).scalar()
    test = flagged.where("is_test").withColumn(
        "fitted", fitted.getField("intercept") + fitted.getField("slope") * F.col("list_price")
    )
    return rounded(ml.error_figures(test, TARGET, {"linear": "fitted"}), 4)


add(
    "ml_06_error_figures", "sales", _linear_errors,
    f"""WITH {_LINE_SQL}, e AS (SELECT profit AS y, profit - (intercept + slope * list_price) AS e FROM flagged, line WHERE is_test)
        SELECT 'linear' AS model, ROUND(AVG(ABS(e)), 4) AS MAE, ROUND(SQRT(AVG(e * e)), 4) AS RMSE,
               ROUND(1 - AVG(e * e) / VAR_POP(y), 4) AS R2 FROM e""",
)


def _one_model(df: DataFrame, kind: str, **params) -> DataFrame:
    """Fit on the training rows; one prediction per test row, better than their mean."""
    flagged = cut_lineage(_train(df).select(*FEATURES, TARGET, "is_test"))
    model = ml.fit(flagged.where(~F.col("is_test")), TARGET, FEATURES, kind, **params)
    # Written once, as a forest's prediction costs more than the row: both figures read it.
    predicted = cut_lineage(ml.predict(flagged.where("is_test"), model).select(TARGET, ml.PREDICTION))
    figures = ml.error_figures(predicted, TARGET, {kind: ml.PREDICTION})
    return figures.select("model", (F.col("R2") > 0).alias("better_than_mean"), predicted.agg(F.count(ml.PREDICTION)).scalar().alias("n"))


for _name, _kind, _params in (("ml_04_forest", "forest", {"trees": 100}), ("ml_05_boosted_trees", "boosted", {"trees": 20, "depth": 3, "rate": 0.1})):
    add(
        _name, "sales", lambda df, kind=_kind, params=_params: _one_model(df, kind, **params),
        f"SELECT '{_kind}' AS model, TRUE AS better_than_mean, COUNT(*) AS n FROM sales WHERE {_BUCKET_SQL}",
    )


def _ranked(figures: DataFrame) -> DataFrame:
    """Figures and rank of the linear models; of a forest, that it is no worse than the mean by much."""
    linear = F.col("model") != "RandomForest"
    rank = F.row_number().over(Window.partitionBy(linear).orderBy("RMSE", "model"))
    return figures.select(
        "model", F.when(linear, rank).cast("bigint").alias("rank"),
        *[F.when(linear, F.round(c, 4)).alias(c) for c in ("MAE", "RMSE", "R2")],
        (linear | (F.col("R2") > -0.1)).alias("sane"),
    )


def _figures_sql(target: str, lines: dict[str, str]) -> str:
    """Figures of one-feature linear models on the test rows, ranked; lines: the rows that each is fitted on."""
    parts = " UNION ALL ".join(
        f"""SELECT '{m}' AS model, {target} - (i + s * list_price) AS e, {target} AS y FROM flagged,
            (SELECT REGR_SLOPE({target}, list_price) AS s, REGR_INTERCEPT({target}, list_price) AS i FROM flagged{rows}) AS l WHERE is_test"""
        for m, rows in lines.items()
    )
    return f"""WITH raw AS (SELECT *, {_BUCKET_SQL} AS is_test FROM sales),
        flagged AS (SELECT * REPLACE (COALESCE(list_price, (SELECT quantile_cont(list_price, 0.5) FROM raw WHERE NOT is_test)) AS list_price) FROM raw),
        e AS ({parts}),
        f AS (SELECT model, AVG(ABS(e)) AS MAE, SQRT(AVG(e * e)) AS RMSE, 1 - AVG(e * e) / VAR_POP(y) AS R2 FROM e GROUP BY model)
        SELECT model, ROW_NUMBER() OVER (ORDER BY RMSE, model) AS rank, ROUND(MAE, 4) AS MAE, ROUND(RMSE, 4) AS RMSE, ROUND(R2, 4) AS R2, TRUE AS sane FROM f
        UNION ALL SELECT 'RandomForest', NULL, NULL, NULL, NULL, TRUE"""


_NOT_TEST = " WHERE NOT is_test"


def _compared(df: DataFrame, target: str, **more) -> DataFrame:
    return _ranked(ml.compare_models(df, target, ml.modulus_bucket(SALES_ROW), ["list_price"], forest={"trees": 20, "depth": 5}, **more).figures)


add("ml_07_model_comparison", "sales", lambda df: _compared(df, TARGET), _figures_sql(TARGET, {"LinearRegression": _NOT_TEST}))
add("top_06_models_by_rmse", "sales", lambda df: _compared(df, "quantity"), _figures_sql("quantity", {"LinearRegression": _NOT_TEST}))


def _saved(df: DataFrame, models: dict[str, tuple[str, DataFrame]]) -> str:
    """A folder with a linear model of the profit by one feature for each name."""
    folder = shared_folder(df.sparkSession, "models")
    for name, (feature, rows) in models.items():
        ml.save_model(ml.fit(rows, TARGET, [feature], "linear"), folder, name)
    return folder


def _score(df: DataFrame) -> DataFrame:
    folder = _saved(df, {"profit_linear": ("list_price", _filled(df))})
    scored = ml.score(df, ml.load_model(folder, "profit_linear"))
    return scored.select(*SALES_ROW, F.round("list_price", 8).alias("list_price"), F.round(ml.PREDICTION, 1).alias(ml.PREDICTION))


def _with_saved(df: DataFrame) -> DataFrame:
    """A saved model of all rows beside the baselines; one that needs other columns is skipped."""
    flagged = ml.with_test_flag(df, ml.modulus_bucket(SALES_ROW), 0.2)
    rows = cut_lineage(ml.fill_features(flagged, ml.medians(flagged.where("not is_test"), ["list_price"])).select("list_price", "row_part", TARGET))
    folder = _saved(df, {"profit_by_price": ("list_price", rows), "profit_by_part": ("row_part", rows)})
    saved = {n: ml.load_model(folder, n) for n in ml.saved_model_names(df.sparkSession, folder)}
    return _compared(df, TARGET, saved=saved)


def _saved_and_found(df: DataFrame) -> DataFrame:
    """Save, list and load models: the names found, and whether the loaded models predict as before."""
    rows = cut_lineage(_filled(df).select("list_price", TARGET))
    model = ml.fit(rows, TARGET, ["list_price"], "linear")
    folder = shared_folder(df.sparkSession, "models")
    for name in ("profit_a", "profit_b", "other"):
        ml.save_model(model, folder, name)
    before = ml.predict(rows, model).agg(F.sum(ml.PREDICTION)).first()[0]
    spark = df.sparkSession
    found = [(n, ml.predict(rows, ml.load_model(folder, n)).agg(F.sum(ml.PREDICTION)).first()[0] == before) for n in ml.saved_model_names(spark, folder, ["profit"])]
    return spark.createDataFrame(found, "model string, same boolean")


def _importances(df: DataFrame) -> DataFrame:
    features = [*FEATURES, "row_line"]
    filled = ml.fill_features(df, ml.medians(df, features))
    found = ml.importances(df.sparkSession, ml.fit(filled, TARGET, features, "forest", trees=50))
    whole = found.agg(F.sum("importance")).scalar()
    return found.select("feature", ((F.col("importance") >= 0) & (F.abs(whole - 1) < 1e-9)).alias("a_share"))


add(
    "ml_08_scored_table", "sales", _score,
    f"""WITH {_FILLED_SQL}, l AS (SELECT REGR_SLOPE(profit, list_price) AS s, REGR_INTERCEPT(profit, list_price) AS i FROM filled)
        SELECT {', '.join(f't.{c}' for c in SALES_ROW)}, ROUND(t.list_price, 8) AS list_price,
          ROUND(i + s * COALESCE(t.list_price, (SELECT quantile_cont(list_price, 0.5) FROM sales)), 1) AS prediction FROM sales t, l""",
)
add("ml_09_saved_models_compared", "sales", _with_saved, _figures_sql(TARGET, {"LinearRegression": _NOT_TEST, "profit_by_price": ""}))
add("ml_10_saved_and_found", "sales", _saved_and_found, "SELECT * FROM (VALUES ('profit_a', TRUE), ('profit_b', TRUE)) AS v(model, same)")
add("ml_11_feature_importance", "sales", _importances, "SELECT * FROM (VALUES ('list_price', TRUE), ('quantity', TRUE), ('row_line', TRUE)) AS v(feature, a_share)")


# Price curves

CHOICE = {"sku": "Brand#21", "dealer": "BUILDING"}


def _by_period(df: DataFrame, rule: str = "M", **params) -> po.PriceCurve:
    return po.curve_by_period(df, "order_date", "list_price", "profit", CHOICE, rule, **params)


def _within(curve: DataFrame, history: DataFrame) -> DataFrame:
    """Grid and whether the predictions lie within the profits seen, as means of them do."""
    seen = history.agg(F.struct(F.min(TARGET).alias("lo"), F.max(TARGET).alias("hi"))).scalar()
    slack = (seen["hi"] - seen["lo"]) * 0.01 + 1e-6
    inside = F.col("pred_profit").between(seen["lo"] - slack, seen["hi"] + slack)
    return curve.select("point", F.round("list_price", 6).alias("list_price"), inside.alias("within_profits"))


def _by_row(df: DataFrame) -> po.PriceCurve:
    return po.curve_by_row(df, "list_price", "profit", {"sku": "Brand#21"}, (900.0, 2000.0), keep=SALES_ROW)


def _curve(result: po.PriceCurve) -> DataFrame:
    return _within(result.curve, result.history)


def _best_by_year(df: DataFrame) -> DataFrame:
    result = _by_period(df, "Y")
    prices = result.history.agg(F.struct(F.min("list_price").alias("lo"), F.max("list_price").alias("hi"))).scalar()
    best = po.best_price(result.curve, "list_price", "pred_profit")
    return best.select(F.col("optimal_price").between(prices["lo"], prices["hi"]).alias("a_price_seen"), F.col("optimal_profit").isNotNull().alias("has_profit"))


def _references(df: DataFrame) -> DataFrame:
    points = po.reference_points(_by_row(df), "list_price", SALES_ROW)
    best = F.col("kind") == "optimal"
    return points.select(
        "kind", F.when(~best, F.round("list_price", 6)).alias("list_price"),
        (F.col("pred_profit").isNotNull() & (~best | F.col("list_price").between(900, 2000))).alias("sane"))


_PERIODS_SQL = """h AS (SELECT AVG(list_price) AS p FROM sales WHERE sku = 'Brand#21' AND dealer = 'BUILDING' GROUP BY LAST_DAY(order_date)),
       b AS (SELECT MIN(p) AS lo, MAX(p) AS hi FROM h)"""
_GRID_SQL = "SELECT CAST(i AS INTEGER) AS point, ROUND(CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199) END, 6) AS list_price, TRUE AS within_profits FROM b CROSS JOIN range(200) AS r(i)"
add("po_01_curve_by_period", "sales", lambda df: _curve(_by_period(df)), f"WITH {_PERIODS_SQL} {_GRID_SQL}")
add(
    "po_01_curve_boosted", "sales", lambda df: _curve(_by_period(df, kind="boosted", trees=20, depth=3)).drop("within_profits"),
    f"WITH {_PERIODS_SQL} SELECT point, list_price FROM ({_GRID_SQL})",
)
add("po_01_best_by_year", "sales", _best_by_year, "SELECT TRUE AS a_price_seen, TRUE AS has_profit")
add("po_02_curve_by_row", "sales", lambda df: _curve(_by_row(df)), f"WITH b AS (SELECT 900.0::DOUBLE AS lo, 2000.0::DOUBLE AS hi) {_GRID_SQL}")
add(
    "po_03_reference_points", "sales", _references,
    f"""WITH h AS (SELECT * FROM sales WHERE sku = 'Brand#21' AND list_price IS NOT NULL AND profit IS NOT NULL)
        SELECT 'initial' AS kind, ROUND((SELECT list_price FROM h ORDER BY {', '.join(SALES_ROW)} LIMIT 1), 6) AS list_price, TRUE AS sane
        UNION ALL SELECT 'average', ROUND(AVG(list_price), 6), TRUE FROM h UNION ALL SELECT 'optimal', NULL, TRUE""",
)
add(
    "po_04_price_grid", "sales", lambda df: rounded(po.price_grid(df, "list_price")),
    """SELECT CAST(i AS INTEGER) AS point, ROUND(lo + i * ((hi - lo) / 199), 6) AS list_price
       FROM (SELECT MIN(list_price) AS lo, MAX(list_price) AS hi FROM sales) AS b CROSS JOIN range(200) AS r(i)""",
)
_CURVES_SQL = """monthly AS (SELECT sku, LAST_DAY(order_date) AS ds, AVG(list_price) AS list_price, SUM(profit) AS profit
                    FROM sales GROUP BY 1, 2 HAVING AVG(list_price) IS NOT NULL),
       lines AS (SELECT sku, CASE WHEN MIN(list_price) = MAX(list_price) THEN 0 ELSE REGR_SLOPE(profit, list_price) END AS slope,
                        CASE WHEN MIN(list_price) = MAX(list_price) THEN AVG(profit) ELSE REGR_INTERCEPT(profit, list_price) END AS intercept,
                        MIN(list_price) AS lo, MAX(list_price) AS hi FROM monthly GROUP BY 1),
       curve AS (SELECT sku, CAST(i AS INTEGER) AS point, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199) END AS list_price, slope, intercept
                 FROM lines CROSS JOIN range(200) AS r(i))"""


def _linear_curves(df: DataFrame) -> DataFrame:
    return po.linear_curves(df, "order_date", "list_price", "profit", "sku")


add(
    "po_05_linear_curves", "sales", lambda df: rounded(_linear_curves(df), 4),
    f"""WITH {_CURVES_SQL} SELECT sku, point, ROUND(list_price, 4) AS list_price,
        ROUND(intercept + slope * list_price, 4) AS pred_profit FROM curve""",
)
add(
    "po_05_linear_best_prices", "sales",
    lambda df: rounded(po.best_price(_linear_curves(df), "list_price", "pred_profit", ["sku"]), 4),
    f"""WITH {_CURVES_SQL}, p AS (SELECT *, intercept + slope * list_price AS pred FROM curve)
        SELECT sku, ROUND(list_price, 4) AS optimal_price, ROUND(pred, 4) AS optimal_profit FROM p
        QUALIFY ROW_NUMBER() OVER (PARTITION BY sku ORDER BY pred DESC, list_price) = 1""",
)


_TREE_BINS, _TREE_DEPTH, _TREE_ROWS = 32, 3, 5


def _tree_curves_sql() -> str:
    """One regression tree per product on price bins: a level per pair of tables, windows over the bins of a node."""
    parts = [f"""k AS (SELECT sku, list_price AS p, profit AS y FROM sales WHERE sku IS NOT NULL AND list_price IS NOT NULL AND profit IS NOT NULL),
        b AS (SELECT sku, MIN(p) AS lo, MAX(p) AS hi FROM k GROUP BY 1),
        s AS (SELECT k.sku, LEAST(CAST(FLOOR((p - lo) / (hi - lo) * {_TREE_BINS}) AS INTEGER), {_TREE_BINS - 1}) AS bin, COUNT(*) AS n, SUM(y) AS t FROM k JOIN b ON b.sku = k.sku GROUP BY 1, 2),
        t0 AS (SELECT b.sku, CAST(i AS INTEGER) AS bin, COALESCE(n, 0) AS n, COALESCE(t, 0) AS t, 0 AS node FROM b CROSS JOIN range({_TREE_BINS}) AS r(i) LEFT JOIN s ON s.sku = b.sku AND s.bin = i)"""]
    for i in range(_TREE_DEPTH):
        parts.append(f"""w{i} AS (SELECT *, SUM(n) OVER u AS ln, SUM(t) OVER u AS lt, SUM(n) OVER v AS an, SUM(t) OVER v AS st FROM t{i}
                WINDOW u AS (PARTITION BY sku, node ORDER BY bin ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY sku, node)),
            g{i} AS (SELECT *, CASE WHEN n > 0 AND ln >= {_TREE_ROWS} AND an - ln >= {_TREE_ROWS} THEN lt * lt / ln + (st - lt) * (st - lt) / (an - ln) - st * st / an END AS gain FROM w{i}),
            h{i} AS (SELECT sku, node, bin AS at_bin FROM g{i} WHERE gain > 1e-9 * st * st / an QUALIFY ROW_NUMBER() OVER (PARTITION BY sku, node ORDER BY gain DESC, bin) = 1),
            t{i + 1} AS (SELECT g.sku, g.bin, g.n, g.t, 2 * g.node + CASE WHEN g.bin > h.at_bin THEN 1 ELSE 0 END AS node FROM g{i} g LEFT JOIN h{i} h ON h.sku = g.sku AND h.node = g.node)""")
    parts.append(f"""v AS (SELECT sku, bin, SUM(t) OVER (PARTITION BY sku, node) / SUM(n) OVER (PARTITION BY sku, node) AS value FROM t{_TREE_DEPTH}),
        c AS (SELECT sku, lo, hi, CAST(i AS INTEGER) AS point, CASE WHEN i = 199 THEN hi ELSE lo + i * ((hi - lo) / 199) END AS p FROM b CROSS JOIN range(200) AS r(i)),
        curve AS (SELECT c.sku, point, p AS list_price, value AS pred_profit FROM c JOIN v ON v.sku = c.sku AND v.bin = LEAST(CAST(FLOOR((p - lo) / (hi - lo) * {_TREE_BINS}) AS INTEGER), {_TREE_BINS - 1}))""")
    return ", ".join(parts)


#: Means of a few rows often lie on a tie of the rounding, where the order of summation decides; this moves them off it.
_OFF_TIES = 2e-7


def _tree_curves(df: DataFrame) -> DataFrame:
    return pt.tree_curves(df, "sku", "list_price", "profit", _TREE_BINS, _TREE_DEPTH, _TREE_ROWS)


add(
    "po_02_tree_curves_of_all_products", "sales", lambda df: rounded(_tree_curves(df).withColumn("pred_profit", F.col("pred_profit") + _OFF_TIES)),
    f"WITH {_tree_curves_sql()} SELECT sku, point, ROUND(list_price, 6) AS list_price, ROUND(pred_profit + {_OFF_TIES}, 6) AS pred_profit FROM curve",
)
add(
    "po_02_tree_best_prices", "sales", lambda df: rounded(po.best_price(_tree_curves(df), "list_price", "pred_profit", ["sku"]).withColumn("optimal_profit", F.col("optimal_profit") + _OFF_TIES)),
    f"""WITH {_tree_curves_sql()} SELECT sku, ROUND(list_price, 6) AS optimal_price, ROUND(pred_profit + {_OFF_TIES}, 6) AS optimal_profit FROM curve
        QUALIFY ROW_NUMBER() OVER (PARTITION BY sku ORDER BY ROUND(pred_profit, 6) DESC, point) = 1""",
)
add(
    "po_01_forest_curves_of_all_products", "sales",
    lambda df: rounded(pt.tree_curves(tser.resample_many(df, "order_date", "M", {"list_price": "mean", "profit": "sum"}, ["sku"]), "sku", "list_price", "profit", trees=20, row_key=["sku", "ds"]).select("sku", "point", "list_price")),
    f"WITH {_CURVES_SQL} SELECT sku, point, ROUND(list_price, 6) AS list_price FROM curve",
)


# Forecasts

def _monthly(df: DataFrame, keys: list[str]) -> DataFrame:
    return tser.resample(df, "order_date", "quantity", "M", keys=keys)


_MONTHS_SQL = "m AS (SELECT sku, LAST_DAY(order_date) AS ds, SUM(quantity) AS y FROM sales GROUP BY 1, 2), l AS (SELECT sku, MIN(ds) AS first, MAX(ds) AS last FROM m GROUP BY 1)"


def _recursive(df: DataFrame, kind: str) -> DataFrame:
    """Steps and dates, and whether the forecasts stay near the values seen."""
    series = cut_lineage(_monthly(df, ["sku"]))
    model = fc.fit_lag_model(series, ["sku"], kind, trees=100 if kind == "forest" else 20)
    seen = series.agg(F.struct(F.min("y").alias("lo"), F.max("y").alias("hi"))).scalar()
    slack = (seen["hi"] - seen["lo"]) * (0.0 if kind == "forest" else 0.5) + 1e-6
    ahead = fc.recursive_forecast(series, model, ["sku"])
    return ahead.select("sku", "step", "ds", F.col("yhat").between(seen["lo"] - slack, seen["hi"] + slack).alias("near_values"))


def _banded(forecast: DataFrame, *keys: str) -> DataFrame:
    return forecast.select(*keys, "ds", ((F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))).alias("within_band"))


for _kind in ("forest", "boosted"):
    add(
        "fc_02_recursive_forecast" if _kind == "forest" else "fc_02_recursive_boosted", "sales", lambda df, kind=_kind: _recursive(df, kind),
        f"""WITH {_MONTHS_SQL} SELECT sku, i AS step, LAST_DAY(CAST(date_trunc('month', last) + to_months(CAST(i AS INTEGER)) AS DATE)) AS ds, TRUE AS near_values
            FROM l CROSS JOIN range(1, 13) AS r(i)""",
    )
_SPAN_SQL = """SELECT {k}, LAST_DAY(CAST(UNNEST(generate_series(date_trunc('month', first), date_trunc('month', last) + INTERVAL 12 MONTH, INTERVAL 1 MONTH)) AS DATE)) AS ds,
                 TRUE AS within_band FROM l"""
add(
    "fc_03_trend_season_forecast", "sales",
    lambda df: _banded(fc.trend_season_forecast(_monthly(df, ["sku"]), ["sku"]), "sku"),
    f"WITH {_MONTHS_SQL} {_SPAN_SQL.format(k='sku')}",
)
add(
    "fc_03_multiplicative_per_dealer", "sales",
    lambda df: _banded(fc.trend_season_forecast(_monthly(df, ["dealer"]), ["dealer"], mode="multiplicative", flexibility=0.1), "dealer"),
    f"WITH {_MONTHS_SQL.replace('sku', 'dealer')} {_SPAN_SQL.format(k='dealer')}",
)


# Backtests: the yardstick's figures are compared, a model's are set against them

_CUTS_SQL = """m AS (SELECT dealer, LAST_DAY(order_date) AS ds, SUM(quantity) AS y FROM sales WHERE order_date IS NOT NULL AND dealer IS NOT NULL GROUP BY 1, 2),
       k AS (SELECT *, LAG(y, 12) OVER w AS yhat, ROW_NUMBER() OVER (PARTITION BY dealer ORDER BY ds DESC) AS back, COUNT(*) OVER (PARTITION BY dealer) AS size FROM m WINDOW w AS (PARTITION BY dealer ORDER BY ds)),
       c AS (SELECT dealer, CAST(o AS INTEGER) AS origin, CAST(13 + 3 * o - back AS INTEGER) AS step, ds, y, yhat FROM k CROSS JOIN range(4) AS r(o)
             WHERE size - 12 - 3 * o >= 24 AND back > 3 * o AND back <= 12 + 3 * o)"""


def _rounded_errors(forecasts: DataFrame, *by: str) -> DataFrame:
    return rounded(bt.errors(forecasts, by), 4)


add(
    "fc_03_backtest_seasonal_naive", "sales", lambda df: _rounded_errors(bt.seasonal_naive(_monthly(df, ["dealer"]), ["dealer"]), "step"),
    f"""WITH {_CUTS_SQL} SELECT step, COUNT(yhat) AS n, ROUND(AVG(ABS(yhat - y)), 4) AS MAE, ROUND(SQRT(AVG((yhat - y) * (yhat - y))), 4) AS RMSE, ROUND(AVG(yhat - y), 4) AS bias FROM c GROUP BY 1""",
)


def _against_naive(ts: DataFrame, forecasts: DataFrame, most: float) -> DataFrame:
    """Yardstick's error per origin, and whether the model's mean error is at most ``most`` times as large."""
    naive = bt.errors(bt.seasonal_naive(ts, ["dealer"]), ["origin"]).select("origin", "n", F.col("MAE").alias("naive_MAE"))
    model = bt.errors(forecasts, ["origin"]).select("origin", F.col("MAE").alias("model_MAE"))
    return rounded(naive.join(model, "origin").select("origin", "n", "naive_MAE", (F.col("model_MAE") <= most * F.col("naive_MAE")).alias("model_holds")), 4)


def _backtest(df: DataFrame) -> DataFrame:
    ts = _monthly(df, ["dealer"])
    return _against_naive(ts, bt.trend_season(ts, ["dealer"]), 1.25)


def _backtest_recursive(df: DataFrame) -> DataFrame:
    ts = cut_lineage(_monthly(df, ["dealer"]))
    model = fc.fit_lag_model(bt.training_part(ts, ["dealer"]), ["dealer"], "forest", trees=20)
    return _against_naive(ts, bt.recursive(ts, model, ["dealer"]), 1.25)


_NAIVE_SQL = f"WITH {_CUTS_SQL} SELECT origin, COUNT(yhat) AS n, ROUND(AVG(ABS(yhat - y)), 4) AS naive_MAE, TRUE AS model_holds FROM c GROUP BY 1"
add("fc_03_backtest", "sales", _backtest, _NAIVE_SQL)
add("fc_02_backtest", "sales", _backtest_recursive, _NAIVE_SQL)
