"""Price curves and the price with the highest predicted profit (PO-01 to PO-05)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.learning.models import fit, predict
from gaugeframe.operators.selection import where_equal
from gaugeframe.operators.timeseries import resample_many
from gaugeframe.session import cut_lineage

GRID_POINTS = 200


def grid(bounds: DataFrame, low: str, high: str, price: str, points: int = GRID_POINTS) -> DataFrame:
    """Equidistant prices from ``low`` to ``high`` for every row of bounds, both ends included."""
    step = (F.col(high) - F.col(low)) / F.lit(float(points - 1))
    numbered = bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"))
    value = F.when(F.col("point") == points - 1, F.col(high)).otherwise(F.col(low) + F.col("point") * step)
    return numbered.withColumn(price, value)


def price_grid(
    df: DataFrame, price: str, price_range: tuple[float, float] | None = None, points: int = GRID_POINTS
) -> DataFrame:
    """Prices over the table's range, or over the given one."""
    if price_range is None:
        bounds = df.agg(F.min(price).alias("_low"), F.max(price).alias("_high"))
    else:
        low, high = price_range
        bounds = df.sparkSession.range(1).select(F.lit(float(low)).alias("_low"), F.lit(float(high)).alias("_high"))
    return grid(bounds, "_low", "_high", price, points).select("point", price)


def best_price(curve: DataFrame, price: str, profit: str, keys: Sequence[str] = ()) -> DataFrame:
    """The price with the highest predicted profit, the lowest one if several have it."""
    order: Column = F.struct(-F.col(profit), F.col(price))
    return curve.groupBy(*keys).agg(
        F.min_by(price, order).alias("optimal_price"), F.max(profit).alias("optimal_profit")
    )


@dataclass
class PriceCurve:
    model: PipelineModel
    history: DataFrame
    curve: DataFrame


def curve_by_period(
    df: DataFrame,
    date_col: str,
    price: str,
    profit: str,
    choice: Mapping[str, object],
    rule: str = "M",
    kind: str = "forest",
    trees: int = 100,
    depth: int = 10,
) -> PriceCurve:
    """Mean price and total profit per period of the chosen product and partner, a forest or
    boosted trees fitted to them, and the predicted profit over the observed price range."""
    # a few periods, read by the fit, the price range and the caller
    history = cut_lineage(resample_many(where_equal(df, choice), date_col, rule, {price: "mean", profit: "sum"}))
    model = fit(history, profit, [price], kind, trees=trees, depth=depth, bins=128)
    return PriceCurve(model, history, _predicted(price_grid(history, price), model))


def curve_by_row(
    df: DataFrame,
    price: str,
    profit: str,
    choice: Mapping[str, object] | None = None,
    price_range: tuple[float, float] | None = None,
    model: PipelineModel | None = None,
    trees: int = 150,
    depth: int = 10,
    keep: Sequence[str] = (),
) -> PriceCurve:
    """The same from single rows, with a forest or a given (saved) model.

    Without a range the grid covers the prices of the whole table, not only of the choice. The chosen rows are written down once,
    with price, profit and the columns to ``keep``.
    """
    choice = dict(choice or {})
    known = df.dropna(subset=[price, profit, *choice])
    history = cut_lineage(where_equal(known, choice).select(price, profit, *keep))
    if model is None:
        model = fit(history, profit, [price], "forest", trees=trees, depth=depth, bins=128)
    return PriceCurve(model, history, _predicted(price_grid(df, price, price_range), model))


def _predicted(prices: DataFrame, model: PipelineModel) -> DataFrame:
    return predict(prices, model, "pred_profit")


def reference_points(
    result: PriceCurve, price: str, order_by: Sequence[str]
) -> DataFrame:
    """First, average and optimal price, each with the model's profit."""
    history = result.history.agg(
        F.min_by(price, F.struct(*order_by)).alias("initial"), F.avg(price).alias("average")
    )
    optimum = best_price(result.curve, price, "pred_profit").select("optimal_price").scalar()
    points = history.select(F.inline(F.array(
        F.struct(F.lit("initial").alias("kind"), F.col("initial").alias(price)),
        F.struct(F.lit("average").alias("kind"), F.col("average").alias(price)),
        F.struct(F.lit("optimal").alias("kind"), optimum.alias(price)),
    )))
    return _predicted(points, result.model)


def linear_curves(
    df: DataFrame,
    date_col: str,
    price: str,
    profit: str,
    product: str,
    rule: str = "M",
    points: int = GRID_POINTS,
) -> DataFrame:
    """Linear price curves of all products at once, from aggregates alone.

    A product with one price has a flat line at its mean profit.
    """
    history = resample_many(df, date_col, rule, {price: "mean", profit: "sum"}, [product])
    known = F.col(price).isNotNull() & F.col(profit).isNotNull()
    flat = F.min(F.when(known, F.col(price))) == F.max(F.when(known, F.col(price)))
    lines = history.groupBy(product).agg(
        F.when(flat, F.lit(0.0)).otherwise(F.regr_slope(profit, price)).alias("slope"),
        F.when(flat, F.avg(F.when(known, F.col(profit)))).otherwise(F.regr_intercept(profit, price)).alias("intercept"),
        F.min(price).alias("_low"),
        F.max(price).alias("_high"),
    ).where(F.col("slope").isNotNull())
    return grid(lines, "_low", "_high", price, points).select(
        product, "point", price, (F.col("intercept") + F.col("slope") * F.col(price)).alias("pred_profit")
    )
