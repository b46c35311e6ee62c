"""Rolling-origin backtest of forecasts (FC-02, FC-03): what would have been forecast at earlier dates, against what came.

Every series is cut at several dates. Each series and cut-off is a group of its own, bounded by the calendar, so all of them are fitted
side by side; the periods after the cut-off are held back. Errors and interval coverage are then told per step ahead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.learning.forecast import fit_series, recursive_forecast

HORIZON, ORIGINS, EVERY, LEAST = 12, 4, 3, 24
Forecaster = Callable[[DataFrame, Sequence[str]], DataFrame]


def origins(ts: DataFrame, keys: Sequence[str], horizon: int = HORIZON, count: int = ORIGINS, every: int = EVERY, least: int = LEAST) -> DataFrame:
    """(keys, origin, step, ds, y): the rows of each series once per origin; step 0 is history, 1 ... ``horizon`` are held back.

    The newest origin (0) holds back the last ``horizon`` periods, each further one ``every`` more. Origins with fewer than ``least`` rows of
    history are left out. ``ts`` has one row per key and period; rows without a value are no rows.
    """
    keys = list(keys)
    series = Window.partitionBy(*keys)
    known = ts.where("ds is not null and y is not null").select(*keys, "ds", F.col("y").cast("double").alias("y"))
    ranked = known.select("*", F.row_number().over(series.orderBy(F.desc("ds"))).alias("_back"), F.count(F.lit(1)).over(series).alias("_size"))
    cuts = ranked.select("*", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("origin"))
    held = F.lit(horizon) + F.col("origin") * every
    cuts = cuts.where((F.col("_size") - held >= least) & (F.col("_back") > held - horizon))
    return cuts.select(*keys, "origin", F.greatest(held - F.col("_back") + 1, F.lit(0)).alias("step"), "ds", "y")


def seasonal_naive(ts: DataFrame, keys: Sequence[str], season: int = 12, horizon: int = HORIZON, **how: int) -> DataFrame:
    """The value one season before, as the yardstick: (keys, origin, step, ds, y, yhat)."""
    if season < horizon:
        raise ValueError("the season has to reach back before the origin")
    before = F.lag("y", season).over(Window.partitionBy(*keys).orderBy("ds"))
    past = ts.where("ds is not null and y is not null").select(*keys, "ds", before.cast("double").alias("yhat"))
    return origins(ts, keys, horizon, **how).where("step > 0").join(past, [*keys, "ds"]).select(*keys, "origin", "step", "ds", "y", "yhat")


def trend_season(ts: DataFrame, keys: Sequence[str], mode: str = "additive", flexibility: float = 0.05, **how: int) -> DataFrame:
    """Trend and season fitted at every origin: (keys, origin, step, ds, y, yhat, yhat_lower, yhat_upper)."""
    keys = list(keys)
    cuts = origins(ts, keys, **how)
    fields = [cuts.schema[c] for c in (*keys, "origin", "step", "ds", "y")] + [T.StructField(c, T.DoubleType()) for c in ("yhat", "yhat_lower", "yhat_upper")]

    def fitted(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ds")
        days = (pd.to_datetime(rows["ds"]) - pd.Timestamp("1970-01-01")).dt.days.to_numpy(float)
        past = rows["step"].to_numpy() == 0
        bands = fit_series(days[past], rows["y"].to_numpy(float)[past], days[~past], mode == "multiplicative", flexibility)
        out = rows[~past].copy()
        out[["yhat", "yhat_lower", "yhat_upper"]] = bands[past.sum() :]
        return out

    return cuts.groupBy(*keys, "origin").applyInPandas(fitted, T.StructType(fields))


def training_part(ts: DataFrame, keys: Sequence[str], horizon: int = HORIZON, count: int = ORIGINS, every: int = EVERY) -> DataFrame:
    """The rows before the earliest origin: what a model may learn that is tested at all origins."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ds")))
    known = ts.where("ds is not null and y is not null")
    return known.withColumn("_back", back).where(F.col("_back") > horizon + (count - 1) * every).drop("_back")


def recursive(ts: DataFrame, model: PipelineModel, keys: Sequence[str], horizon: int = HORIZON, rule: str | None = "M", **how: int) -> DataFrame:
    """The recursive forecast of every series and origin, all advancing together: (keys, origin, step, ds, y, yhat)."""
    keys = [*keys, "origin"]
    cuts = origins(ts, keys[:-1], horizon, **how)
    ahead = recursive_forecast(cuts.where("step = 0").select(*keys, "ds", "y"), model, keys, horizon, rule).select(*keys, "step", "yhat")
    return cuts.where("step > 0").join(ahead.withColumn("step", F.col("step").cast("int")), [*keys, "step"]).select(*keys, "step", "ds", "y", "yhat")


def errors(forecasts: DataFrame, by: Sequence[str] = ("step",)) -> DataFrame:
    """(by, n, MAE, RMSE, bias), and where there are intervals their coverage and mean width."""
    error = F.col("yhat") - F.col("y")
    figures = [F.count(error).alias("n"), F.avg(F.abs(error)).alias("MAE"), F.sqrt(F.avg(error * error)).alias("RMSE"), F.avg(error).alias("bias")]
    if "yhat_lower" in forecasts.columns:
        inside = F.col("y").between(F.col("yhat_lower"), F.col("yhat_upper"))
        figures += [F.avg(inside.cast("double")).alias("coverage"), F.avg(F.col("yhat_upper") - F.col("yhat_lower")).alias("width")]
    return forecasts.groupBy(*by).agg(*figures)
