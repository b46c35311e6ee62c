"""Forecasts of many series at once (FC-02, FC-03). Input: regular series (keys, ds, y)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions.calendar import period_end, shift_period
from gaugeframe.learning.models import fit, predict
from gaugeframe.operators.timeseries import lag_features
from gaugeframe.session import cut_lineage

DEPTH = 7
MEANS = (3, 7)
LAG_FEATURES = [f"lag_{k}" for k in range(1, DEPTH + 1)] + [f"roll_mean_{w}" for w in MEANS]


def fit_lag_model(
    ts: DataFrame, keys: Sequence[str] = (), kind: str = "forest", trees: int = 100, depth: int | None = None, rate: float = 0.1
) -> PipelineModel:
    """One model of the next value from lags and preceding means, pooled over all series.

    Boosted trees are shallow (3 levels) unless told otherwise, those of a forest are deep (10).
    """
    depth = depth or (3 if kind == "boosted" else 10)
    frame = lag_features(ts, range(1, DEPTH + 1), MEANS, keys)
    return fit(frame, "y", LAG_FEATURES, kind, trees=trees, depth=depth, rate=rate, seed=0)


def _last_values(ts: DataFrame, keys: list[str]) -> DataFrame:
    """One row per series: last values (newest first), sum, count, last date, last gap in days.

    Only the newest values of a series are gathered (each task passes on that many at most); the rest are sums.
    """
    by = keys or ["_all"]
    known = ts.withColumn("_all", F.lit(0)).dropna(subset=["ds", "y"]).select(*by, "ds", F.col("y").cast("double").alias("y"))
    newest_first = Window.partitionBy(*by).orderBy(F.desc("ds"), F.desc("y"))
    recent = (
        known.withColumn("_at", F.row_number().over(newest_first))
        .where(F.col("_at") <= DEPTH)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(F.struct("ds", "y")), asc=False).alias("_points"))
    )
    series = recent.join(known.groupBy(*by).agg(F.sum("y").alias("total"), F.count("y").cast("int").alias("n")), by)
    newest, before = F.col("_points")[0]["ds"], F.try_element_at("_points", F.lit(2))["ds"]
    values = F.transform("_points", lambda r: r["y"])
    return series.select(
        *keys,
        values.alias("recent"),
        "total",
        "n",
        newest.alias("last"),
        F.coalesce(F.date_diff(newest, before), F.lit(1)).alias("gap"),
        F.array().cast("array<double>").alias("yhats"),
    )


def recursive_forecast(
    ts: DataFrame,
    model: PipelineModel,
    keys: Sequence[str] = (),
    horizon: int = 12,
    rule: str | None = "M",
    steps_per_cut: int = 4,
) -> DataFrame:
    """(keys, step, ds, yhat): each step predicts all series and feeds the value back.

    A missing lag of a short series is its mean so far. Dates follow the period rule, or
    repeat the last gap if no rule is given. The state is one short row per series; the plan
    of the finished steps is cut by a checkpoint every few steps.
    """
    keys = list(keys)
    state = _last_values(ts, keys)
    for step in range(1, horizon + 1):
        mean = F.col("total") / F.col("n")
        lags = {f"lag_{k}": F.coalesce(F.try_element_at("recent", F.lit(k)), mean) for k in range(1, DEPTH + 1)}
        means = {}
        for w in MEANS:
            newest = F.slice("recent", 1, w)
            means[f"roll_mean_{w}"] = F.aggregate(newest, F.lit(0.0), lambda a, b: a + b) / F.size(newest)
        ahead = predict(state.withColumns(lags | means), model, "_next")
        state = ahead.select(
            *keys,
            F.slice(F.concat(F.array("_next"), "recent"), 1, DEPTH).alias("recent"),
            (F.col("total") + F.col("_next")).alias("total"),
            (F.col("n") + 1).alias("n"),
            "last",
            "gap",
            F.concat("yhats", F.array("_next")).alias("yhats"),
        )
        if step % steps_per_cut == 0 or step == horizon:
            state = cut_lineage(state)
    steps = state.select(*keys, "last", "gap", F.posexplode("yhats").alias("_at", "yhat"))
    number = F.col("_at") + 1
    if rule is None:
        ds = F.date_add("last", F.col("gap") * number)
    else:
        ds = shift_period(period_end(F.col("last"), rule), rule, number)
    return steps.select(*keys, number.cast("bigint").alias("step"), ds.alias("ds"), "yhat")


# Trend and seasonality

KNOTS = 25  # possible slope changes, over the first 80 % of the history
KNOT_SHARE = 0.8
FOURIER_ORDER = 10  # of the yearly cycle, less where a year has too few periods
SEASON_SCALE = 10.0
YEAR = 365.25
NORMAL_QUANTILE_80 = 1.2815515655446004


def _design(t: np.ndarray, days: np.ndarray, knots: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    trend = np.column_stack([np.ones_like(t), t, np.maximum(t[:, None] - knots[None, :], 0.0)])
    angle = 2 * np.pi * np.outer(days, np.arange(1, order + 1)) / YEAR
    return trend, np.hstack([np.sin(angle), np.cos(angle)])


def _ridge(x: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    return np.linalg.solve(x.T @ x + np.diag(penalty + 1e-9), x.T @ y)


def fit_series(days: np.ndarray, y: np.ndarray, ahead: np.ndarray, multiplicative: bool, flexibility: float) -> np.ndarray:
    """Columns yhat, lower, upper for the days of the history followed by those ahead.

    Piecewise linear trend and yearly Fourier terms with normal priors: ``flexibility`` is the
    scale of slope changes. The multiplicative form trend * (1 + season) alternates two fits.
    """
    every = np.concatenate([days, ahead])
    span = max(float(days[-1] - days[0]), 1.0)
    scale = float(np.max(np.abs(y))) or 1.0
    target, t = y / scale, (every - days[0]) / span
    count = min(KNOTS, max(int(len(y) * KNOT_SHARE) - 1, 0))
    knots = np.linspace(0.0, KNOT_SHARE, count + 1)[1:]
    per_year = len(y) / (span / YEAR) if span >= 2 * YEAR else 0
    order = int(min(FOURIER_ORDER, max((per_year - 1) // 2, 0)))
    trend_x, season_x = _design(t, every, knots, order)
    past = slice(0, len(y))

    noise = max(float(np.std(target)), 1e-6)
    for _ in range(2):  # the second pass uses the residual spread of the first
        trend_penalty = np.concatenate([[0.0, 0.0], np.full(count, (noise / flexibility) ** 2)])
        season_penalty = np.full(season_x.shape[1], (noise / SEASON_SCALE) ** 2)
        if multiplicative:
            season = np.zeros(len(every))
            for _ in range(5):
                factor = (1 + season)[:, None]
                beta = _ridge(trend_x[past] * factor[past], target, trend_penalty)
                trend = trend_x @ beta
                gamma = _ridge(season_x[past] * trend[past, None], target - trend[past], season_penalty)
                season = season_x @ gamma
            fitted = trend * (1 + season)
        else:
            both = np.hstack([trend_x, season_x])
            coefficients = _ridge(both[past], target, np.concatenate([trend_penalty, season_penalty]))
            beta, fitted = coefficients[: trend_x.shape[1]], both @ coefficients
        noise = max(float(np.std(target - fitted[past])), 1e-6)

    # Slope changes keep coming at the observed rate and mean size after the history's end.
    size = float(np.mean(np.abs(beta[2:]))) if count else 0.0
    beyond = np.maximum(t - 1.0, 0.0)
    drift = (count / KNOT_SHARE) * 2 * size**2 * beyond**3 / 3
    width = NORMAL_QUANTILE_80 * np.sqrt(noise**2 + drift)
    return np.column_stack([fitted, fitted - width, fitted + width]) * scale


def _series_forecaster(
    keys: list[str], periods: int, rule: str, multiplicative: bool, flexibility: float
) -> Callable[[pd.DataFrame], pd.DataFrame]:
    offsets = {"D": "D", "W": "W-SUN", "M": "ME", "Q": "QE", "Y": "YE"}

    def forecast(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset=["ds", "y"]).sort_values("ds")
        if len(rows) < 2:
            return pd.DataFrame(columns=[*keys, "ds", "yhat", "yhat_lower", "yhat_upper"])
        past = pd.DatetimeIndex(pd.to_datetime(rows["ds"]))
        future = pd.date_range(past[-1], periods=periods + 1, freq=offsets[rule])
        future = future[future > past[-1]][:periods]
        epoch = pd.Timestamp("1970-01-01")
        bands = fit_series(
            (past - epoch).days.to_numpy(dtype=float), rows["y"].to_numpy(dtype=float),
            (future - epoch).days.to_numpy(dtype=float), multiplicative, flexibility,
        )
        out = pd.DataFrame({"ds": past.append(future).date})
        out[["yhat", "yhat_lower", "yhat_upper"]] = bands
        for k in keys:
            out[k] = rows[k].iloc[0]
        return out[[*keys, "ds", "yhat", "yhat_lower", "yhat_upper"]]

    return forecast


def trend_season_forecast(
    ts: DataFrame,
    keys: Sequence[str] = (),
    periods: int = 12,
    rule: str = "M",
    mode: str = "additive",
    flexibility: float = 0.05,
) -> DataFrame:
    """(keys, ds, yhat, yhat_lower, yhat_upper) over the history and the periods ahead, with an
    80 % interval. Series with a single row give nothing.

    Spark spreads the series over the cluster; each is fitted by itself, being bounded by the
    calendar after resampling.
    """
    if mode not in ("additive", "multiplicative"):
        raise ValueError(f"unknown seasonality mode {mode!r}")
    keys = list(keys)
    fields = [ts.schema[k] for k in keys] + [T.StructField("ds", T.DateType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("yhat", "yhat_lower", "yhat_upper")]
    run = _series_forecaster(keys, periods, rule, mode == "multiplicative", flexibility)
    return ts.select(*keys, "ds", F.col("y").cast("double").alias("y")).groupBy(*keys).applyInPandas(run, T.StructType(fields))
