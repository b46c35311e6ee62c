"""Regular calendar series and features of them (TS-01 to TS-04, WIN-04 to WIN-06, FC-01)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.calendar import period_end, periods_between, shift_period
from gaugeframe.operators.ordered import with_ordinal, with_overlap

# What an aggregation gives for a period without rows.
EMPTY_PERIOD = {"sum": 0, "count": 0, "mean": None, "min": None, "max": None}

AGGREGATES: dict[str, Callable[[str], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "count": F.count,
    "mean": F.avg,
    "min": F.min,
    "max": F.max,
}


def resample(
    df: DataFrame, date_col: str, value_col: str, rule: str = "M", agg: str = "sum", keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, ds, y): one row for every period between a series' first and last one.

    ``ds`` is the period's last day. Empty periods appear with 0 for sums and counts and null
    for other aggregates; rows without date or key are left out.

    Rows are aggregated first. What follows sees one row per period and series, bounded by the
    calendar: each row looks at the next one and emits itself and the empty periods between.
    """
    keys = list(keys)
    known = df.dropna(subset=[date_col, *keys])
    sums = known.groupBy(*keys, period_end(F.col(date_col), rule).alias("_end")).agg(
        AGGREGATES[agg](value_col).alias("y")
    )
    following = F.lead("_end").over(Window.partitionBy(*keys).orderBy("_end"))
    count = F.coalesce(periods_between(F.col("_end"), F.col("_next"), rule), F.lit(1))
    spread = sums.withColumn("_next", following).select(
        *keys, "_end", "y", F.explode(F.sequence(F.lit(0), count - 1)).alias("_step")
    )
    empty = F.lit(EMPTY_PERIOD[agg])
    return spread.select(
        *keys,
        shift_period(F.col("_end"), rule, F.col("_step")).alias("ds"),
        F.when(F.col("_step") == 0, F.col("y")).otherwise(empty).alias("y"),
    )


def resample_many(
    df: DataFrame,
    date_col: str,
    rule: str,
    aggregates: Mapping[str, str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """Several columns with their own aggregate per period; periods without a mean drop out."""
    known = df.dropna(subset=[date_col, *keys])
    out = known.groupBy(*keys, period_end(F.col(date_col), rule).alias("ds")).agg(
        *[AGGREGATES[how](c).alias(c) for c, how in aggregates.items()]
    )
    return out.dropna(subset=list(aggregates))


def future_periods(ts: DataFrame, periods: int, rule: str = "M", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ds) of the next period ends after each series' last date."""
    last = ts.groupBy(*keys).agg(F.max("ds").alias("_last")).where(F.col("_last").isNotNull())
    end = period_end(F.col("_last"), rule)
    # A series that stops inside a period continues with that period's end.
    first = F.when(end > F.col("_last"), F.lit(0)).otherwise(F.lit(1))
    steps = F.explode(F.sequence(first, first + F.lit(periods - 1))).alias("_step")
    return last.select(*keys, end.alias("_end"), steps).select(
        *keys, shift_period(F.col("_end"), rule, F.col("_step")).alias("ds")
    )


def future_by_gap(ts: DataFrame, periods: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ds) continuing with the last observed gap in days, one day for a single row."""
    gap = F.coalesce(F.date_diff(F.col("_two")[0], F.try_element_at("_two", F.lit(2))), F.lit(1))
    order = Window.partitionBy(*keys).orderBy(F.desc("ds"))
    two = (
        ts.where(F.col("ds").isNotNull())
        .withColumn("_number", F.row_number().over(order))
        .where(F.col("_number") <= 2)
        .groupBy(*keys)
        .agg(F.sort_array(F.collect_list("ds"), asc=False).alias("_two"))
        .where(F.size("_two") > 0)
    )
    return two.select(*keys, F.col("_two")[0].alias("_last"), gap.alias("_gap"), F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("_step")).select(
        *keys, F.date_add("_last", F.col("_gap") * F.col("_step")).alias("ds")
    )


def trend(df: DataFrame, date_col: str, metric: str) -> DataFrame:
    """One metric in order of its date.

    Rows equal in both are told apart by a number, or the sort could not split a value that
    fills a large part of the table.
    """
    numbered = df.select(date_col, metric).withColumn("_number", F.monotonically_increasing_id())
    return numbered.orderBy(date_col, metric, "_number").drop("_number")


def _lag_columns(value: str, depth: int, windows: Sequence[int], order: Window) -> dict[str, Column]:
    out = {f"lag_{k}": F.lag(value, k).over(order) for k in range(1, depth + 1)}
    out |= {f"roll_mean_{w}": F.avg(value).over(order.rowsBetween(-w, -1)) for w in windows}
    return out


def lag_features(
    ts: DataFrame,
    lags: Sequence[int] = (1, 7),
    windows: Sequence[int] = (3, 7),
    keys: Sequence[str] = (),
    value: str = "y",
    order_by: str = "ds",
    drop_warm_up: bool = True,
) -> DataFrame:
    """Every lag up to the largest and means of the preceding values, current row excluded.

    For regular series, whose length the calendar bounds; see ``lag_features_unbounded``.
    """
    out = ts.withColumns(_lag_columns(value, max(lags), windows, Window.partitionBy(*keys).orderBy(order_by)))
    return out.dropna() if drop_warm_up else out


def lag_features_unbounded(
    rows: DataFrame,
    order_by: Sequence[str],
    lags: Sequence[int] = (1, 7),
    windows: Sequence[int] = (3, 7),
    keys: Sequence[str] = (),
    value: str = "y",
    block_size: int = 1_000_000,
    drop_warm_up: bool = True,
) -> DataFrame:
    """The same over raw rows of any number per series.

    A long series is cut into blocks that repeat the few rows before them, so that no task
    holds a whole series.
    """
    reach = max([max(lags), *windows])
    numbered = with_ordinal(rows, order_by, keys, "_ordinal")
    blocks = with_overlap(numbered, "_ordinal", reach, block_size)
    order = Window.partitionBy(*keys, "_block").orderBy("_ordinal")
    out = blocks.withColumns(_lag_columns(value, max(lags), windows, order)).where(~F.col("_halo"))
    out = out.drop("_ordinal", "_block", "_halo")
    return out.dropna() if drop_warm_up else out
