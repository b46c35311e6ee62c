"""Latest rows, rankings and figures over them (WIN-01, WIN-02, TOP-01 to TOP-05, AGG-19 to AGG-21)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.ratios import percent
from gaugeframe.operators.aggregation import MIN_CASES, grouped, sum_by, total


def latest_per_key(
    df: DataFrame, keys: Sequence[str], date_col: str, tie_break: Sequence[str] = ()
) -> DataFrame:
    """The last dated row of each key; of several on that date the first in tie-break order.

    Keeping row number 1 lets Spark drop all but one row per key in every task before the
    shuffle, so large keys stay cheap.
    """
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(date_col), *tie_break)
    return (
        df.dropna(subset=list(keys))
        .withColumn("_number", F.row_number().over(order))
        .where(F.col("_number") == 1)
        .drop("_number")
    )


def latest_known_per_key(
    df: DataFrame, keys: Sequence[str], date_col: str, metric: str, tie_break: Sequence[str] = ()
) -> DataFrame:
    """As ``latest_per_key`` over the rows where the metric is known."""
    return latest_per_key(df.dropna(subset=[metric]), keys, date_col, tie_break)


def top(df: DataFrame, metric: str, name: str, n: int) -> DataFrame:
    """The n highest rows, shown from lowest to highest; equal metrics by name, missing last."""
    first = df.orderBy(F.desc_nulls_last(metric), F.col(name)).limit(n)
    return first.orderBy(F.asc_nulls_last(metric), F.desc(name))


def with_rank(best: DataFrame, metric: str, name: str) -> DataFrame:
    """The rank of each of the n highest rows, 1 for the highest; equal metrics by name, missing last."""
    order = Window.orderBy(F.desc_nulls_last(metric), F.col(name))  # over the n rows of a report
    return best.withColumn("rank", F.row_number().over(order).cast("bigint"))


def ranking_metric(metric: str) -> str:
    """The cumulative measure a metric is ranked by; the ratio ranks itself."""
    if metric == "Fatality_rate":
        return metric
    return "Cumulative_cases" if "cases" in metric else "Cumulative_deaths"


def top_latest(
    df: DataFrame,
    metric: str,
    n: int,
    name: str,
    date_col: str,
    tie_break: Sequence[str] = (),
    part: str = "Cumulative_deaths",
    whole: str = "Cumulative_cases",
    threshold: float = MIN_CASES,
) -> DataFrame:
    """Top n over the latest rows, by the measure that belongs to the metric."""
    rank_by = ranking_metric(metric)
    last = latest_per_key(df, [name], date_col, tie_break)
    if rank_by == "Fatality_rate":
        last = last.where(F.col(whole) >= threshold).withColumn(rank_by, percent(F.col(part), F.col(whole)))
    return top(last.select(name, rank_by), rank_by, name, n)


def top_total(df: DataFrame, metric: str, n: int, name: str) -> DataFrame:
    """Top n by the sum over all rows."""
    return top(sum_by(df, [name], metric), metric, name, n)


def top_latest_known(
    df: DataFrame, metric: str, n: int, name: str, date_col: str, tie_break: Sequence[str] = ()
) -> DataFrame:
    """Top n by the last known value."""
    last = latest_known_per_key(df, [name], date_col, metric, tie_break)
    return top(last.select(name, metric), metric, name, n)


def top_of_snapshot(day_rows: DataFrame, metric: str, n: int, name: str) -> DataFrame:
    """Top n of one date, members without a value left out, highest first."""
    return day_rows.dropna(subset=[metric]).orderBy(F.desc(metric), name).limit(n)


def region_totals(
    latest: DataFrame, group: str, part: str = "Cumulative_deaths", whole: str = "Cumulative_cases"
) -> DataFrame:
    """Sums over latest rows per region, regions without cases dropped."""
    sums = grouped(latest, [group], total(whole).alias(whole), total(part).alias(part))
    return sums.where(F.col(whole) > 0)


def surveillance_figures(
    latest: DataFrame, part: str = "Cumulative_deaths", whole: str = "Cumulative_cases"
) -> DataFrame:
    """Total cases and deaths over latest rows and their ratio, 0 without cases."""
    sums = latest.agg(
        total(whole).cast("bigint").alias("total_cases"), total(part).cast("bigint").alias("total_deaths")
    )
    ratio = F.when(F.col("total_cases") != 0, percent(F.col("total_deaths"), F.col("total_cases")))
    return sums.withColumn("fatality_ratio", ratio.otherwise(F.lit(0.0)))


def uptake_figures(df: DataFrame, date_col: str, doses: str, coverage: str, name: str) -> DataFrame:
    """Last date, total doses, mean coverage and number of members."""
    return df.agg(
        F.max(date_col).alias("latest_date"),
        total(doses).cast("double").alias("total_doses"),
        F.avg(coverage).alias("mean_coverage"),
        F.count_distinct(name).alias("members"),
    )
