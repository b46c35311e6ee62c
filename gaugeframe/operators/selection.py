"""Row filters (FIL-01 to FIL-10, SET-01, SET-03)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.regions import EUROPE_PARTS, CompositeRegion, region_condition

Day = dt.date | str


def where_equal(df: DataFrame, choice: Mapping[str, object], all_labels: Iterable[object] = ("All", "<all>", None)) -> DataFrame:
    """Rows equal to the choice in every column; an ``all`` label leaves its column free."""
    free = set(all_labels)
    for column, value in choice.items():
        if column not in df.columns:
            raise ValueError(f"no column {column!r} to filter by")
        if value not in free:
            df = df.where(F.col(f"`{column}`") == F.lit(value))
    return df


def days(start: Day, end: Day) -> tuple[Column, Column]:
    """Date literals of a range; comparing the bare column with them keeps the scan filtered."""
    return F.lit(str(start)).cast("date"), F.lit(str(end)).cast("date")


def year_range(first: int, last: int) -> tuple[dt.date, dt.date]:
    """Years as the inclusive range from the first January to the last December."""
    return dt.date(first, 1, 1), dt.date(last, 12, 31)


def in_period(
    df: DataFrame,
    date_col: str,
    period: tuple[Day, Day],
    members: Mapping[str, Sequence[object]] | None = None,
) -> DataFrame:
    """Rows dated in the inclusive period and in every non-empty member list."""
    start, end = days(*period)
    condition = F.col(date_col).between(start, end)
    for column, values in (members or {}).items():
        if values:
            condition = condition & F.col(column).isin(list(values))
    return df.where(condition)


def in_regions(
    df: DataFrame,
    selected: Sequence[str],
    region_col: str,
    member_col: str,
    composites: Sequence[CompositeRegion] = EUROPE_PARTS,
) -> DataFrame:
    """Rows in any of the selected regions or composite regions, each row once.

    Where the data has a region with the name of a composite one, the former is meant; whether it has is found by a filter on
    the region alone, at most one row per composite region.
    """
    if not selected:
        return df
    doubtful = sorted({c.name for c in composites} & set(selected))
    plain = None
    if doubtful:
        plain = df.where(F.col(region_col).isin(doubtful)).agg(F.collect_set(region_col).alias("plain")).scalar()
    return df.where(region_condition(selected, F.col(region_col), F.col(member_col), composites, plain))


def snapshot(df: DataFrame, date_col: str, day: Day | None = None) -> DataFrame:
    """Rows of one date, by default the last one in the table."""
    if day is not None:
        return df.where(F.col(date_col) == F.lit(str(day)).cast("date"))
    return df.where(F.col(date_col) == df.agg(F.max(date_col)).scalar())


def known(df: DataFrame, column: str) -> DataFrame:
    """Rows with a value in the column."""
    return df.where(F.col(column).isNotNull())


def at_least(df: DataFrame, column: str, threshold: float) -> DataFrame:
    """Rows, usually of an aggregate, that reach a threshold."""
    return df.where(F.col(column) >= F.lit(threshold))


def two_entities(
    df: DataFrame, column: str, pair: Sequence[object], date_col: str, period: tuple[Day, Day]
) -> DataFrame:
    """Rows of exactly two different entities in a period."""
    if len(set(pair)) != 2:
        raise ValueError("a comparison needs two different entities")
    return in_period(df, date_col, period, {column: list(pair)})


def members_only(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    """Rows of the listed members over all dates."""
    return df.where(F.col(column).isin(list(values)))


def present_members(df: DataFrame, column: str, wanted: Sequence[str]) -> DataFrame:
    """Those wanted members that occur in the data."""
    return df.where(F.col(column).isin(list(wanted))).select(column).distinct()
