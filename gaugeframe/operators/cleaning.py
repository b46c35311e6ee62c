"""Missing values, dates and codes (CLN-01 to CLN-07, JOIN-01)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions.categories import labelled
from gaugeframe.operators.ordered import fill_from_neighbours
from gaugeframe.operators.percentiles import percentile_values


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes null: Spark sorts NaN first and lets it spoil sums."""
    floats = [f for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    if not floats:
        return df
    return df.withColumns({f.name: F.when(~F.isnan(F.col(f"`{f.name}`")), F.col(f"`{f.name}`")) for f in floats})


def parse_dates(df: DataFrame, column: str, formats: Sequence[str] = ()) -> DataFrame:
    """Text to date, null where no format fits. Without formats ISO dates and stamps are read."""
    text = F.col(column)
    if not formats:
        return df.withColumn(column, F.try_to_timestamp(text).cast("date"))
    tries = [F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats]
    return df.withColumn(column, F.coalesce(*tries))


def parse_dates_strict(df: DataFrame, column: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Text to date; a value that does not fit stops the job."""
    return df.withColumn(column, F.to_date(F.col(column), fmt))


def fill_constant(df: DataFrame, columns: Sequence[str], value: float = 0) -> DataFrame:
    """Missing values of the given columns become ``value``."""
    return df.fillna({c: value for c in columns})


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median per column, one number each."""
    if not columns:
        return {}
    found, _ = percentile_values(df, columns, [0.5])
    return {c: found[c, 0.5] for c in columns}


def fill_medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values become the column's exact median; an all-missing column stays missing."""
    known = {c: m for c, m in medians(df, columns).items() if m is not None}
    return df.withColumns(
        {c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(m)) for c, m in known.items()}
    )


def fill_forward_back(
    df: DataFrame, column: str, order_by: Sequence[str], keys: Sequence[str] = ()
) -> DataFrame:
    """Last known value in row order, before the first known one that one.

    ``order_by`` has to give a total order (per key). With ``keys`` each group is filled alone.
    """
    return fill_from_neighbours(df, column, order_by, keys)


def drop_missing(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a value in every given column."""
    return df.dropna(subset=list(columns))


def label_codes(df: DataFrame, code: str, label: str, labels: Mapping[str, str]) -> DataFrame:
    """Add the label of a code column; unknown codes keep the code."""
    return df.withColumn(label, labelled(F.col(code), labels))


def label_codes_by_table(
    df: DataFrame, code: str, label: str, lookup: DataFrame, lookup_code: str, lookup_label: str
) -> DataFrame:
    """As ``label_codes`` with the labels in a table holding each code once.

    The join strategy is Spark's: a small table is broadcast after its size is known, a large
    one is joined by shuffle with skewed partitions split.
    """
    side = lookup.select(F.col(lookup_code).alias("_code"), F.col(lookup_label).alias("_label"))
    return (
        df.join(side, df[code] == F.col("_code"), "left")
        .withColumn(label, F.coalesce(F.col("_label"), F.col(code)))
        .drop("_code", "_label")
    )


def columns_of(df: DataFrame, *types: type[T.DataType]) -> list[str]:
    """Names of the columns with one of the given Spark types."""
    return [f.name for f in df.schema if isinstance(f.dataType, types)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.NumericType)


def text_columns(df: DataFrame) -> list[str]:
    return columns_of(df, T.StringType)
