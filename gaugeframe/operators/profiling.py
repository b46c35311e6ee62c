"""What is in a table (PRF-01 to PRF-12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.operators.cleaning import columns_of, numeric_columns, text_columns
from gaugeframe.operators.percentiles import known, percentile_values


def preview(df: DataFrame, order_by: Sequence[str], rows: int = 5) -> DataFrame:
    """First rows in a stated order; a top-k, never a full sort."""
    return df.orderBy(*order_by).limit(rows)


def describe(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum, one row per numeric column.

    One pass for the moments and the brackets of the quartiles, one for what lies inside the brackets; larger tables take a few more.
    """
    columns = list(columns or numeric_columns(df))
    figures = ("count", "mean", "std", "min", "max")
    extra = [f(known(df, c)) for c in columns for f in (F.count, F.avg, F.stddev_samp, F.min, F.max)]
    quartiles, row = percentile_values(df, columns, [0.25, 0.5, 0.75], extra)
    rows = []
    for i, c in enumerate(columns):
        value = {f: row[f"extra{i * len(figures) + j}"] for j, f in enumerate(figures)}
        value |= {name: quartiles[c, p] for name, p in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))}
        cells = [F.lit(value[n]).cast("bigint" if n == "count" else "double").alias(n) for n in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")]
        rows.append(F.struct(F.lit(c).alias("column"), *cells))
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def summary(df: DataFrame) -> DataFrame:
    """One description of any table: its numeric and date columns, or, if it has none, its text columns.

    Figures of numbers and of dates share their columns as text: numbers with four decimals, dates as time stamps.
    """
    numbers, dates = numeric_columns(df), columns_of(df, T.DateType, T.TimestampType, T.TimestampNTZType)
    if not numbers and not dates:
        return describe_text(df)
    figures = ("mean", "std", "min", "p25", "p50", "p75", "max")
    parts = []
    if numbers:
        parts.append(describe(df, numbers).select("column", "count", *[F.round(c, 4).cast("decimal(38,4)").cast("string").alias(c) for c in figures]))
    if dates:
        table = describe_dates(df, dates).withColumn("std", F.lit(None))
        parts.append(table.select("column", "count", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c != "std" else F.lit(None).cast("string").alias(c) for c in figures]))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def describe_dates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The same for date and timestamp columns, as timestamps; dates have no deviation."""
    columns = list(columns or columns_of(df, T.DateType, T.TimestampType, T.TimestampNTZType))

    def seconds(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp")) / F.lit(1e6)

    numbers = df.select(*[seconds(F.col(f"`{c}`")).alias(c) for c in columns])
    table = describe(numbers, columns)
    stamps = {
        name: F.timestamp_micros((F.col(name) * 1e6).cast("bigint")).cast("timestamp_ntz")
        for name in ("mean", "min", "p25", "p50", "p75", "max")
    }
    return table.withColumns(stamps).drop("std")


def describe_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Count, distinct values, most frequent value and its frequency, per text column.

    Frequencies are counted by value first, so a value filling most of a column costs one row
    per task. Equally frequent values: the smallest is shown.
    """
    columns = list(columns or text_columns(df))
    cells = [F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("value")) for c in columns]
    counts = df.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(F.count("value").alias("n"))
    return counts.groupBy("column").agg(
        F.sum("n").alias("count"),
        F.count("value").alias("unique"),
        F.min_by("value", F.when(F.col("value").isNotNull(), F.struct(-F.col("n"), F.col("value")))).alias("top"),
        F.max(F.when(F.col("value").isNotNull(), F.col("n"))).alias("freq"),
    )


def shape(df: DataFrame) -> DataFrame:
    """Row and column count."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns)).cast("bigint")
    )


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, a missing value being one of them."""
    return df.select(column).distinct()


def choices(df: DataFrame, column: str, all_label: str | None = None) -> DataFrame:
    """Distinct known values in order, optionally headed by an entry for all of them."""
    values = df.select(column).dropna().distinct()
    if all_label is None:
        return values.orderBy(column)
    head = df.sparkSession.range(1).select(F.lit(all_label).alias(column), F.lit(0).alias("_rank"))
    return (
        head.unionByName(values.withColumn("_rank", F.lit(1)))
        .orderBy("_rank", column)
        .drop("_rank")
    )


def dependent_choices(df: DataFrame, column: str, condition: Column | None = None) -> DataFrame:
    """Choices of one column under the selection made on another; none selected takes all."""
    return choices(df if condition is None else df.where(condition), column)


def extent(df: DataFrame, column: str) -> DataFrame:
    """Smallest and largest known value."""
    return df.agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"))


def year_extent(df: DataFrame, date_col: str) -> DataFrame:
    """First and last year of a date column."""
    return extent(df, date_col).select(
        F.year("min_value").alias("min_year"), F.year("max_value").alias("max_year")
    )


def distinct_count(df: DataFrame, column: str, relative_error: float | None = None) -> DataFrame:
    """Number of distinct known values, exact or within a relative error."""
    count = F.count_distinct(column) if relative_error is None else F.approx_count_distinct(column, relative_error)
    return df.agg(count.alias("distinct_count"))
