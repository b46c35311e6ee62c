"""Grouped totals, ratios, means and distributions (AGG-01 to AGG-25, JOIN-02 to JOIN-04).

A missing group key forms no group. All aggregates here combine within each task before the
shuffle, so a key holding a large part of the rows sends one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeframe.functions.ratios import percent
from gaugeframe.functions.regions import EUROPE_PARTS, CompositeRegion, region_group
from gaugeframe.operators.moments import correlations

MIN_CASES = 1000  # below it a fatality ratio is not shown


def grouped(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Group by known keys only."""
    return df.dropna(subset=list(keys)).groupBy(*keys).agg(*aggregates)


def total(column: str) -> Column:
    """Sum that is 0 where nothing is known."""
    return F.coalesce(F.sum(column), F.lit(0))


def sum_by(df: DataFrame, keys: Sequence[str], metric: str, name: str | None = None) -> DataFrame:
    """Sum of a metric per key, missing values counting as 0."""
    return grouped(df, keys, total(metric).alias(name or metric))


def known_sum_by(df: DataFrame, keys: Sequence[str], metric: str, name: str = "value") -> DataFrame:
    """Sum per key that stays missing where no value is known."""
    return grouped(df, keys, F.sum(metric).alias(name))


def mean_by(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Plain means of the known values per key."""
    return grouped(df, keys, *[F.avg(m).alias(m) for m in metrics])


def ratio_of_sums(
    df: DataFrame,
    keys: Sequence[str],
    part: str,
    whole: str,
    threshold: float = MIN_CASES,
    name: str = "Fatality_rate",
) -> DataFrame:
    """100 * sum(part) / sum(whole) per key, groups below the threshold dropped."""
    sums = grouped(df, keys, total(part).alias(part), total(whole).alias(whole))
    return sums.where(F.col(whole) >= threshold).withColumn(name, percent(F.col(part), F.col(whole)))


def metric_over_time(
    df: DataFrame,
    metric: str,
    date_col: str,
    entity: str | None = None,
    part: str = "Cumulative_deaths",
    whole: str = "Cumulative_cases",
    threshold: float = MIN_CASES,
) -> DataFrame:
    """A summed metric per date, or the guarded ratio, optionally split by an entity."""
    keys = [date_col] if entity is None else [entity, date_col]
    if metric == "Fatality_rate":
        return ratio_of_sums(df, keys, part, whole, threshold, metric)
    return sum_by(df, keys, metric)


def with_region_group(
    df: DataFrame,
    selected: Sequence[str],
    region_col: str,
    member_col: str,
    composites: Sequence[CompositeRegion] = EUROPE_PARTS,
    name: str = "Region_group",
) -> DataFrame:
    """Add the region with selected composite regions split off."""
    return df.withColumn(name, region_group(selected, F.col(region_col), F.col(member_col), composites))


def region_over_time(
    df: DataFrame,
    metric: str,
    selected: Sequence[str],
    region_col: str,
    member_col: str,
    date_col: str,
    composites: Sequence[CompositeRegion] = EUROPE_PARTS,
    part: str = "Cumulative_deaths",
    whole: str = "Cumulative_cases",
    threshold: float = MIN_CASES,
) -> DataFrame:
    """A metric, or the guarded ratio, per date and (split) region, named like the region column."""
    split = with_region_group(df, selected, region_col, member_col, composites, "_group")
    if metric == "Fatality_rate":
        out = ratio_of_sums(split, ["_group", date_col], part, whole, threshold, metric)
    else:
        out = sum_by(split, ["_group", date_col], metric)
    return out.withColumnRenamed("_group", region_col)


def regions_and_entities(
    regions: DataFrame, entities: DataFrame, region_col: str, entity_col: str, date_col: str, metric: str
) -> DataFrame:
    """Region and entity series in one long table, told apart by ``kind``."""

    def series(df: DataFrame, name: str, kind: str) -> DataFrame:
        return df.select(F.col(name).alias("name"), F.lit(kind).alias("kind"), date_col, metric)

    return series(regions, region_col, "region").unionByName(series(entities, entity_col, "country"))


def all_series(
    df: DataFrame,
    metric: str,
    selected: Sequence[str],
    region_col: str,
    entity_col: str,
    date_col: str,
    composites: Sequence[CompositeRegion] = EUROPE_PARTS,
    part: str = "Cumulative_deaths",
    whole: str = "Cumulative_cases",
    threshold: float = MIN_CASES,
) -> DataFrame:
    """A metric, or the guarded ratio, per date of countries, regions and split regions: (name, kind, date, metric) from one pass.

    ``kind`` is country, region or split region. The three groupings are sets of one aggregation, so the table is read and shuffled
    once; every task sends at most one row for each name of each kind and date. A missing name or date forms no group; in the split,
    a missing region is the group that :func:`with_region_group` makes of it.
    """
    group = "_group"
    while group in df.columns:
        group += "_"
    split = with_region_group(df, selected, region_col, entity_col, composites, group)
    sums = [part, whole] if metric == "Fatality_rate" else [metric]
    keys = [date_col, entity_col, region_col, group]
    sets = split.groupingSets([[date_col, k] for k in keys[1:]], *keys)
    found = sets.agg(F.grouping_id(*keys).alias("_set"), *[total(c).alias(c) for c in sums])
    # bit by bit from the date to the split region, 1 where a column is not grouped by
    kinds = {0b0011: (entity_col, "country"), 0b0101: (region_col, "region"), 0b0110: (group, "split region")}
    name, kind = (F.coalesce(*[F.when(F.col("_set") == i, x(c, k)) for i, (c, k) in kinds.items()]) for x in (lambda c, k: F.col(c), lambda c, k: F.lit(k)))
    named = found.select(name.alias("name"), kind.alias("kind"), date_col, *sums).dropna(subset=["name", date_col])
    if metric != "Fatality_rate":
        return named
    return named.where(F.col(whole) >= threshold).withColumn(metric, percent(F.col(part), F.col(whole)))


def extremes(ranked: DataFrame, name: str, metric: str) -> DataFrame:
    """Names with the highest and the lowest metric; equal metrics by name."""
    return ranked.agg(
        F.min_by(name, F.struct(-F.col(metric), F.col(name))).alias("worst"),
        F.max_by(name, F.struct(-F.col(metric), F.col(name))).alias("best"),
    )


def leader(df: DataFrame, name: str, metric: str) -> DataFrame:
    """The name with the highest metric and its value; equal metrics by name."""
    order = F.when(F.col(metric).isNotNull(), F.struct(-F.col(metric), F.col(name)))
    return df.agg(F.min_by(name, order).alias(name), F.max(metric).alias(metric))


def value_counts(df: DataFrame, column: str, by: str = "count") -> DataFrame:
    """Rows per known value, most frequent first or in order of the value."""
    counts = grouped(df, [column], F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), column) if by == "count" else counts.orderBy(column)


def weighted_mean_by(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str | None = None
) -> DataFrame:
    """Mean per key over rows with both values, weighted; null where the weights add to 0."""
    both = df.dropna(subset=[value, weight])
    mean = F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))
    return grouped(both, keys, mean.cast("double").alias(name or value))


def weighted_or_plain_mean_by(
    df: DataFrame, keys: Sequence[str], value: str, weight: str, name: str | None = None
) -> DataFrame:
    """The weighted mean if any row of the table has value and weight, else plain means.

    Under the weighted rule keys without any weight are left out; a table without any value
    gives no rows. Both means come from one aggregation and the choice from its result.
    """
    usable = F.col(value).isNotNull() & F.col(weight).isNotNull()
    sums = grouped(
        df,
        keys,
        F.sum(F.when(usable, F.col(value) * F.col(weight))).alias("_weighted"),
        F.sum(F.when(usable, F.col(weight))).alias("_weight"),
        F.count_if(usable).alias("_usable"),
        F.count(value).alias("_known"),
        F.avg(value).alias("_plain"),
    )
    # The reported branch is a property of the whole table: one row over the grouped result.
    any_usable = sums.agg(F.sum("_usable")).scalar() > 0
    any_known = sums.agg(F.sum("_known")).scalar() > 0
    mean = F.when(any_usable, F.try_divide(F.col("_weighted"), F.col("_weight"))).otherwise(F.col("_plain"))
    return sums.where(any_known & (~any_usable | (F.col("_usable") > 0))).select(
        *keys, mean.cast("double").alias(name or value)
    )


def group_maximum(df: DataFrame, keys: Sequence[str], metric: str, name: str = "group_max", bounded: bool = False) -> DataFrame:
    """Put the group's maximum on every row.

    Aggregate and join back instead of a window: the aggregate combines early, the join
    broadcasts it when small and otherwise splits skewed groups, and no task sorts a group.
    Where the calendar bounds a group's rows (``bounded``: one row per period), a window reads its input once.
    """
    if bounded:
        return df.withColumn(name, F.max(metric).over(Window.partitionBy(*keys)))
    best = grouped(df, keys, F.max(metric).alias(name))
    return df.join(best, list(keys), "left")


def in_same_group(df: DataFrame, group: str, member: str, selected: Sequence[str]) -> DataFrame:
    """Rows whose group holds a selected member."""
    holders = df.where(F.col(member).isin(list(selected))).select(group).distinct()
    return df.join(holders, group, "left_semi")


def zscores(df: DataFrame, metric: str, threshold: float = 3.0) -> DataFrame:
    """Distance from the mean in sample deviations and whether it exceeds the threshold."""
    value = F.col(metric)
    stats = df.agg(F.struct(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))).scalar()
    z = (value - stats.getField("mean")) / (stats.getField("std") + F.lit(1e-9))
    return df.withColumn("zscore", z).withColumn("anomaly", F.coalesce(F.abs("zscore") > threshold, F.lit(False)))


def highlight_maxima(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Flag the cells that hold their column's maximum."""
    top = df.agg(F.struct(*[F.max(c).alias(c) for c in columns])).scalar()
    return df.withColumns(
        {f"{c}_is_max": F.coalesce(F.col(c) == top.getField(c), F.lit(False)) for c in columns}
    )


def row_of_maximum(df: DataFrame, metric: str, columns: Sequence[str], order_by: str) -> DataFrame:
    """Columns of the row with the highest metric, the first one in order on ties."""
    order = F.when(F.col(metric).isNotNull(), F.struct(-F.col(metric), F.col(order_by)))
    return df.agg(*[F.min_by(c, order).alias(c) for c in columns])


def mean_and_first(df: DataFrame, metric: str, order_by: Sequence[str]) -> DataFrame:
    """Mean of a column and its value in the first row of the order."""
    return df.agg(
        F.avg(metric).alias(f"{metric}_mean"), F.min_by(metric, F.struct(*order_by)).alias(f"{metric}_first")
    )


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlations as (variable, other, correlation) rows, each over the rows known on
    both sides; null where a side does not vary.

    One pass keeps a matrix of moments per task; the columns of a task's matrix go over the network.
    """
    return correlations(df, columns)


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Counts of equal-width bins over the column's range, the last bin closed, empty bins kept."""
    value = F.col(column).cast("double")
    bounds = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    bounded = df.select(value.alias("x"), bounds.alias("b")).where(F.col("x").isNotNull())
    # A single value gets a range of width 1 around it.
    lo = F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.lo") - 0.5).otherwise(F.col("b.lo"))
    hi = F.when(F.col("b.lo") == F.col("b.hi"), F.col("b.hi") + 0.5).otherwise(F.col("b.hi"))
    ranged = bounded.select("x", lo.alias("lo"), hi.alias("hi"))
    number = F.least(F.width_bucket("x", "lo", "hi", F.lit(bins).cast("bigint")), F.lit(bins))
    counts = ranged.groupBy(number.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi")
    )
    # At most ``bins`` rows from here on.
    whole = counts.agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("counts"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    return whole.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(bins).cast("bigint"))).alias("bin")).select(
        "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"),
        (F.col("lo") + F.col("bin") * width).alias("upper"),
        F.coalesce(F.try_element_at("counts", F.col("bin")), F.lit(0)).alias("count"),
    )


def key_figures(df: DataFrame, figures: Mapping[str, Column]) -> DataFrame:
    """One row of named aggregates."""
    return df.agg(*[c.alias(n) for n, c in figures.items()])
