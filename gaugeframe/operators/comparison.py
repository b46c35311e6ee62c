"""Two entities side by side and the tables behind maps (CMP-01 to CMP-05, GEO-01 to GEO-04)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.categories import highlight, highlight_size
from gaugeframe.functions.ratios import clip_upper, percent, percent_above, percent_or_zero, share_of_maximum
from gaugeframe.functions.regions import EUROPE_PARTS, CompositeRegion
from gaugeframe.operators.aggregation import MIN_CASES, group_maximum, grouped, total, with_region_group
from gaugeframe.operators.latest import latest_per_key, region_totals

CASES, DEATHS = "Cumulative_cases", "Cumulative_deaths"


def latest_summary(df: DataFrame, entity: str, date_col: str, tie_break: Sequence[str] = ()) -> DataFrame:
    """Latest cases, deaths and ratio per entity, ratio 0 where it is undefined."""
    last = latest_per_key(df, [entity], date_col, tie_break)
    return last.select(entity, CASES, DEATHS).withColumn(
        "Fatality_ratio", percent_or_zero(F.col(DEATHS), F.col(CASES))
    )


def latest_region_summary(df: DataFrame, region: str, member: str, date_col: str) -> DataFrame:
    """Cases, deaths and ratio per region, summed over the latest row of each member."""
    last = latest_per_key(df, [member], date_col)
    sums = grouped(last, [region], total(CASES).alias(CASES), total(DEATHS).alias(DEATHS))
    return sums.withColumn("Fatality_ratio", percent_or_zero(F.col(DEATHS), F.col(CASES)))


def normalised(df: DataFrame, entity: str, metric: str) -> DataFrame:
    """Metric as a share of the entity's maximum over the given rows."""
    return group_maximum(df, [entity], metric, "_max", bounded=True).withColumn(
        "normalised", share_of_maximum(F.col(metric), F.col("_max"))
    ).drop("_max")


def ratio_over_time(df: DataFrame) -> DataFrame:
    """Ratio of each row, 0 where it is undefined."""
    return df.withColumn("fatality_ratio", percent_or_zero(F.col(DEATHS), F.col(CASES)))


def bubble_map(latest: DataFrame, member: str, threshold: float = MIN_CASES, clip: float = 5.0) -> DataFrame:
    """Cases, deaths, ratio and clipped ratio per member; ratio 0 below the threshold."""
    rate = percent_above(F.col(DEATHS), F.col(CASES), threshold)
    return (
        latest.select(member, CASES, DEATHS)
        .withColumn("Fatality_rate", rate)
        .withColumn("Fatality_rate_plot", clip_upper(F.col("Fatality_rate"), clip))
    )


def member_scatter(
    latest: DataFrame,
    selected_regions: Sequence[str],
    selected_members: Sequence[str],
    region: str,
    member: str,
    composites: Sequence[CompositeRegion] = EUROPE_PARTS,
    threshold: float = MIN_CASES,
) -> DataFrame:
    """Ratio against cases per member with its (split) region, highlighted if any is selected."""
    enough = latest.where(F.col(CASES) >= threshold)
    out = with_region_group(enough, selected_regions, region, member, composites).select(
        member, "Region_group", CASES, DEATHS, percent(F.col(DEATHS), F.col(CASES)).alias("Fatality_rate")
    )
    if selected_members:
        out = out.withColumn("Highlight", highlight(F.col(member), selected_members))
    return out


def region_scatter(
    latest: DataFrame,
    selected_regions: Sequence[str],
    selected_members: Sequence[str],
    region: str,
    member: str,
    composites: Sequence[CompositeRegion] = EUROPE_PARTS,
) -> DataFrame:
    """Cases against deaths per (split) region; regions holding a selected member stand out.

    The flag is one more aggregate of the same grouping, so nothing is joined back. As long as
    no selected member occurs at all, every region reads ``Other``.
    """
    split = with_region_group(latest, selected_regions, region, member, composites)
    if not selected_members:
        return region_totals(split, "Region_group")
    holds = F.coalesce(F.col(member).isin(list(selected_members)), F.lit(False))
    sums = grouped(
        split, ["Region_group"], total(CASES).alias(CASES), total(DEATHS).alias(DEATHS), F.bool_or(holds).alias("_holds")
    )
    return (
        sums.where(F.col(CASES) > 0)
        .withColumn("Highlight", F.when(F.col("_holds"), F.lit("Selected")).otherwise(F.lit("Other")))
        .withColumn("Size", highlight_size(F.col("Highlight")))
        .drop("_holds")
    )


def choropleth(day_rows: DataFrame, member: str, measure: str) -> DataFrame:
    """Member and measure of one date."""
    return day_rows.select(member, measure)
