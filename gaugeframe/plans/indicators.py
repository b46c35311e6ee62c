"""Aggregation, ranking, comparison, map and time-series queries."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeframe.functions.categories import TARGET_GROUP_LABELS
from gaugeframe.operators import aggregation as agg
from gaugeframe.operators import cleaning as cln
from gaugeframe.operators import comparison as cmp
from gaugeframe.operators import latest as lat
from gaugeframe.operators import ordered
from gaugeframe.operators import selection as sel
from gaugeframe.operators import timeseries as tser
from gaugeframe.plans.registry import add, rounded
from gaugeframe.plans.tables import (
    _ACTIVITY_SQL,
    _LABEL_SQL,
    _RATE_SQL,
    _SLEEP_SQL,
    _with_bins,
    BETWEEN,
    BOTH,
    REGION_GROUP,
)
from gaugeframe.plans.views import PARTS, PERIOD, SALES_ROW

DAY, PLACE, REGION = "Date_reported", "Country", "WHO_region"
CASES, DEATHS = "Cumulative_cases", "Cumulative_deaths"
ADM, COV, POP = "COVID_VACCINE_ADM_1D", "COVID_VACCINE_COV_1D", "POPULATION"


def latest(df: DataFrame) -> DataFrame:
    return lat.latest_per_key(df, [PLACE], DAY)


LATEST_SQL = "latest AS (SELECT * FROM surveillance QUALIFY ROW_NUMBER() OVER (PARTITION BY Country ORDER BY Date_reported DESC) = 1)"


# Totals and ratios

add(
    "agg_01_sum_per_date", "surveillance", lambda df: agg.metric_over_time(df, "New_deaths", DAY),
    "SELECT Date_reported, COALESCE(SUM(New_deaths), 0) AS New_deaths FROM surveillance GROUP BY 1",
)
add(
    "agg_02_sum_per_date_country", "surveillance", lambda df: agg.metric_over_time(df, "New_deaths", DAY, PLACE),
    "SELECT Country, Date_reported, COALESCE(SUM(New_deaths), 0) AS New_deaths FROM surveillance GROUP BY 1, 2",
)
add(
    "agg_03_sum_per_region_date", "surveillance", lambda df: agg.sum_by(df, [REGION, DAY], "New_cases"),
    """SELECT WHO_region, Date_reported, COALESCE(SUM(New_cases), 0) AS New_cases FROM surveillance
       WHERE WHO_region IS NOT NULL GROUP BY 1, 2""",
)
add(
    "agg_04_sum_per_split_region", "surveillance",
    lambda df: agg.region_over_time(df, "New_cases", BOTH, REGION, PLACE, DAY, PARTS),
    f"""WITH split AS (SELECT {REGION_GROUP} AS g, Date_reported AS d, New_cases AS c FROM surveillance)
        SELECT g AS WHO_region, d AS Date_reported, COALESCE(SUM(c), 0) AS New_cases FROM split GROUP BY 1, 2""",
)
add(
    "agg_05_known_sum", "uptake_monthly", lambda df: agg.known_sum_by(df, ["DATE"], "COVID_VACCINE_ADM_TOT_DOSES"),
    "SELECT DATE, SUM(COVID_VACCINE_ADM_TOT_DOSES) AS value FROM uptake_monthly GROUP BY 1",
)
_RATIO_SQL = f"""SELECT {{keys}}, SUM(Cumulative_deaths) AS Cumulative_deaths, SUM(Cumulative_cases) AS Cumulative_cases,
       ROUND(SUM(Cumulative_deaths) / SUM(Cumulative_cases) * 100, 6) AS Fatality_rate
       FROM {{source}} GROUP BY {{groups}} HAVING SUM(Cumulative_cases) >= 1000"""
add(
    "agg_06_ratio_per_date", "surveillance", lambda df: rounded(agg.metric_over_time(df, "Fatality_rate", DAY)),
    _RATIO_SQL.format(keys=DAY, source="surveillance", groups="1"),
)
add(
    "agg_06_ratio_per_country", "surveillance", lambda df: rounded(agg.metric_over_time(df, "Fatality_rate", DAY, PLACE)),
    _RATIO_SQL.format(keys="Country, Date_reported", source="surveillance", groups="1, 2"),
)


def region_ratio_trend(df: DataFrame) -> DataFrame:
    """Fatality ratio per split region and date over a period."""
    selected = sel.in_period(df, DAY, PERIOD)
    return rounded(agg.region_over_time(selected, "Fatality_rate", BOTH, REGION, PLACE, DAY, PARTS))


add(
    "agg_07_region_ratio_trend", "surveillance", region_ratio_trend,
    f"""WITH split AS (SELECT {REGION_GROUP} AS g, Date_reported, Cumulative_deaths, Cumulative_cases
                       FROM surveillance WHERE Date_reported {BETWEEN})
        """ + _RATIO_SQL.format(keys="g AS WHO_region, Date_reported", source="split", groups="1, 2"),
)
_SCORES = ["anxiety_level", "stress_level", "mood_level"]
_PLATFORM_SQL = "SELECT platform, " + ", ".join(f"ROUND(AVG({m}), 6) AS {m}" for m in _SCORES) + " FROM wellbeing GROUP BY 1"
add(
    "agg_08_platform_means", "wellbeing",
    lambda df: rounded(agg.mean_by(df, ["platform"], _SCORES).orderBy(F.desc("anxiety_level"), "platform")),
    _PLATFORM_SQL,
)
add(
    "agg_09_extremes", "wellbeing",
    lambda df: agg.extremes(rounded(agg.mean_by(df, ["platform"], _SCORES)), "platform", "anxiety_level"),
    f"""WITH stats AS ({_PLATFORM_SQL})
        SELECT (SELECT platform FROM stats ORDER BY anxiety_level DESC, platform LIMIT 1) AS worst,
               (SELECT platform FROM stats ORDER BY anxiety_level, platform DESC LIMIT 1) AS best""",
)
add(
    "agg_10_counts_by_value", "wellbeing",
    lambda df: agg.value_counts(sel.where_equal(df, {"platform": "BUILDING"}), "mental_state", by="value"),
    'SELECT mental_state, COUNT(*) AS "count" FROM wellbeing WHERE platform = \'BUILDING\' GROUP BY 1',
)
add(
    "agg_11_counts_by_frequency", "sales", lambda df: agg.value_counts(df, "sku"),
    'SELECT sku, COUNT(*) AS "count" FROM sales WHERE sku IS NOT NULL GROUP BY 1',
)
add(
    "agg_12_mean_per_sleep_bin", "wellbeing",
    lambda df: rounded(agg.mean_by(_with_bins(df), ["sleep_cat"], ["mood_level"])),
    f"SELECT {_SLEEP_SQL} AS sleep_cat, ROUND(AVG(mood_level), 6) AS mood_level FROM wellbeing GROUP BY 1",
)
add(
    "agg_12_mean_per_activity_bin", "wellbeing",
    lambda df: rounded(agg.mean_by(_with_bins(df), ["activity_cat"], ["mood_level"])),
    f"SELECT {_ACTIVITY_SQL} AS activity_cat, ROUND(AVG(mood_level), 6) AS mood_level FROM wellbeing GROUP BY 1",
)
_ADM_PER_COUNTRY = f"SELECT COUNTRY, CAST(COALESCE(SUM({ADM}), 0) AS BIGINT) AS {ADM} FROM uptake_group GROUP BY 1"
add("agg_13_sum_per_country", "uptake_group", lambda df: agg.sum_by(df, ["COUNTRY"], ADM), _ADM_PER_COUNTRY)
add(
    "agg_14_leader_by_total", "uptake_group", lambda df: agg.leader(agg.sum_by(df, ["COUNTRY"], ADM), "COUNTRY", ADM),
    _ADM_PER_COUNTRY + f" ORDER BY {ADM} DESC, COUNTRY LIMIT 1",
)
_KNOWN_SQL = f"""known AS (SELECT COUNTRY, DATE, "GROUP", {COV} FROM uptake_group WHERE {COV} IS NOT NULL
       QUALIFY ROW_NUMBER() OVER (PARTITION BY COUNTRY ORDER BY DATE DESC, "GROUP") = 1)"""
add(
    "agg_14_leader_by_coverage", "uptake_group",
    lambda df: rounded(agg.leader(lat.latest_known_per_key(df, ["COUNTRY"], "DATE", COV, ["GROUP"]), "COUNTRY", COV)),
    f"WITH {_KNOWN_SQL} SELECT COUNTRY, ROUND({COV}, 6) AS {COV} FROM known ORDER BY {COV} DESC, COUNTRY LIMIT 1",
)
_WEIGHTED_SQL = f"""SELECT DATE, ROUND(SUM({COV} * {POP}) / SUM({POP}), 6) AS {COV} FROM uptake_group
        WHERE {COV} IS NOT NULL AND {POP} IS NOT NULL GROUP BY 1"""
add(
    "agg_15_weighted_mean", "uptake_group",
    lambda df: rounded(agg.weighted_mean_by(df, ["DATE"], COV, POP)), _WEIGHTED_SQL,
)
add(
    "agg_15_weighted_or_plain", "uptake_group",
    lambda df: rounded(agg.weighted_or_plain_mean_by(df, ["DATE"], COV, POP)), _WEIGHTED_SQL,
)
add(
    "agg_16_plain_fallback", "uptake_group",
    lambda df: rounded(agg.weighted_or_plain_mean_by(df.where(F.col("GROUP") == "pw"), ["DATE"], COV, POP)),
    f"""SELECT DATE, ROUND(AVG({COV}), 6) AS {COV} FROM uptake_group WHERE "GROUP" = 'pw' GROUP BY 1""",
)


def _with_labels(df: DataFrame) -> DataFrame:
    return cln.label_codes(df, "GROUP", "GROUP_LABEL", TARGET_GROUP_LABELS)


add(
    "agg_17_sum_per_date_group", "uptake_group", lambda df: agg.sum_by(_with_labels(df), ["DATE", "GROUP_LABEL"], ADM),
    f"SELECT DATE, {_LABEL_SQL} AS GROUP_LABEL, CAST(COALESCE(SUM({ADM}), 0) AS BIGINT) AS {ADM} FROM uptake_group GROUP BY 1, 2",
)
add(
    "agg_18_mean_per_date_group", "uptake_group",
    lambda df: rounded(agg.mean_by(_with_labels(df).dropna(subset=[COV]), ["DATE", "GROUP_LABEL"], [COV])),
    f"SELECT DATE, {_LABEL_SQL} AS GROUP_LABEL, ROUND(AVG({COV}), 6) AS {COV} FROM uptake_group WHERE {COV} IS NOT NULL GROUP BY 1, 2",
)
add(
    "agg_19_region_totals", "surveillance",
    lambda df: lat.region_totals(agg.with_region_group(latest(df), BOTH, REGION, PLACE, PARTS), "Region_group"),
    f"""WITH {LATEST_SQL} SELECT {REGION_GROUP} AS Region_group, SUM(Cumulative_cases) AS Cumulative_cases,
        SUM(Cumulative_deaths) AS Cumulative_deaths FROM latest GROUP BY 1 HAVING SUM(Cumulative_cases) > 0""",
)
add(
    "agg_20_surveillance_figures", "surveillance",
    lambda df: rounded(lat.surveillance_figures(latest(sel.in_period(df, DAY, PERIOD)))),
    f"""WITH inside AS (SELECT * FROM surveillance WHERE Date_reported {BETWEEN}),
        {LATEST_SQL.replace("FROM surveillance", "FROM inside")}
        SELECT CAST(SUM(Cumulative_cases) AS BIGINT) AS total_cases, CAST(SUM(Cumulative_deaths) AS BIGINT) AS total_deaths,
               ROUND(SUM(Cumulative_deaths) / SUM(Cumulative_cases) * 100, 6) AS fatality_ratio FROM latest""",
)
add(
    "agg_21_uptake_figures", "uptake_group", lambda df: rounded(lat.uptake_figures(df, "DATE", ADM, COV, "COUNTRY")),
    f"""SELECT MAX(DATE) AS latest_date, CAST(COALESCE(SUM({ADM}), 0) AS DOUBLE) AS total_doses,
               ROUND(AVG({COV}), 6) AS mean_coverage, COUNT(DISTINCT COUNTRY) AS members FROM uptake_group""",
)
_VARIABLES = ["negative_interactions_count", "positive_interactions_count", *_SCORES]
_CORR_SQL = " UNION ALL ".join(
    f"SELECT '{x}' AS variable, '{y}' AS other, ROUND(CORR({a}, {b}), 6) AS correlation FROM wellbeing"
    for a, b in [*combinations(_VARIABLES, 2), *[(v, v) for v in _VARIABLES]]
    for x, y in sorted({(a, b), (b, a)})
)
add("agg_22_correlations", "wellbeing", lambda df: rounded(agg.correlation_matrix(df, _VARIABLES)), _CORR_SQL)
add(
    "agg_23_histogram", "weather", lambda df: rounded(agg.histogram(df, "Temperature")),
    """WITH b AS (SELECT MIN(Temperature) AS lo, MAX(Temperature) AS hi FROM weather),
       n AS (SELECT LEAST(CAST(FLOOR(20 * (Temperature - lo) / (hi - lo)) AS BIGINT) + 1, 20) AS bin, COUNT(*) AS n
             FROM weather, b WHERE Temperature IS NOT NULL GROUP BY 1)
       SELECT i AS bin, ROUND(lo + (i - 1) * ((hi - lo) / 20), 6) AS lower, ROUND(lo + i * ((hi - lo) / 20), 6) AS upper,
              COALESCE(n, 0) AS "count" FROM range(1, 21) AS r(i) CROSS JOIN b LEFT JOIN n ON n.bin = i""",
)
add(
    "agg_24_row_of_maximum", "weather", lambda df: agg.row_of_maximum(df, "Rainfall", ["row_key", "City"], "row_key"),
    "SELECT row_key, City FROM weather ORDER BY Rainfall DESC NULLS LAST, row_key LIMIT 1",
)
add(
    "agg_25_mean_and_first", "sales",
    lambda df: agg.mean_and_first(df.dropna(subset=["list_price"]), "list_price", SALES_ROW).withColumn("list_price_mean", F.round("list_price_mean", 6)),
    f"""SELECT ROUND(AVG(list_price), 6) AS list_price_mean,
               (SELECT list_price FROM sales WHERE list_price IS NOT NULL ORDER BY {", ".join(SALES_ROW)} LIMIT 1) AS list_price_first
        FROM sales""",
)
add(
    "join_02_group_maximum", "surveillance",
    lambda df: agg.group_maximum(df.select(DAY, PLACE, "New_deaths"), [PLACE], "New_deaths", bounded=True),
    "SELECT Country, Date_reported, New_deaths, MAX(New_deaths) OVER (PARTITION BY Country) AS group_max FROM surveillance",
)
add(
    "win_03_group_maximum_by_two", "uptake_group",
    lambda df: rounded(agg.group_maximum(df.select("COUNTRY", "GROUP", "DATE", COV), ["COUNTRY", "GROUP"], COV, bounded=True)),
    f"""SELECT COUNTRY, "GROUP", DATE, ROUND({COV}, 6) AS {COV}, ROUND(MAX({COV}) OVER (PARTITION BY COUNTRY, "GROUP"), 6) AS group_max
        FROM uptake_group""",
)
add(
    "join_03_same_region", "surveillance",
    lambda df: agg.in_same_group(df, REGION, PLACE, ["NATION_1", "NATION_4"]).select(REGION, PLACE, DAY),
    """SELECT WHO_region, Country, Date_reported FROM surveillance
       WHERE WHO_region IN (SELECT WHO_region FROM surveillance WHERE Country IN ('NATION_1', 'NATION_4'))""",
)
add(
    "join_04_statistics_on_rows", "sales",
    lambda df: rounded(agg.zscores(df.select(*SALES_ROW, "quantity"), "quantity", 2.0)),
    f"""WITH stats AS (SELECT AVG(quantity) AS m, STDDEV_SAMP(quantity) AS s FROM sales)
        SELECT {", ".join(SALES_ROW)}, quantity, ROUND((quantity - m) / (s + 1e-9), 6) AS zscore,
               ABS((quantity - m) / (s + 1e-9)) > 2 AS anomaly FROM sales, stats""",
)
add(
    "set_04_regions_and_countries", "surveillance",
    lambda df: agg.regions_and_entities(
        agg.region_over_time(df, "New_cases", BOTH, REGION, PLACE, DAY, PARTS),
        agg.metric_over_time(sel.members_only(df, PLACE, ["NATION_1", "NATION_3"]), "New_cases", DAY, PLACE),
        REGION, PLACE, DAY, "New_cases",
    ),
    f"""WITH split AS (SELECT {REGION_GROUP} AS name, 'region' AS kind, Date_reported, New_cases FROM surveillance
                       UNION ALL SELECT Country, 'country', Date_reported, New_cases FROM surveillance
                       WHERE Country IN ('NATION_1', 'NATION_3'))
        SELECT name, kind, Date_reported, COALESCE(SUM(New_cases), 0) AS New_cases FROM split GROUP BY 1, 2, 3""",
)

_ALL_SERIES = f"""WITH kinds AS (SELECT Country AS name, 'country' AS kind, * FROM surveillance WHERE Country IS NOT NULL
      UNION ALL SELECT WHO_region, 'region', * FROM surveillance WHERE WHO_region IS NOT NULL
      UNION ALL SELECT {REGION_GROUP}, 'split region', * FROM surveillance)"""
add(
    "set_04_all_series_in_one_pass", "surveillance", lambda df: agg.all_series(df, "New_cases", BOTH, REGION, PLACE, DAY, PARTS),
    _ALL_SERIES + " SELECT name, kind, Date_reported, COALESCE(SUM(New_cases), 0) AS New_cases FROM kinds WHERE Date_reported IS NOT NULL GROUP BY 1, 2, 3",
)
add(
    "agg_07_all_rates_in_one_pass", "surveillance", lambda df: rounded(agg.all_series(df, "Fatality_rate", BOTH, REGION, PLACE, DAY, PARTS)),
    _ALL_SERIES + " " + _RATIO_SQL.format(keys="name, kind, Date_reported", source="kinds", groups="1, 2, 3"),
)


# Latest rows and rankings

add("win_01_latest_per_country", "surveillance", latest, f"WITH {LATEST_SQL} SELECT * FROM latest")
add(
    "win_02_latest_known", "uptake_group",
    lambda df: rounded(lat.latest_known_per_key(df, ["COUNTRY"], "DATE", COV, ["GROUP"]).select("COUNTRY", "DATE", "GROUP", COV)),
    f'WITH {_KNOWN_SQL} SELECT COUNTRY, DATE, "GROUP", ROUND({COV}, 6) AS {COV} FROM known',
)
def _add_top(name: str, view: str, metric: str, who: str, run, sql: str) -> None:
    """A report of the highest rows with their ranks."""
    add(name, view, lambda df: lat.with_rank(run(df), metric, who),
        f"SELECT *, ROW_NUMBER() OVER (ORDER BY {metric} DESC NULLS LAST, {who}) AS rank FROM ({sql}) AS best")


_add_top(
    "top_01_latest_cases", "surveillance", CASES, PLACE, lambda df: lat.top_latest(df, "New_cases", 10, PLACE, DAY),
    f"WITH {LATEST_SQL} SELECT Country, Cumulative_cases FROM latest ORDER BY 2 DESC, 1 LIMIT 10",
)
_add_top(
    "top_02_latest_deaths", "surveillance", "Cumulative_deaths", PLACE, lambda df: lat.top_latest(df, "New_deaths", 5, PLACE, DAY),
    f"WITH {LATEST_SQL} SELECT Country, Cumulative_deaths FROM latest ORDER BY 2 DESC, 1 LIMIT 5",
)
_add_top(
    "top_02_latest_ratio", "surveillance", "Fatality_rate", PLACE, lambda df: rounded(lat.top_latest(df, "Fatality_rate", 5, PLACE, DAY)),
    f"""WITH {LATEST_SQL} SELECT Country, {_RATE_SQL} AS Fatality_rate FROM latest WHERE Cumulative_cases >= 1000
        ORDER BY Cumulative_deaths / Cumulative_cases DESC, 1 LIMIT 5""",
)
_add_top(
    "top_03_snapshot", "uptake_monthly", "COVID_VACCINE_ADM_TOT_DOSES", "COUNTRY",
    lambda df: lat.top_of_snapshot(sel.snapshot(df, "DATE", "1998-05-31"), "COVID_VACCINE_ADM_TOT_DOSES", 10, "COUNTRY").select("COUNTRY", "COVID_VACCINE_ADM_TOT_DOSES"),
    """SELECT COUNTRY, COVID_VACCINE_ADM_TOT_DOSES FROM uptake_monthly WHERE DATE = DATE '1998-05-31'
       AND COVID_VACCINE_ADM_TOT_DOSES IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 10""",
)
_add_top(
    "top_04_by_total", "uptake_group", ADM, "COUNTRY", lambda df: lat.top_total(df, ADM, 10, "COUNTRY"),
    _ADM_PER_COUNTRY + f" ORDER BY {ADM} DESC, COUNTRY LIMIT 10",
)
_add_top(
    "top_04_by_latest_coverage", "uptake_group", COV, "COUNTRY",
    lambda df: rounded(lat.top_latest_known(df, COV, 10, "COUNTRY", "DATE", ["GROUP"])),
    f"WITH {_KNOWN_SQL} SELECT COUNTRY, ROUND({COV}, 6) AS {COV} FROM known ORDER BY {COV} DESC, COUNTRY LIMIT 10",
)
add(
    "top_05_by_date_country", "surveillance",
    lambda df: sel.in_period(df, DAY, PERIOD).orderBy(DAY, PLACE).select(DAY, PLACE, "New_cases"),
    f"SELECT Date_reported, Country, New_cases FROM surveillance WHERE Date_reported {BETWEEN} ORDER BY 1, 2",
)
add(
    "top_05_by_date_country_group", "uptake_group",
    lambda df: df.orderBy("DATE", "COUNTRY", "GROUP").select("DATE", "COUNTRY", "GROUP", ADM),
    f'SELECT DATE, COUNTRY, "GROUP", {ADM} FROM uptake_group ORDER BY 1, 2, 3',
)


# Two entities and map tables

_PAIR = ["NATION_2", "NATION_9"]
_PAIR_SQL = f"pair AS (SELECT * FROM surveillance WHERE Country IN ('NATION_2', 'NATION_9') AND Date_reported {BETWEEN})"


def _pair(df: DataFrame) -> DataFrame:
    return sel.two_entities(df, PLACE, _PAIR, DAY, PERIOD)


add(
    "cmp_01_latest_summary", "surveillance", lambda df: rounded(cmp.latest_summary(_pair(df), PLACE, DAY)),
    f"""WITH {_PAIR_SQL}, {LATEST_SQL.replace("FROM surveillance", "FROM pair")}
        SELECT Country, Cumulative_cases, Cumulative_deaths, {_RATE_SQL} AS Fatality_ratio FROM latest""",
)
add(
    "cmp_02_overlay", "surveillance", lambda df: agg.metric_over_time(_pair(df), "New_cases", DAY, PLACE),
    f"WITH {_PAIR_SQL} SELECT Country, Date_reported, COALESCE(SUM(New_cases), 0) AS New_cases FROM pair GROUP BY 1, 2",
)
add(
    "cmp_03_normalised", "surveillance",
    lambda df: rounded(cmp.normalised(_pair(df), PLACE, CASES).select(PLACE, DAY, "normalised")),
    f"""WITH {_PAIR_SQL} SELECT Country, Date_reported,
        ROUND(Cumulative_cases / COALESCE(NULLIF(MAX(Cumulative_cases) OVER (PARTITION BY Country), 0), 1), 6) AS normalised FROM pair""",
)
add(
    "cmp_04_ratio_over_time", "surveillance",
    lambda df: rounded(cmp.ratio_over_time(_pair(df)).select(PLACE, DAY, "fatality_ratio")),
    f"""WITH {_PAIR_SQL} SELECT Country, Date_reported,
        ROUND(COALESCE(Cumulative_deaths / NULLIF(Cumulative_cases, 0) * 100, 0), 6) AS fatality_ratio FROM pair""",
)
_TWO_REGIONS_SQL = f"pair AS (SELECT * FROM surveillance WHERE WHO_region IN ('ASIA', 'EUROPE') AND Date_reported {BETWEEN})"


def _two_regions(df: DataFrame) -> DataFrame:
    return sel.two_entities(df, REGION, ["ASIA", "EUROPE"], DAY, PERIOD)


add(
    "cmp_05_regions_last_row", "surveillance",
    lambda df: rounded(cmp.latest_summary(_two_regions(df), REGION, DAY, [PLACE])),
    f"""WITH {_TWO_REGIONS_SQL} SELECT WHO_region, Cumulative_cases, Cumulative_deaths, {_RATE_SQL} AS Fatality_ratio FROM pair
        QUALIFY ROW_NUMBER() OVER (PARTITION BY WHO_region ORDER BY Date_reported DESC, Country) = 1""",
)
add(
    "cmp_05_regions_summed", "surveillance",
    lambda df: rounded(cmp.latest_region_summary(_two_regions(df), REGION, PLACE, DAY)),
    f"""WITH {_TWO_REGIONS_SQL}, {LATEST_SQL.replace("FROM surveillance", "FROM pair")}
        SELECT WHO_region, SUM(Cumulative_cases) AS Cumulative_cases, SUM(Cumulative_deaths) AS Cumulative_deaths,
               ROUND(SUM(Cumulative_deaths) / SUM(Cumulative_cases) * 100, 6) AS Fatality_ratio FROM latest GROUP BY 1""",
)
add(
    "cmp_05_regions_overlay", "surveillance", lambda df: agg.sum_by(_two_regions(df), [REGION, DAY], "New_cases"),
    f"WITH {_TWO_REGIONS_SQL} SELECT WHO_region, Date_reported, COALESCE(SUM(New_cases), 0) AS New_cases FROM pair GROUP BY 1, 2",
)
add(
    "geo_01_bubble_map", "surveillance", lambda df: rounded(cmp.bubble_map(latest(df), PLACE)),
    f"""WITH {LATEST_SQL} SELECT Country, Cumulative_cases, Cumulative_deaths, ROUND(rate, 6) AS Fatality_rate,
        ROUND(LEAST(rate, 5), 6) AS Fatality_rate_plot FROM (SELECT *, CASE WHEN Cumulative_cases >= 1000
        THEN Cumulative_deaths / Cumulative_cases * 100 ELSE 0 END AS rate FROM latest) AS r""",
)
_SCATTER_SQL = f"""WITH {LATEST_SQL} SELECT Country, {REGION_GROUP} AS Region_group, Cumulative_cases, Cumulative_deaths,
        {_RATE_SQL} AS Fatality_rate{{more}} FROM latest WHERE Cumulative_cases >= 1000"""
add(
    "geo_02_country_scatter", "surveillance",
    lambda df: rounded(cmp.member_scatter(latest(df), BOTH, ["NATION_3"], REGION, PLACE, PARTS)),
    _SCATTER_SQL.format(more=", CASE WHEN Country = 'NATION_3' THEN 'Selected' ELSE 'Other' END AS Highlight"),
)
add(
    "geo_02_country_scatter_plain", "surveillance",
    lambda df: rounded(cmp.member_scatter(latest(df), BOTH, [], REGION, PLACE, PARTS)),
    _SCATTER_SQL.format(more=""),
)
add(
    "geo_03_region_scatter", "surveillance",
    lambda df: cmp.region_scatter(latest(df), BOTH, ["NATION_3", "NATION_1"], REGION, PLACE, PARTS),
    f"""WITH {LATEST_SQL}, grouped AS (SELECT *, {REGION_GROUP} AS g FROM latest),
        held AS (SELECT DISTINCT g FROM grouped WHERE Country IN ('NATION_3', 'NATION_1'))
        SELECT g AS Region_group, SUM(Cumulative_cases) AS Cumulative_cases, SUM(Cumulative_deaths) AS Cumulative_deaths,
               CASE WHEN g IN (SELECT g FROM held) THEN 'Selected' ELSE 'Other' END AS Highlight,
               CAST(CASE WHEN g IN (SELECT g FROM held) THEN 18 ELSE 10 END AS BIGINT) AS Size
        FROM grouped GROUP BY g HAVING SUM(Cumulative_cases) > 0""",
)
add(
    "geo_04_choropleth", "uptake_monthly",
    lambda df: rounded(cmp.choropleth(sel.snapshot(df, "DATE"), "COUNTRY", "COVID_VACCINE_COV_TOT_CPS")),
    """SELECT COUNTRY, ROUND(COVID_VACCINE_COV_TOT_CPS, 6) AS COVID_VACCINE_COV_TOT_CPS FROM uptake_monthly
       WHERE DATE = (SELECT MAX(DATE) FROM uptake_monthly)""",
)


# Time series

# Rule -> (period end of a day, first of the generated dates, step, period end of a generated date)
_RULES = {
    "D": ("order_date", "MIN(ds)", "1 DAY", "g"),
    "W": ("order_date + CAST((7 - isodow(order_date)) AS INTEGER)", "MIN(ds)", "7 DAY", "g"),
    "M": ("LAST_DAY(order_date)", "date_trunc('month', MIN(ds))", "1 MONTH", "LAST_DAY(g)"),
    "Q": ("LAST_DAY(CAST(date_trunc('quarter', order_date) + INTERVAL 2 MONTH AS DATE))", "date_trunc('month', MIN(ds))", "3 MONTH", "LAST_DAY(g)"),
    "Y": ("make_date(YEAR(order_date), 12, 31)", "date_trunc('month', MIN(ds))", "12 MONTH", "LAST_DAY(g)"),
}


def _resample_sql(rule: str) -> str:
    end, first, step, label = _RULES[rule]
    return f"""WITH filled AS (SELECT sku, CAST({end} AS DATE) AS ds, SUM(quantity) AS y FROM sales
                    WHERE order_date IS NOT NULL AND sku IS NOT NULL GROUP BY 1, 2),
        dates AS (SELECT sku, CAST(UNNEST(generate_series(CAST({first} AS TIMESTAMP), CAST(MAX(ds) AS TIMESTAMP), INTERVAL {step})) AS DATE) AS g
                  FROM filled GROUP BY sku),
        spine AS (SELECT sku, {label} AS ds FROM dates)
        SELECT s.sku, s.ds, COALESCE(f.y, 0) AS y FROM spine s LEFT JOIN filled f ON f.sku = s.sku AND f.ds = s.ds"""


for _rule in _RULES:
    add(
        f"ts_01_resample_{_rule.lower()}", "sales",
        lambda df, rule=_rule: tser.resample(df, "order_date", "quantity", rule, keys=["sku"]),
        _resample_sql(_rule),
    )
add(
    "ts_01_resample_mean", "sales",
    lambda df: rounded(tser.resample(df, "order_date", "quantity", "M", "mean")),
    "SELECT LAST_DAY(order_date) AS ds, ROUND(AVG(quantity), 6) AS y FROM sales GROUP BY 1",
)
add(
    "ts_02_price_and_profit", "sales",
    lambda df: rounded(tser.resample_many(df, "order_date", "M", {"list_price": "mean", "profit": "sum"}, ["sku"]).withColumn("profit", F.round("profit", 4))),
    """SELECT sku, LAST_DAY(order_date) AS ds, ROUND(AVG(list_price), 6) AS list_price, ROUND(SUM(profit), 4) AS profit
       FROM sales GROUP BY 1, 2 HAVING AVG(list_price) IS NOT NULL""",
)
add(
    "ts_03_future_months", "sales",
    lambda df: tser.future_periods(df.select("dealer", F.col("order_date").alias("ds")), 12, "M", ["dealer"]),
    """SELECT dealer, LAST_DAY(CAST(date_trunc('month', m) + to_months(CAST(i AS INTEGER) + CASE WHEN LAST_DAY(m) > m THEN 0 ELSE 1 END) AS DATE)) AS ds
       FROM (SELECT dealer, MAX(order_date) AS m FROM sales GROUP BY 1) AS l CROSS JOIN range(12) AS r(i)""",
)
add(
    "ts_03_future_by_gap", "sales",
    lambda df: tser.future_by_gap(df.select("dealer", F.col("order_date").alias("ds")).distinct(), 5, ["dealer"]),
    """WITH days AS (SELECT dealer, order_date AS d, ROW_NUMBER() OVER (PARTITION BY dealer ORDER BY order_date DESC) AS n
                     FROM (SELECT DISTINCT dealer, order_date FROM sales)),
       ends AS (SELECT dealer, MAX(d) AS last, COALESCE(MAX(CASE WHEN n = 1 THEN d END) - MAX(CASE WHEN n = 2 THEN d END), 1) AS gap
                FROM days WHERE n <= 2 GROUP BY 1)
       SELECT dealer, CAST(last + CAST(gap * (i + 1) AS INTEGER) AS DATE) AS ds FROM ends CROSS JOIN range(5) AS r(i)""",
)
add(
    "ts_04_trend", "sales", lambda df: tser.trend(df, "order_date", "quantity"),
    "SELECT order_date, quantity FROM sales ORDER BY 1, 2",
)


def _lags_sql(source: str, depth: int, windows: tuple[int, ...], keys: str, order: str, shown: str) -> str:
    over = f"PARTITION BY {keys} ORDER BY {order}" if keys else f"ORDER BY {order}"
    lags = ", ".join(f"LAG(y, {k}) OVER ({over}) AS lag_{k}" for k in range(1, depth + 1))
    rolls = ", ".join(
        f"ROUND(AVG(y) OVER ({over} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING), 6) AS roll_mean_{w}" for w in windows
    )
    return f"SELECT {shown}, y, {lags}, {rolls} FROM {source}"


_MONTHLY_SQL = """WITH counts AS (SELECT dealer, LAST_DAY(order_date) AS ds, SUM(quantity) AS y FROM sales GROUP BY 1, 2)"""


def _monthly(df: DataFrame) -> DataFrame:
    return tser.resample(df, "order_date", "quantity", "M", keys=["dealer"])


add(
    "win_04_lags_and_means", "sales",
    lambda df: rounded(tser.lag_features(_monthly(df), (1, 3), (3,), ["dealer"], drop_warm_up=False)),
    f"{_MONTHLY_SQL} {_lags_sql('counts', 3, (3,), 'dealer', 'ds', 'dealer, ds')}",
)
add(
    "win_05_rolling_means", "sales",
    lambda df: rounded(tser.lag_features(_monthly(df), (1,), (3, 7), ["dealer"], drop_warm_up=False).drop("lag_1")),
    f"{_MONTHLY_SQL} SELECT * EXCLUDE (lag_1) FROM ({_lags_sql('counts', 1, (3, 7), 'dealer', 'ds', 'dealer, ds')}) AS l",
)
add(
    "win_06_without_warm_up", "sales",
    lambda df: rounded(tser.lag_features(_monthly(df), (2,), (3,), ["dealer"])),
    f"{_MONTHLY_SQL} SELECT * FROM ({_lags_sql('counts', 2, (3,), 'dealer', 'ds', 'dealer, ds')}) AS l WHERE lag_2 IS NOT NULL",
)
add(
    "win_04_lags_of_raw_rows", "weather",
    lambda df: rounded(tser.lag_features_unbounded(
        df.select("row_key", "City", F.col("Humidity").alias("y")), ["row_key"], (1, 2), (3,), ["City"], block_size=500, drop_warm_up=False)),
    f"""WITH rows_ AS (SELECT row_key, City, Humidity AS y FROM weather)
        SELECT row_key, City, ROUND(y, 6) AS y, ROUND(lag_1, 6) AS lag_1, ROUND(lag_2, 6) AS lag_2, roll_mean_3
        FROM ({_lags_sql('rows_', 2, (3,), 'City', 'row_key', 'row_key, City')}) AS l""",
)
add(
    "win_07_fill_regular_series", "sales",
    lambda df: rounded(ordered.fill_regular_series(
        tser.resample(df, "order_date", "list_price", "D", "mean", ["sku"]), "y", ["ds"], ["sku"]), 8),
    """WITH filled AS (SELECT sku, order_date AS ds, AVG(list_price) AS y FROM sales GROUP BY 1, 2),
       spine AS (SELECT sku, CAST(UNNEST(generate_series(CAST(MIN(ds) AS TIMESTAMP), CAST(MAX(ds) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS ds
                 FROM filled GROUP BY sku)
       SELECT s.sku, s.ds, ROUND(COALESCE(LAST_VALUE(f.y IGNORE NULLS) OVER (PARTITION BY s.sku ORDER BY s.ds
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), FIRST_VALUE(f.y IGNORE NULLS) OVER (PARTITION BY s.sku ORDER BY s.ds
              ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) AS y
       FROM spine s LEFT JOIN filled f ON f.sku = s.sku AND f.ds = s.ds""",
)
add(
    "fc_01_training_frame", "sales",
    lambda df: rounded(tser.lag_features(_monthly(df), range(1, 8), (3, 7), ["dealer"])),
    f"{_MONTHLY_SQL} SELECT * FROM ({_lags_sql('counts', 7, (3, 7), 'dealer', 'ds', 'dealer, ds')}) AS l WHERE lag_7 IS NOT NULL",
)
add(
    "fc_04_demand_window", "sales",
    lambda df: tser.resample(sel.in_period(df, "order_date", PERIOD), "order_date", "quantity", "M"),
    f"SELECT LAST_DAY(order_date) AS ds, SUM(quantity) AS y FROM sales WHERE order_date {BETWEEN} GROUP BY 1",
)
