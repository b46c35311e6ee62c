"""Cleaning, profiling, filter and derived-column queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeframe.functions.categories import (
    ACTIVITY_BINS,
    SLEEP_BINS,
    TARGET_GROUP_LABELS,
    UPTAKE_MEASURES,
    WELLBEING_METRICS,
    binned,
    highlight,
    highlight_size,
)
from gaugeframe.functions.ratios import clip_upper, percent, percent_above, percent_or_zero
from gaugeframe.functions.regions import region_condition
from gaugeframe.functions.text import big_number_text, percent_text
from gaugeframe.operators import aggregation as agg
from gaugeframe.operators import cleaning as cln
from gaugeframe.operators import comparison as cmp
from gaugeframe.operators import latest as lat
from gaugeframe.operators import ordered
from gaugeframe.operators import profiling as prf
from gaugeframe.operators import selection as sel
from gaugeframe.plans.registry import add, add_over_tables, rounded
from gaugeframe.plans.views import PARTS, PERIOD, SALES_ROW
from gaugeframe.session import shared_folder
from gaugeframe.sources.flatfiles import read_csv, read_csv_checked, read_table, write_csv

BETWEEN = f"BETWEEN DATE '{PERIOD[0]}' AND DATE '{PERIOD[1]}'"
IN_WEST = "WHO_region = 'EUROPE' AND Country IN ('NATION_3', 'NATION_8')"
IN_EAST = "WHO_region = 'EUROPE' AND Country IN ('NATION_13', 'NATION_18')"
REGION_GROUP = (
    f"CASE WHEN {IN_EAST} THEN 'East Europe' WHEN {IN_WEST} THEN 'West Europe' ELSE COALESCE(WHO_region, 'nan') END"
)
BOTH = ["ASIA", "West Europe", "East Europe"]


# Files

def _csv_round_trip(df: DataFrame) -> DataFrame:
    """Write the table as CSV to the shared folder and read it back with its schema."""
    path = shared_folder(df.sparkSession, "csv")
    write_csv(df, path)
    return read_csv(df.sparkSession, path, df.schema)


add(
    "src_01_snk_01_csv_round_trip", "weather", _csv_round_trip,
    'SELECT row_key, Date, City, Temperature, Humidity, "Wind Speed", Rainfall FROM weather',
)


def _text_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with quotes, commas, padding and line breaks, and missing and empty texts beside them."""
    key, text = F.col("doc_id"), F.col("text")
    odd = F.when(key % 7 == 0, F.concat(F.lit(' "a ""b"", c\n'), text, F.lit("  "))).when(key % 11 == 0, F.lit("")).when(key % 13 != 0, text)
    path = shared_folder(spark, "csv")
    df = read_table(spark, sf_dir, "documents").select("doc_id", odd.alias("text"))
    write_csv(df, path)
    return read_csv(spark, path, df.schema, line_breaks=True)


add_over_tables(
    "src_01_snk_01_text_round_trip", _text_round_trip,
    """SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN ' "a ""b"", c' || chr(10) || text || '  ' WHEN doc_id % 11 = 0 THEN ''
              WHEN doc_id % 13 <> 0 THEN text END AS text FROM documents""",
)

def _checked_csv(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as lines of a file some of which lack a field, have one too many, or hold words where numbers and dates belong."""
    key, names = F.col("o_orderkey"), ["o_orderkey", "order_day", "o_totalprice"]
    day = F.when(key % 7 == 0, F.lit("n/a")).when(key % 11 == 0, F.lit("2020-13-45")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    price = F.when(key % 13 == 0, F.lit("unknown")).otherwise(F.format_string("%.2f", "o_totalprice"))
    line = F.when(key % 17 == 0, F.concat_ws(",", key, day)).when(key % 19 == 0, F.concat_ws(",", key, day, price, F.lit("more"))).otherwise(F.concat_ws(",", key, day, price))
    path = shared_folder(spark, "csv")
    lines = read_table(spark, sf_dir, "orders").select(line.alias(",".join(names)))
    lines.write.options(header=True, quote="", sep="\x01").csv(path)
    return read_csv_checked(spark, path, T.StructType.fromDDL("o_orderkey long, order_day date, o_totalprice double"))


_CHECKED_SQL = """WITH fields AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN '2020-13-45'
        ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day, CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' ELSE printf('%.2f', o_totalprice) END AS price FROM orders),
    judged AS (SELECT *, k % 17 = 0 OR k % 19 = 0 AS broken, day = '2020-13-45' AS bad_day, price = 'unknown' AS bad_price FROM fields)"""
add_over_tables(
    "src_01_checked_rows", lambda spark, sf_dir: _checked_csv(spark, sf_dir)[0],
    _CHECKED_SQL + """ SELECT k AS o_orderkey, TRY_CAST(day AS DATE) AS order_day, price::DOUBLE AS o_totalprice FROM judged
        WHERE NOT broken AND NOT bad_day AND NOT bad_price""",
)
add_over_tables(
    "src_01_quarantine", lambda spark, sf_dir: _checked_csv(spark, sf_dir)[1].select("text", "reason"),
    _CHECKED_SQL + """ SELECT CASE WHEN k % 17 = 0 THEN k || ',' || day WHEN k % 19 = 0 THEN k || ',' || day || ',' || price || ',more'
          ELSE k || ',' || CASE WHEN day = 'n/a' THEN '' ELSE day END || ',' || price END AS text,
        CASE WHEN broken THEN 'wrong number of fields' WHEN bad_day AND bad_price THEN 'order_day: no date; o_totalprice: no double'
          WHEN bad_day THEN 'order_day: no date' ELSE 'o_totalprice: no double' END AS reason
        FROM judged WHERE broken OR bad_day OR bad_price""",
)


# Cleaning

def _dates_as_text(spark: SparkSession, sf_dir: str, with_bad: bool) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    if with_bad:
        text = F.when(key % 7 == 0, F.lit("n/a")).when(key % 11 == 0, F.lit("2020-13-45")).otherwise(text)
    return read_table(spark, sf_dir, "orders").select("o_orderkey", text.alias("order_day"))


add_over_tables(
    "cln_01_lenient_dates",
    lambda spark, d: cln.parse_dates(_dates_as_text(spark, d, True), "order_day"),
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' WHEN o_orderkey % 11 = 0 THEN '2020-13-45'
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS DATE) AS order_day FROM orders""",
)
add_over_tables(
    "cln_02_strict_dates",
    lambda spark, d: cln.parse_dates_strict(_dates_as_text(spark, d, False), "order_day"),
    "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS order_day FROM orders",
)
add(
    "cln_03_fill_new_counts", "surveillance",
    lambda df: cln.fill_constant(df, ["New_cases", "New_deaths"]),
    """SELECT Date_reported, Country, WHO_region, COALESCE(New_cases, 0) AS New_cases,
              COALESCE(New_deaths, 0) AS New_deaths, Cumulative_cases, Cumulative_deaths FROM surveillance""",
)
add(
    "cln_03_fill_all_counts", "surveillance",
    lambda df: cln.fill_constant(df, ["New_cases", "New_deaths", "Cumulative_cases", "Cumulative_deaths"]),
    """SELECT Date_reported, Country, WHO_region, COALESCE(New_cases, 0) AS New_cases,
              COALESCE(New_deaths, 0) AS New_deaths, COALESCE(Cumulative_cases, 0) AS Cumulative_cases,
              COALESCE(Cumulative_deaths, 0) AS Cumulative_deaths FROM surveillance""",
)
add(
    "cln_03_fill_doses", "uptake_group",
    lambda df: cln.fill_constant(df, ["COVID_VACCINE_ADM_1D"]).select("DATE", "COUNTRY", "GROUP", "COVID_VACCINE_ADM_1D"),
    'SELECT DATE, COUNTRY, "GROUP", COALESCE(COVID_VACCINE_ADM_1D, 0) AS COVID_VACCINE_ADM_1D FROM uptake_group',
)
add(
    "cln_04_fill_medians", "sales",
    lambda df: rounded(cln.fill_medians(df, ["list_price", "quantity"]).select(*SALES_ROW, "list_price", "quantity"), 8),
    """SELECT row_key, row_line, row_part, row_supp,
              ROUND(COALESCE(list_price, (SELECT quantile_cont(list_price, 0.5) FROM sales)), 8) AS list_price,
              COALESCE(quantity, (SELECT quantile_cont(quantity, 0.5) FROM sales)) AS quantity FROM sales""",
)
_FILL_SQL = """SELECT row_key, City, COALESCE(
      LAST_VALUE(Temperature IGNORE NULLS) OVER ({p} ORDER BY row_key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      FIRST_VALUE(Temperature IGNORE NULLS) OVER ({p} ORDER BY row_key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ) AS Temperature FROM weather"""
add(
    "cln_05_fill_forward_back", "weather",
    lambda df: cln.fill_forward_back(df.select("row_key", "City", "Temperature"), "Temperature", ["row_key"], ["City"]),
    _FILL_SQL.format(p="PARTITION BY City"),
)
add(
    "cln_05_fill_whole_table", "weather",
    lambda df: cln.fill_forward_back(df.select("row_key", "City", "Temperature"), "Temperature", ["row_key"]),
    _FILL_SQL.format(p=""),
)
add(
    "cln_06_drop_missing", "uptake_group",
    lambda df: rounded(cln.drop_missing(df, ["COVID_VACCINE_COV_1D", "POPULATION"])),
    """SELECT DATE, COUNTRY, "GROUP", COVID_VACCINE_ADM_1D, ROUND(COVID_VACCINE_COV_1D, 6) AS COVID_VACCINE_COV_1D, POPULATION
       FROM uptake_group WHERE COVID_VACCINE_COV_1D IS NOT NULL AND POPULATION IS NOT NULL""",
)
_LABEL_SQL = "CASE \"GROUP\" " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in TARGET_GROUP_LABELS.items()
) + " ELSE \"GROUP\" END"
add(
    "cln_07_label_codes", "uptake_group",
    lambda df: cln.label_codes(df, "GROUP", "GROUP_LABEL", TARGET_GROUP_LABELS).select("DATE", "COUNTRY", "GROUP", "GROUP_LABEL"),
    f'SELECT DATE, COUNTRY, "GROUP", {_LABEL_SQL} AS GROUP_LABEL FROM uptake_group',
)


def _label_join(df: DataFrame) -> DataFrame:
    rows = list(TARGET_GROUP_LABELS.items())
    lookup = df.sparkSession.createDataFrame(rows, "code string, text string")
    return cln.label_codes_by_table(df, "GROUP", "GROUP_LABEL", lookup, "code", "text").select("DATE", "COUNTRY", "GROUP", "GROUP_LABEL")


add(
    "join_01_label_lookup", "uptake_group", _label_join,
    f'SELECT DATE, COUNTRY, "GROUP", {_LABEL_SQL} AS GROUP_LABEL FROM uptake_group',
)


# Profiling

for _n in (5, 100, 200):
    add(
        f"prf_01_preview_{_n}", "weather",
        lambda df, n=_n: rounded(prf.preview(df.select("row_key", "City", "Temperature"), ["row_key"], n)),
        f"SELECT row_key, City, ROUND(Temperature, 6) AS Temperature FROM weather ORDER BY row_key LIMIT {_n}",
    )
_MEASURES = ["list_price", "quantity", "profit"]
_DESCRIBE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", COUNT({c}) AS "count", ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std,
           ROUND(MIN({c}), 8) AS min, ROUND(QUANTILE_CONT({c}, 0.25), 8) AS p25, ROUND(QUANTILE_CONT({c}, 0.5), 8) AS p50,
           ROUND(QUANTILE_CONT({c}, 0.75), 8) AS p75, ROUND(MAX({c}), 8) AS max FROM sales"""
    for c in _MEASURES
)


def _shown(described: DataFrame) -> DataFrame:
    return rounded(described.withColumns({c: F.round(c, 6) for c in ("mean", "std")}), 8)


add("prf_02_describe", "sales", lambda df: _shown(prf.describe(df, _MEASURES)), _DESCRIBE_SQL)
_TEXT_FIGURES = ", ".join(
    f"CAST(CAST(ROUND({f}, 4) AS DECIMAL(28, 4)) AS VARCHAR) AS {n}"
    for n, f in (("mean", "AVG(quantity)"), ("std", "STDDEV_SAMP(quantity)"), ("min", "MIN(quantity)"), ("p25", "QUANTILE_CONT(quantity, 0.25)"),
                 ("p50", "QUANTILE_CONT(quantity, 0.5)"), ("p75", "QUANTILE_CONT(quantity, 0.75)"), ("max", "MAX(quantity)"))
)
add(
    "prf_02_summary_of_any_columns", "sales", lambda df: prf.summary(df.select("quantity", "order_date")).drop("mean", "std", "p25", "p75"),
    f"""SELECT "column", "count", min, p50, max FROM (SELECT 'quantity' AS "column", COUNT(quantity) AS "count", {_TEXT_FIGURES} FROM sales)
        UNION ALL SELECT 'order_date', COUNT(order_date), strftime(MIN(order_date), '%Y-%m-%d %H:%M:%S'),
          strftime(to_timestamp(QUANTILE_CONT(epoch(order_date), 0.5)) AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S'),
          strftime(MAX(order_date), '%Y-%m-%d %H:%M:%S') FROM sales""",
)
add(
    "prf_02_describe_dates", "sales",
    lambda df: prf.describe_dates(df.select("order_date")).select(
        "column", "count", *[F.col(c).cast("date").alias(c) for c in ("mean", "min", "p25", "p50", "p75", "max")]
    ),
    """WITH s AS (SELECT epoch(order_date) AS s FROM sales)
       SELECT 'order_date' AS "column", COUNT(s) AS "count", CAST(to_timestamp(AVG(s)) AT TIME ZONE 'UTC' AS DATE) AS mean,
              CAST(to_timestamp(MIN(s)) AT TIME ZONE 'UTC' AS DATE) AS min,
              CAST(to_timestamp(QUANTILE_CONT(s, 0.25)) AT TIME ZONE 'UTC' AS DATE) AS p25,
              CAST(to_timestamp(QUANTILE_CONT(s, 0.5)) AT TIME ZONE 'UTC' AS DATE) AS p50,
              CAST(to_timestamp(QUANTILE_CONT(s, 0.75)) AT TIME ZONE 'UTC' AS DATE) AS p75,
              CAST(to_timestamp(MAX(s)) AT TIME ZONE 'UTC' AS DATE) AS max FROM s""",
)
add(
    "prf_02_describe_text", "surveillance",
    lambda df: prf.describe_text(df, ["Country", "WHO_region"]),
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", (SELECT COUNT({c}) FROM surveillance) AS "count",
               (SELECT COUNT(DISTINCT {c}) FROM surveillance) AS "unique", * FROM
              (SELECT {c} AS top, COUNT(*) AS freq FROM surveillance WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""
        for c in ("Country", "WHO_region")
    ),
)
add(
    "prf_03_shape", "sales", prf.shape,
    "SELECT COUNT(*) AS row_count, CAST(10 AS BIGINT) AS column_count FROM sales",
)
add("prf_07_distinct_values", "surveillance", lambda df: prf.distinct_values(df, "WHO_region"), "SELECT DISTINCT WHO_region FROM surveillance")
add(
    "prf_08_choices", "surveillance", lambda df: prf.choices(df, "WHO_region"),
    "SELECT DISTINCT WHO_region FROM surveillance WHERE WHO_region IS NOT NULL",
)
add(
    "prf_08_choices_with_all", "wellbeing", lambda df: prf.choices(df, "platform", "All"),
    "SELECT 'All' AS platform UNION ALL SELECT DISTINCT platform FROM wellbeing WHERE platform IS NOT NULL",
)
add(
    "prf_09_dependent_choices", "surveillance",
    lambda df: prf.dependent_choices(df, "Country", region_condition(BOTH, F.col("WHO_region"), F.col("Country"), PARTS)),
    f"SELECT DISTINCT Country FROM surveillance WHERE WHO_region = 'ASIA' OR ({IN_WEST}) OR ({IN_EAST})",
)
add(
    "prf_09_dependent_choices_free", "uptake_group", lambda df: prf.dependent_choices(df, "COUNTRY"),
    "SELECT DISTINCT COUNTRY FROM uptake_group",
)
add(
    "prf_10_date_extent", "surveillance", lambda df: prf.extent(df, "Date_reported"),
    "SELECT MIN(Date_reported) AS min_value, MAX(Date_reported) AS max_value FROM surveillance",
)
add(
    "prf_10_price_extent", "sales", lambda df: prf.extent(df, "list_price"),
    "SELECT MIN(list_price) AS min_value, MAX(list_price) AS max_value FROM sales",
)
add(
    "prf_10_year_extent", "surveillance",
    lambda df: prf.year_extent(df, "Date_reported").select(F.col("min_year").cast("bigint").alias("min_year"), F.col("max_year").cast("bigint").alias("max_year")),
    "SELECT YEAR(MIN(Date_reported)) AS min_year, YEAR(MAX(Date_reported)) AS max_year FROM surveillance",
)
add(
    "prf_12_distinct_count", "uptake_group", lambda df: prf.distinct_count(df, "COUNTRY"),
    "SELECT COUNT(DISTINCT COUNTRY) AS distinct_count FROM uptake_group",
)


# Filters

_SURV = "Date_reported, Country, WHO_region, New_cases"
_surv = [c.strip() for c in _SURV.split(",")]

add(
    "fil_01_equal", "wellbeing",
    lambda df: sel.where_equal(df, {"platform": "BUILDING", "mental_state": "All"}).groupBy("platform", "mental_state").agg(F.count(F.lit(1)).alias("n")),
    "SELECT platform, mental_state, COUNT(*) AS n FROM wellbeing WHERE platform = 'BUILDING' GROUP BY 1, 2",
)
add(
    "fil_01_equal_null_never", "surveillance",
    lambda df: sel.where_equal(df, {"WHO_region": "ASIA", "Country": "<all>"}).select(*_surv),
    f"SELECT {_SURV} FROM surveillance WHERE WHO_region = 'ASIA'",
)
add(
    "fil_02_period_and_members", "surveillance",
    lambda df: sel.in_period(df, "Date_reported", PERIOD, {"WHO_region": ["ASIA", "EUROPE"], "Country": []}).select(*_surv),
    f"SELECT {_SURV} FROM surveillance WHERE Date_reported {BETWEEN} AND WHO_region IN ('ASIA', 'EUROPE')",
)
add(
    "fil_03_year_range", "surveillance",
    lambda df: sel.in_period(df, "Date_reported", sel.year_range(1997, 1998)).select(*_surv),
    f"SELECT {_SURV} FROM surveillance WHERE YEAR(Date_reported) BETWEEN 1997 AND 1998",
)
add(
    "fil_04_region_mask", "surveillance",
    lambda df: sel.in_regions(df, ["ASIA", "West Europe", "Atlantis"], "WHO_region", "Country", PARTS).select(*_surv),
    f"SELECT {_SURV} FROM surveillance WHERE WHO_region = 'ASIA' OR ({IN_WEST})",
)
add(
    "fil_04_plain_region_first", "surveillance",
    lambda df: sel.in_regions(df.withColumn("WHO_region", F.when(F.col("Country") == "NATION_5", "West Europe").otherwise(F.col("WHO_region"))),
                              ["West Europe", "East Europe"], "WHO_region", "Country", PARTS).select("Date_reported", "Country", "WHO_region"),
    f"""SELECT Date_reported, Country, CASE WHEN Country = 'NATION_5' THEN 'West Europe' ELSE WHO_region END AS WHO_region
        FROM surveillance WHERE Country = 'NATION_5' OR ({IN_EAST})""",
)
add(
    "fil_04_region_mask_none", "surveillance",
    lambda df: sel.in_regions(df, [], "WHO_region", "Country", PARTS).select(*_surv),
    f"SELECT {_SURV} FROM surveillance",
)
add(
    "set_01_region_union", "surveillance",
    lambda df: sel.in_regions(df, ["EUROPE", "West Europe", "East Europe", "EUROPE"], "WHO_region", "Country", PARTS).select(*_surv),
    f"SELECT {_SURV} FROM surveillance WHERE WHO_region = 'EUROPE'",
)
_DOSES = "COVID_VACCINE_ADM_TOT_DOSES"
add(
    "fil_05_snapshot", "uptake_monthly",
    lambda df: sel.snapshot(df, "DATE", "1998-05-31").select("DATE", "COUNTRY", _DOSES),
    f"SELECT DATE, COUNTRY, {_DOSES} FROM uptake_monthly WHERE DATE = DATE '1998-05-31'",
)
add(
    "fil_05_snapshot_last", "uptake_monthly",
    lambda df: sel.snapshot(df, "DATE").select("DATE", "COUNTRY", _DOSES),
    f"SELECT DATE, COUNTRY, {_DOSES} FROM uptake_monthly WHERE DATE = (SELECT MAX(DATE) FROM uptake_monthly)",
)
add(
    "fil_06_known", "uptake_group",
    lambda df: sel.known(df, "POPULATION").select("DATE", "COUNTRY", "GROUP", "POPULATION"),
    'SELECT DATE, COUNTRY, "GROUP", POPULATION FROM uptake_group WHERE POPULATION IS NOT NULL',
)
add(
    "fil_07_aggregate_threshold", "surveillance",
    lambda df: sel.at_least(agg.sum_by(df, ["WHO_region", "Date_reported"], "New_cases"), "New_cases", 1000),
    """SELECT WHO_region, Date_reported, SUM(New_cases) AS New_cases FROM surveillance
       WHERE WHO_region IS NOT NULL GROUP BY 1, 2 HAVING SUM(New_cases) >= 1000""",
)
add(
    "fil_08_refine_then_lookup", "sales",
    lambda df: rounded(sel.where_equal(sel.where_equal(df, {"dealer": "MACHINERY"}), {"row_part": 7}).select(*SALES_ROW, "profit")),
    """SELECT row_key, row_line, row_part, row_supp, ROUND(profit, 6) AS profit FROM sales
       WHERE dealer = 'MACHINERY' AND row_part = 7""",
)
add(
    "fil_09_two_entities", "surveillance",
    lambda df: sel.two_entities(df, "Country", ["NATION_2", "NATION_9"], "Date_reported", PERIOD).select(*_surv),
    f"SELECT {_SURV} FROM surveillance WHERE Country IN ('NATION_2', 'NATION_9') AND Date_reported {BETWEEN}",
)
add(
    "fil_10_members", "uptake_monthly",
    lambda df: sel.members_only(df, "COUNTRY", ["NATION_1", "NATION_2", "NATION_99"]).select("DATE", "COUNTRY", _DOSES),
    f"SELECT DATE, COUNTRY, {_DOSES} FROM uptake_monthly WHERE COUNTRY IN ('NATION_1', 'NATION_2', 'NATION_99')",
)
add(
    "set_03_present_members", "uptake_monthly",
    lambda df: sel.present_members(df, "COUNTRY", ["NATION_1", "NATION_2", "NATION_99"]),
    "SELECT DISTINCT COUNTRY FROM uptake_monthly WHERE COUNTRY IN ('NATION_1', 'NATION_2', 'NATION_99')",
)


# Derived columns

add(
    "der_01_chosen_measure", "uptake_monthly",
    lambda df: rounded(df.select("DATE", "COUNTRY", F.col(UPTAKE_MEASURES["Coverage: booster (%)"]).alias("measure"))),
    "SELECT DATE, COUNTRY, ROUND(COVID_VACCINE_COV_TOT_BOOST, 6) AS measure FROM uptake_monthly",
)
add(
    "der_01_x_y_colour", "wellbeing",
    lambda df: rounded(df.select("social_media_time_min", WELLBEING_METRICS["Mood Level"], "platform")),
    "SELECT social_media_time_min, ROUND(mood_level, 6) AS mood_level, platform FROM wellbeing",
)
add(
    "der_03_region_group", "surveillance",
    lambda df: agg.with_region_group(df, BOTH, "WHO_region", "Country", PARTS).select("Date_reported", "Country", "Region_group"),
    f"SELECT Date_reported, Country, {REGION_GROUP} AS Region_group FROM surveillance",
)
add(
    "der_03_region_group_one_part", "surveillance",
    lambda df: agg.with_region_group(df, ["West Europe"], "WHO_region", "Country", PARTS).select("Date_reported", "Country", "Region_group"),
    f"""SELECT Date_reported, Country, CASE WHEN {IN_WEST} THEN 'West Europe' ELSE COALESCE(WHO_region, 'nan') END AS Region_group
        FROM surveillance""",
)
_RATE_SQL = "ROUND(Cumulative_deaths / Cumulative_cases * 100, 6)"
add(
    "der_04_ratio_above_threshold", "surveillance",
    lambda df: rounded(sel.at_least(df, "Cumulative_cases", 1000).select(
        "Date_reported", "Country", percent(F.col("Cumulative_deaths"), F.col("Cumulative_cases")).alias("Fatality_rate"))),
    f"SELECT Date_reported, Country, {_RATE_SQL} AS Fatality_rate FROM surveillance WHERE Cumulative_cases >= 1000",
)
add(
    "der_05_ratio_or_zero", "surveillance",
    lambda df: rounded(df.select("Date_reported", "Country", percent_or_zero(F.col("New_deaths"), F.col("New_cases") - 50).alias("ratio"))),
    """SELECT Date_reported, Country, ROUND(COALESCE(New_deaths / NULLIF(New_cases - 50, 0) * 100, 0), 6) AS ratio
       FROM surveillance""",
)
add(
    "der_06_ratio_clipped", "surveillance",
    lambda df: rounded(df.select(
        "Date_reported", "Country", percent_above(F.col("Cumulative_deaths"), F.col("Cumulative_cases"), 1000).alias("rate"),
    ).withColumn("rate_plot", clip_upper(F.col("rate"), 5.0))),
    """SELECT Date_reported, Country, ROUND(rate, 6) AS rate, ROUND(CASE WHEN rate > 5 THEN 5 ELSE rate END, 6) AS rate_plot
       FROM (SELECT Date_reported, Country, CASE WHEN Cumulative_cases >= 1000
                    THEN Cumulative_deaths / Cumulative_cases * 100 ELSE 0 END AS rate FROM surveillance) AS r""",
)
add(
    "der_07_guarded_figure", "surveillance",
    lambda df: rounded(lat.surveillance_figures(sel.where_equal(lat.latest_per_key(df, ["Country"], "Date_reported"), {"Country": "nowhere"}))),
    "SELECT CAST(0 AS BIGINT) AS total_cases, CAST(0 AS BIGINT) AS total_deaths, CAST(0 AS DOUBLE) AS fatality_ratio",
)


def _case_sql(column: str, edges: tuple, names: tuple) -> str:
    steps = " ".join(f"WHEN {column} < {e} THEN '{n}'" for e, n in zip(edges, names))
    return f"CASE {steps} ELSE '{names[-1]}' END"


_SLEEP_SQL = _case_sql("sleep_hours", *SLEEP_BINS)
_ACTIVITY_SQL = _case_sql("physical_activity_min", *ACTIVITY_BINS)


def _with_bins(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "sleep_cat": binned(F.col("sleep_hours"), *SLEEP_BINS),
        "activity_cat": binned(F.col("physical_activity_min"), *ACTIVITY_BINS),
    })


add(
    "der_08_bins", "wellbeing",
    lambda df: _with_bins(df).groupBy("sleep_hours", "sleep_cat", "physical_activity_min", "activity_cat").agg(F.count(F.lit(1)).alias("n")),
    f"""SELECT sleep_hours, {_SLEEP_SQL} AS sleep_cat, physical_activity_min, {_ACTIVITY_SQL} AS activity_cat, COUNT(*) AS n
        FROM wellbeing GROUP BY 1, 2, 3, 4""",
)
add(
    "der_09_normalised", "surveillance",
    lambda df: rounded(cmp.normalised(df, "Country", "New_cases").select("Date_reported", "Country", "normalised")),
    """SELECT Date_reported, Country, ROUND(New_cases / COALESCE(NULLIF(MAX(New_cases) OVER (PARTITION BY Country), 0), 1), 6) AS normalised
       FROM surveillance""",
)
add(
    "der_10_highlight", "surveillance",
    lambda df: df.select("Country").distinct().withColumn("Highlight", highlight(F.col("Country"), ["NATION_1", "NATION_7"])).withColumn("Size", highlight_size(F.col("Highlight"))),
    """SELECT DISTINCT Country, CASE WHEN Country IN ('NATION_1', 'NATION_7') THEN 'Selected' ELSE 'Other' END AS Highlight,
              CAST(CASE WHEN Country IN ('NATION_1', 'NATION_7') THEN 18 ELSE 10 END AS BIGINT) AS Size FROM surveillance""",
)
add(
    "der_11_zscores", "weather",
    lambda df: rounded(agg.zscores(
        cln.fill_forward_back(df.select("row_key", F.col("Temperature").alias("value")), "value", ["row_key"]), "value", 2.0)),
    f"""WITH filled AS ({_FILL_SQL.format(p="")}),
        stats AS (SELECT AVG(Temperature) AS m, STDDEV_SAMP(Temperature) AS s FROM filled)
        SELECT row_key, ROUND(Temperature, 6) AS value, ROUND((Temperature - m) / (s + 1e-9), 6) AS zscore,
               ABS((Temperature - m) / (s + 1e-9)) > 2 AS anomaly FROM filled, stats""",
)
_PICK = ["Date_reported", "Country"]
_TEXT_SQL = """SELECT Date_reported, Country, CASE
       WHEN {v} >= 1e9 THEN format('{{:.{d}f}} B', {v} / 1e9) WHEN {v} >= 1e6 THEN format('{{:.{d}f}} M', {v} / 1e6)
       WHEN {v} >= 1e3 THEN format('{{:.{d}f}} K', {v} / 1e3) ELSE {small} END AS shown FROM surveillance"""
add(
    "der_12_big_number_text", "surveillance",
    lambda df: df.select(*_PICK, big_number_text(F.col("Cumulative_cases")).alias("shown")),
    _TEXT_SQL.format(v="Cumulative_cases", d=2, small="CAST(Cumulative_cases AS VARCHAR)"),
)
add(
    "der_13_big_number_truncated", "surveillance",
    lambda df: df.select(*_PICK, big_number_text(F.col("Cumulative_cases") / 7, below="truncated").alias("shown")),
    _TEXT_SQL.format(v="(Cumulative_cases / 7)", d=2, small="CAST(CAST(TRUNC(Cumulative_cases / 7) AS BIGINT) AS VARCHAR)"),
)
add(
    "der_14_big_number_one_decimal", "surveillance",
    lambda df: df.select(*_PICK, big_number_text(F.col("Cumulative_cases") / 2, 1, "rounded").alias("shown")),
    _TEXT_SQL.format(v="(Cumulative_cases / 2)", d=1, small="format('{:.0f}', Cumulative_cases / 2)"),
)
add(
    "der_15_percent_text", "uptake_group",
    lambda df: df.select("DATE", "COUNTRY", "GROUP", percent_text(F.col("COVID_VACCINE_COV_1D")).alias("two"), percent_text(F.col("COVID_VACCINE_COV_1D"), 1).alias("one")),
    """SELECT DATE, COUNTRY, "GROUP", COALESCE(format('{:.2f}%', COVID_VACCINE_COV_1D), 'N/A') AS two,
              COALESCE(format('{:.1f}%', COVID_VACCINE_COV_1D), 'N/A') AS one FROM uptake_group""",
)
_ODD_NUMBERS = "CASE o_orderkey % 9 WHEN 0 THEN CAST('NaN' AS DOUBLE) WHEN 1 THEN 1e22 WHEN 2 THEN 0.0005 WHEN 3 THEN CAST('Infinity' AS DOUBLE) WHEN 4 THEN -1234.5 WHEN 5 THEN 1e21 ELSE o_totalprice END"
add_over_tables(
    "der_12_15_text_of_odd_numbers",
    lambda spark, sf_dir: read_table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ODD_NUMBERS).alias("x")).select(
        "o_orderkey", big_number_text(F.col("x")).alias("big"), big_number_text(F.col("x"), 1, "rounded").alias("one"), percent_text(F.col("x")).alias("percent")),
    f"""WITH t AS (SELECT o_orderkey, {_ODD_NUMBERS} AS x FROM orders)
        SELECT o_orderkey, CASE WHEN isnan(x) THEN NULL WHEN isinf(x) THEN 'inf B' WHEN x >= 1e9 THEN format('{{:.2f}} B', x / 1e9)
            WHEN x >= 1e6 THEN format('{{:.2f}} M', x / 1e6) WHEN x >= 1e3 THEN format('{{:.2f}} K', x / 1e3) ELSE CAST(x AS VARCHAR) END AS big,
          CASE WHEN isnan(x) THEN NULL WHEN isinf(x) THEN 'inf B' WHEN x >= 1e9 THEN format('{{:.1f}} B', x / 1e9)
            WHEN x >= 1e6 THEN format('{{:.1f}} M', x / 1e6) WHEN x >= 1e3 THEN format('{{:.1f}} K', x / 1e3) ELSE format('{{:.0f}}', x) END AS one,
          CASE WHEN isnan(x) THEN 'N/A' ELSE format('{{:.2f}}%', x) END AS percent FROM t""",
)
add(
    "der_17_calendar_parts", "surveillance",
    lambda df: df.select("Date_reported", F.year("Date_reported").cast("bigint").alias("year"), F.date_format("Date_reported", "yyyy-MM-dd").alias("iso")).distinct(),
    "SELECT DISTINCT Date_reported, YEAR(Date_reported) AS year, strftime(Date_reported, '%Y-%m-%d') AS iso FROM surveillance",
)
add(
    "der_19_row_ordinal", "weather",
    lambda df: rounded(ordered.with_ordinal(df.select("row_key", "Temperature"), ["row_key"])),
    "SELECT row_key, ROUND(Temperature, 6) AS Temperature, ROW_NUMBER() OVER (ORDER BY row_key) - 1 AS ordinal FROM weather",
)
add(
    "der_21_rename", "uptake_monthly",
    lambda df: agg.known_sum_by(df, ["DATE"], "COVID_VACCINE_ADM_TOT_A1D").withColumnsRenamed({"DATE": "ds", "value": "y"}),
    "SELECT DATE AS ds, SUM(COVID_VACCINE_ADM_TOT_A1D) AS y FROM uptake_monthly GROUP BY 1",
)
add(
    "der_22_highlight_maxima", "surveillance",
    lambda df: agg.highlight_maxima(df.select("Date_reported", "Country", "New_cases", "New_deaths"), ["New_cases", "New_deaths"]),
    """SELECT Date_reported, Country, New_cases, New_deaths,
              COALESCE(New_cases = (SELECT MAX(New_cases) FROM surveillance), FALSE) AS New_cases_is_max,
              COALESCE(New_deaths = (SELECT MAX(New_deaths) FROM surveillance), FALSE) AS New_deaths_is_max FROM surveillance""",
)
