"""The indicator tables as views over the given star-schema tables.

Each view is a Spark plan and, for checking, the same view as SQL text. Missing values are
put in on purpose, so that every null rule has rows to act on.

Line items are summed per order before they are joined: the sums combine in every task before
the shuffle, and the join on the order reuses that shuffle.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeframe.functions.regions import CompositeRegion
from gaugeframe.sources.flatfiles import read_table

WEST = CompositeRegion("West Europe", "EUROPE", ("NATION_3", "NATION_8"))
EAST = CompositeRegion("East Europe", "EUROPE", ("NATION_13", "NATION_18"))
PARTS = (WEST, EAST)

PERIOD = ("1996-03-01", "1999-09-30")


def orders_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order key, customer, day and nation of every order."""
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return (
        orders.withColumn("day", F.col("o_orderdate").cast("date"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    )


def _flagged(flag: str, value: Column) -> Column:
    return F.when(F.col("l_returnflag") == flag, value)


def surveillance(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_order = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.sum("l_quantity").alias("cases"), F.sum(_flagged("R", F.col("l_quantity"))).alias("deaths"))
    )
    region = read_table(spark, sf_dir, "region")
    daily = (
        orders_by_nation(spark, sf_dir)
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(
            F.col("day").alias("Date_reported"),
            F.col("n_name").alias("Country"),
            F.when(F.col("n_name") != "NATION_4", F.col("r_name")).alias("WHO_region"),
        )
        .agg(F.sum("cases").alias("cases"), F.sum("deaths").alias("New_deaths"))
    )
    # One row per nation and day: the length of a nation's series is bounded by the calendar.
    to_date = Window.partitionBy("Country").orderBy("Date_reported").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select(
        "Date_reported",
        "Country",
        "WHO_region",
        F.when(F.col("cases") >= 10, F.col("cases")).alias("New_cases"),
        "New_deaths",
        F.sum("cases").over(to_date).alias("Cumulative_cases"),
        F.sum(F.coalesce("New_deaths", F.lit(0.0))).over(to_date).alias("Cumulative_deaths"),
    )


def uptake_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    code = (
        F.when(segment == "AUTOMOBILE", "hcw")
        .when(segment == "BUILDING", "old")
        .when(segment == "FURNITURE", "all")
        .when(segment == "HOUSEHOLD", "pw")
        .otherwise("unmapped")
    )
    # First per customer, so that customers are counted without a distinct aggregate.
    per_customer = (
        orders_by_nation(spark, sf_dir)
        .groupBy(F.last_day("day").alias("DATE"), F.col("n_name").alias("COUNTRY"), segment, "o_custkey")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"))
    )
    groups = per_customer.groupBy("DATE", "COUNTRY", segment).agg(
        F.sum("n").alias("n"), F.sum("f").alias("f"), F.count(F.lit(1)).alias("customers")
    )
    return groups.select(
        "DATE",
        "COUNTRY",
        code.alias("GROUP"),
        F.when(F.col("n") <= 5, F.col("n")).alias("COVID_VACCINE_ADM_1D"),
        F.when(F.col("n") >= 2, F.lit(100.0) * F.col("f") / F.col("n")).alias("COVID_VACCINE_COV_1D"),
        F.when(segment != "HOUSEHOLD", F.col("customers")).alias("POPULATION"),
    )


def uptake_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    quantity = F.col("l_quantity")
    per_order = (
        read_table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.sum(quantity).alias("q"),
            F.count(F.lit(1)).alias("n"),
            *[F.sum(_flagged(f, quantity)).alias(f"q{f}") for f in "ANR"],
            *[F.count_if(F.col("l_returnflag") == f).alias(f"n{f}") for f in "ANR"],
        )
    )
    sums = ["q", "n", "qA", "qN", "qR", "nA", "nN", "nR"]
    monthly = (
        orders_by_nation(spark, sf_dir)
        .join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
        .groupBy(F.last_day("day").alias("DATE"), F.col("n_name").alias("COUNTRY"))
        .agg(*[F.sum(c).alias(c) for c in sums])
    )

    def share(flag: str) -> Column:
        return F.lit(100.0) * F.col(f"n{flag}") / F.col("n")

    return monthly.select(
        "DATE",
        "COUNTRY",
        F.when(F.col("DATE") != F.lit("1996-02-29").cast("date"), F.col("q")).alias("COVID_VACCINE_ADM_TOT_DOSES"),
        (F.lit(100.0) * F.col("q") / 1000).alias("COVID_VACCINE_ADM_TOT_DOSES_PER100"),
        F.col("qA").alias("COVID_VACCINE_ADM_TOT_A1D"),
        F.col("qN").alias("COVID_VACCINE_ADM_TOT_CPS"),
        F.col("qR").alias("COVID_VACCINE_ADM_TOT_BOOST"),
        share("A").alias("COVID_VACCINE_COV_TOT_A1D"),
        share("N").alias("COVID_VACCINE_COV_TOT_CPS"),
        share("R").alias("COVID_VACCINE_COV_TOT_BOOST"),
    )


def _lines_with_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    buyers = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return read_table(spark, sf_dir, "lineitem").join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))


def wellbeing(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, quantity, flag = F.col("l_orderkey"), F.col("l_quantity"), F.col("l_returnflag")
    positive = (F.col("l_suppkey") % 11).cast("bigint")
    return _lines_with_customer(spark, sf_dir).select(
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("c_mktsegment").alias("platform"),
        F.when(flag == "A", "Healthy").when(flag == "N", "At risk").otherwise("Stressed").alias("mental_state"),
        quantity.alias("anxiety_level"),
        (F.col("l_discount") * 100).alias("stress_level"),
        (F.col("l_tax") * 100).alias("mood_level"),
        (quantity * F.col("l_linenumber")).alias("social_media_time_min"),
        F.when(key % 50 != 0, F.col("l_linenumber") + F.lit(3.0)).alias("sleep_hours"),
        F.when(key % 50 != 1, quantity * 2).alias("physical_activity_min"),
        (F.col("l_partkey") % 7).cast("bigint").alias("negative_interactions_count"),
        F.when(positive != 0, positive).alias("positive_interactions_count"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    price = F.col("l_extendedprice")
    return (
        _lines_with_customer(spark, sf_dir)
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_orderkey").alias("row_key"),
            F.col("l_linenumber").alias("row_line"),
            F.col("l_partkey").alias("row_part"),
            F.col("l_suppkey").alias("row_supp"),
            F.col("l_shipdate").cast("date").alias("order_date"),
            F.col("l_quantity").alias("quantity"),
            F.when(F.col("l_orderkey") % 40 != 0, price / F.col("l_quantity")).alias("list_price"),
            (price * (F.lit(1) - F.col("l_discount"))).alias("profit"),
            F.col("p_brand").alias("sku"),
            F.col("c_mktsegment").alias("dealer"),
        )
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.col("event_id")
    return read_table(spark, sf_dir, "events").select(
        number.alias("row_key"),
        F.col("ts").cast("date").alias("Date"),
        F.col("event_type").alias("City"),
        F.when(number % 17 != 0, F.col("value")).alias("Temperature"),
        (F.col("value") / 5).alias("Humidity"),
        (F.col("value") / 10).alias("Wind Speed"),
        (F.lit(5) * (number % 4)).cast("bigint").alias("Rainfall"),
    )


VIEWS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (surveillance, uptake_group, uptake_monthly, wellbeing, sales, weather)
}

SALES_ROW = ["row_key", "row_line", "row_part", "row_supp"]

VIEW_SQL = {
    "surveillance": """
  SELECT Date_reported, Country, WHO_region,
         CASE WHEN cases < 10 THEN NULL ELSE cases END AS New_cases, New_deaths,
         SUM(cases) OVER (PARTITION BY Country ORDER BY Date_reported ROWS UNBOUNDED PRECEDING) AS Cumulative_cases,
         SUM(COALESCE(New_deaths, 0)) OVER (PARTITION BY Country ORDER BY Date_reported ROWS UNBOUNDED PRECEDING) AS Cumulative_deaths
  FROM (SELECT CAST(o_orderdate AS DATE) AS Date_reported, n_name AS Country,
               CASE WHEN n_name = 'NATION_4' THEN NULL ELSE r_name END AS WHO_region,
               SUM(l_quantity) AS cases,
               SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS New_deaths
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
        GROUP BY 1, 2, 3) AS daily""",
    "uptake_group": """
  SELECT LAST_DAY(CAST(o_orderdate AS DATE)) AS DATE, n_name AS COUNTRY,
         CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'hcw' WHEN 'BUILDING' THEN 'old' WHEN 'FURNITURE' THEN 'all'
                           WHEN 'HOUSEHOLD' THEN 'pw' ELSE 'unmapped' END AS "GROUP",
         CASE WHEN COUNT(*) > 5 THEN NULL ELSE COUNT(*) END AS COVID_VACCINE_ADM_1D,
         CASE WHEN COUNT(*) >= 2 THEN CAST(100 AS DOUBLE) * SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) / COUNT(*) END AS COVID_VACCINE_COV_1D,
         CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN COUNT(DISTINCT o_custkey) END AS POPULATION
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, c_mktsegment""",
    "uptake_monthly": """
  SELECT LAST_DAY(CAST(o_orderdate AS DATE)) AS DATE, n_name AS COUNTRY,
         CASE WHEN LAST_DAY(CAST(o_orderdate AS DATE)) = DATE '1996-02-29' THEN NULL ELSE SUM(l_quantity) END AS COVID_VACCINE_ADM_TOT_DOSES,
         CAST(100 AS DOUBLE) * SUM(l_quantity) / 1000 AS COVID_VACCINE_ADM_TOT_DOSES_PER100,
         SUM(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS COVID_VACCINE_ADM_TOT_A1D,
         SUM(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS COVID_VACCINE_ADM_TOT_CPS,
         SUM(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS COVID_VACCINE_ADM_TOT_BOOST,
         CAST(100 AS DOUBLE) * SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) / COUNT(*) AS COVID_VACCINE_COV_TOT_A1D,
         CAST(100 AS DOUBLE) * SUM(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) / COUNT(*) AS COVID_VACCINE_COV_TOT_CPS,
         CAST(100 AS DOUBLE) * SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) / COUNT(*) AS COVID_VACCINE_COV_TOT_BOOST
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2""",
    "wellbeing": """
  SELECT CAST(l_shipdate AS DATE) AS date, c_mktsegment AS platform,
         CASE l_returnflag WHEN 'A' THEN 'Healthy' WHEN 'N' THEN 'At risk' ELSE 'Stressed' END AS mental_state,
         l_quantity AS anxiety_level, l_discount * 100 AS stress_level, l_tax * 100 AS mood_level,
         l_quantity * l_linenumber AS social_media_time_min,
         CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE l_linenumber + CAST(3 AS DOUBLE) END AS sleep_hours,
         CASE WHEN l_orderkey % 50 = 1 THEN NULL ELSE l_quantity * 2 END AS physical_activity_min,
         CAST(l_partkey % 7 AS BIGINT) AS negative_interactions_count,
         CASE WHEN l_suppkey % 11 = 0 THEN NULL ELSE CAST(l_suppkey % 11 AS BIGINT) END AS positive_interactions_count
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""",
    "sales": """
  SELECT l_orderkey AS row_key, l_linenumber AS row_line, l_partkey AS row_part, l_suppkey AS row_supp,
         CAST(l_shipdate AS DATE) AS order_date, l_quantity AS quantity,
         CASE WHEN l_orderkey % 40 = 0 THEN NULL ELSE l_extendedprice / l_quantity END AS list_price,
         l_extendedprice * (1 - l_discount) AS profit, p_brand AS sku, c_mktsegment AS dealer
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""",
    "weather": """
  SELECT event_id AS row_key, CAST(ts AS DATE) AS Date, event_type AS City,
         CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS Temperature,
         value / 5 AS Humidity, value / 10 AS "Wind Speed",
         CAST(5 * (event_id % 4) AS BIGINT) AS Rainfall
  FROM events""",
}
