"""What the plans look like: pruned scans, pushed filters, early aggregation, no cross joins."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gaugeframe.plans.registry import QUERIES
from gaugeframe.operators import aggregation as agg
from gaugeframe.operators import latest as lat
from gaugeframe.operators import selection as sel
from tests.helpers import plan_of

SF_DIR = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
#: Queries that run jobs while they are built (fits, medians, points between chunks) or call Python on purpose.
EAGER = {
    "src_01_snk_01_csv_round_trip", "src_01_snk_01_text_round_trip", "src_01_checked_rows", "src_01_quarantine", "cln_04_fill_medians", "cln_05_fill_forward_back", "cln_05_fill_whole_table",
    "prf_02_describe", "prf_02_describe_dates", "prf_02_summary_of_any_columns", "der_11_zscores", "der_19_row_ordinal", "win_04_lags_of_raw_rows",
    "ml_01_feature_vector", "ml_03_linear_baseline", "ml_03_linear_per_product", "ml_06_error_figures", "ml_04_forest", "ml_05_boosted_trees", "ml_07_model_comparison",
    "top_06_models_by_rmse", "ml_08_scored_table", "ml_09_saved_models_compared", "ml_10_saved_and_found", "ml_11_feature_importance", "po_01_curve_by_period",
    "po_01_curve_boosted", "po_01_best_by_year", "po_02_curve_by_row", "po_03_reference_points", "fc_02_recursive_forecast", "fc_02_recursive_boosted",
    "fc_03_trend_season_forecast", "fc_03_multiplicative_per_dealer", "fc_03_backtest", "fc_02_backtest",
}


@needs_tables
@pytest.mark.parametrize("name", [n for n in QUERIES if n not in EAGER])
def test_no_cross_joins_and_no_python(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF_DIR))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas", plan)


@needs_tables
def test_date_range_reaches_the_scan_as_a_range(spark):
    plan = plan_of(entry.queries()["fc_04_demand_window"](spark, SF_DIR))
    lineitem = next(line for line in plan.splitlines() if "FileScan" in line and "l_shipdate" in line)
    assert "GreaterThanOrEqual(l_shipdate" in lineitem and "LessThan(l_shipdate" in lineitem


@needs_tables
def test_scans_read_only_used_columns(spark):
    plan = plan_of(entry.queries()["agg_12_mean_per_sleep_bin"](spark, SF_DIR))
    lineitem = next(line for line in plan.splitlines() if "FileScan" in line and "l_tax" in line)
    assert "l_extendedprice" not in lineitem and "l_comment" not in lineitem


def test_latest_row_is_cut_before_the_shuffle(spark, tmp_path):
    spark.range(100).select((F.col("id") % 3).alias("k"), F.current_date().alias("d")).write.parquet(str(tmp_path / "t"))
    plan = plan_of(lat.latest_per_key(spark.read.parquet(str(tmp_path / "t")), ["k"], "d"))
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_sums_combine_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    plan = plan_of(agg.sum_by(df, ["k"], "v"))
    assert plan.index("Exchange") < plan.index("partial_sum")


def test_top_n_is_no_full_sort(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("n"), F.col("id").alias("v"))
    assert "TakeOrderedAndProject" in plan_of(df.transform(lat.top_of_snapshot, "v", 3, "n"))


def test_year_range_compares_the_bare_column(spark, tmp_path):
    spark.sql("select date'2020-05-01' as d, 1 as v").write.parquet(str(tmp_path / "t"))
    plan = plan_of(sel.in_period(spark.read.parquet(str(tmp_path / "t")), "d", sel.year_range(2020, 2021)))
    assert "GreaterThanOrEqual(d,2020-01-01)" in plan and "LessThanOrEqual(d,2021-12-31)" in plan


def test_hot_key_gives_the_same_group_maximum(spark):
    """A third of all rows in one key; forced shuffle join with skew splitting."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v")
    )
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        got = agg.group_maximum(df, ["k"], "v").where(F.col("k") == 0).agg(F.count("v"), F.min("group_max"), F.max("group_max")).first()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert tuple(got) == (10_000, 29_997, 29_997)


def test_all_series_come_from_one_scan_and_one_exchange(spark, tmp_path):
    df = spark.range(100).selectExpr("concat('c', id % 9) as c", "concat('r', id % 3) as r", "date'2020-01-01' as d", "id as v")
    df.write.parquet(str(tmp_path / "t"))
    plan = plan_of(agg.all_series(spark.read.parquet(str(tmp_path / "t")), "v", ["r1"], "r", "c", "d"))
    assert len(re.findall(r"FileScan", plan)) == 1 and len(re.findall(r"\bExchange", plan)) == 1
    assert plan.index("Exchange") < plan.index("partial_sum")
