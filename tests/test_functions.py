import random

import pytest
from pyspark.sql import functions as F

from gaugeframe.functions.categories import ACTIVITY_BINS, SLEEP_BINS, binned, highlight, highlight_size
from gaugeframe.functions.ratios import clip_upper, percent, percent_above, percent_or_zero, share_of_maximum
from gaugeframe.functions.regions import EAST_EUROPE, WEST_EUROPE, region_condition, region_group
from gaugeframe.functions.text import big_number_text, fixed_text, percent_text


def test_fixed_text_rounds_the_binary_value(spark):
    random.seed(5)
    values = [0.125, 2.5, 0.5, 1.5, 1.005, 2.675, 12.345, 99.995, 0.0, -1.5, -2.675, 1e12 + 0.125]
    values += [random.randint(1, 10**7) / 1000 for _ in range(3000)] + [random.uniform(-1e6, 1e6) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    shown = df.select("x", *[fixed_text(F.col("x"), d).alias(f"d{d}") for d in (0, 1, 2)]).collect()
    for r in shown:
        assert (r.d0, r.d1, r.d2) == (f"{r.x:.0f}", f"{r.x:.1f}", f"{r.x:.2f}")


@pytest.mark.parametrize("value, two, truncated, one", [
    (999.0, "999.0", "999", "999"), (999.7, "999.7", "999", "1000"), (1000.0, "1.00 K", "1.00 K", "1.0 K"),
    (1234567.0, "1.23 M", "1.23 M", "1.2 M"), (1e9, "1.00 B", "1.00 B", "1.0 B"), (0.0, "0.0", "0", "0"),
])
def test_big_numbers(spark, value, two, truncated, one):
    x = F.lit(value)
    r = spark.range(1).select(big_number_text(x), big_number_text(x, below="truncated"), big_number_text(x, 1, "rounded")).first()
    assert tuple(r) == (two, truncated, one)


def test_big_integer_below_thousand_stays_an_integer(spark):
    assert spark.range(1).select(big_number_text(F.lit(999))).first()[0] == "999"


@pytest.mark.parametrize("value, two, one, percent", [
    (float("nan"), None, None, "N/A"), (float("inf"), "inf B", "inf B", "inf%"), (float("-inf"), "-inf", "-inf", "-inf%"),
    (1e30, f"{1e21:.2f} B", f"{1e21:.1f} B", "1" + 30 * "0" + ".00%"), (5e-4, "0.0005", "0", "0.00%"), (-2.5e-4, "-0.00025", "0", "0.00%"), (-1234.5, "-1234.5", "-1234", "-1234.50%"),
])
def test_odd_numbers(spark, value, two, one, percent):
    x = F.lit(value)
    r = spark.range(1).select(big_number_text(x), big_number_text(x, 1, "rounded"), percent_text(x)).first()
    assert tuple(r) == (two, one, percent)


def test_percent_text_of_missing_value(spark):
    r = spark.range(1).select(percent_text(F.lit(12.345), 1), percent_text(F.lit(None).cast("double"))).first()
    assert tuple(r) == ("12.3%", "N/A")


def test_ratios_at_their_edges(spark):
    data = [(5.0, 0.0), (0.0, 0.0), (None, 10.0), (60.0, 1000.0), (9.0, 999.0), (1.0, None)]
    df = spark.createDataFrame(data, "d double, c double")
    d, c = F.col("d"), F.col("c")
    got = df.select(percent(d, c), percent_or_zero(d, c), percent_above(d, c, 1000), clip_upper(percent_above(d, c, 1000), 5)).collect()
    assert [tuple(r) for r in got] == [
        (None, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0), (None, 0.0, 0.0, 0.0),
        (6.0, 6.0, 6.0, 5.0), (9.0 / 999 * 100, 9.0 / 999 * 100, 0.0, 0.0), (None, 0.0, 0.0, 0.0)]


def test_clip_keeps_missing_and_zero_maximum_counts_as_one(spark):
    r = spark.range(1).select(clip_upper(F.lit(None).cast("double"), 5), share_of_maximum(F.lit(0.0), F.lit(0.0))).first()
    assert tuple(r) == (None, 0.0)


def test_bins_at_edges_and_missing(spark):
    df = spark.createDataFrame([(5.99,), (6.0,), (7.0,), (8.0,), (None,)], "h double")
    assert [r[0] for r in df.select(binned(F.col("h"), *SLEEP_BINS)).collect()] == ["<6h", "6–7h", "7–8h", "≥8h", "≥8h"]
    df = spark.createDataFrame([(29.9,), (30.0,), (60.0,), (90.0,), (None,)], "h double")
    assert [r[0] for r in df.select(binned(F.col("h"), *ACTIVITY_BINS)).collect()] == ["<30min", "30–59min", "60–89min", "≥90min", "≥90min"]


def test_highlight(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    flag = highlight(F.col("c"), ["a"])
    assert [tuple(r) for r in df.select(flag, highlight_size(flag)).collect()] == [("Selected", 18), ("Other", 10), ("Other", 10)]


PLACES = [("EURO", "France"), ("EURO", "Poland"), ("EURO", "Israel"), ("AFRO", "Mali"), (None, "Nowhere"), ("AFRO", "France")]


@pytest.mark.parametrize("selected, expected", [
    ([], {0, 1, 2, 3, 4, 5}), (["EURO"], {0, 1, 2}), (["West Europe"], {0}), (["East Europe", "AFRO"], {1, 3, 5}),
    (["EURO", "West Europe"], {0, 1, 2}), (["Atlantis"], set()), (["Atlantis", "AFRO"], {3, 5}),
])
def test_region_condition(spark, selected, expected):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PLACES)], "i int, r string, c string")
    assert {r.i for r in df.where(region_condition(selected, F.col("r"), F.col("c"))).collect()} == expected


def test_region_condition_is_the_union_of_its_parts(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PLACES)], "i int, r string, c string")
    names = ["West Europe", "East Europe", "AFRO", "Atlantis"]

    def ids(selected):
        return {r.i for r in df.where(region_condition(selected, F.col("r"), F.col("c"))).collect()}

    assert ids(names) == set().union(*[ids([n]) for n in names])


def test_region_group_splits_only_selected_parts(spark):
    df = spark.createDataFrame(PLACES, "r string, c string")

    def groups(selected):
        return [r[0] for r in df.select(region_group(selected, F.col("r"), F.col("c"))).collect()]

    assert groups([]) == ["EURO", "EURO", "EURO", "AFRO", "nan", "AFRO"]
    assert groups(["West Europe"]) == ["West Europe", "EURO", "EURO", "AFRO", "nan", "AFRO"]
    assert groups(["West Europe", "East Europe", "EURO"]) == ["West Europe", "East Europe", "EURO", "AFRO", "nan", "AFRO"]
    assert not set(WEST_EUROPE.members) & set(EAST_EUROPE.members)
