import datetime as dt

import pytest
from pyspark.sql import functions as F

from wattlens import lookups
from wattlens.functions import (calendar_parts, checked, floor0, hour_to_timestamp, map_lookup, mean,
                                na_mean, na_sum, ordered_tech, recode_if, strip_digits, tech_order, tech_prefix,
                                weighted_mean_fallback)


def test_tech_prefix_and_class_lookup(spark):
    df = spark.createDataFrame([("wnosd-c1",), ("pvft",), ("zzzz-1",), (None,), ("li-ion",)], "tech_class string")
    out = df.select(tech_prefix().alias("p"), map_lookup(tech_prefix(), lookups.TECH_SET).alias("t")).collect()
    assert [tuple(r) for r in out] == [("wnosd", "Offshore Wind"), ("pvft", "Solar"), ("zzzz", None),
                                       (None, None), ("li", None)]


def test_report_digits_are_stripped_before_lookup(spark):
    # digits are removed from the class first, so keys holding digits can never match
    df = spark.createDataFrame([("xwnd12",), ("h2",), ("h2cc3",), ("peakload",), ("stor7",)], "type string")
    out = [r[0] for r in df.select(map_lookup(strip_digits("type"), lookups.TYPE_TO_TECH)).collect()]
    assert out == ["Wind", None, None, "Peak Load", "Storage"]


def test_map_lookup_unknown_is_null(spark):
    df = spark.createDataFrame([("a",), ("b",)], "k string")
    assert [r[0] for r in df.select(map_lookup("k", {"a": 1})).collect()] == [1, None]


def test_hour_to_timestamp_calendar(spark):
    df = spark.createDataFrame([(1,), (8760,), (8761,), (0,), (1417,)], "hour int")
    df = df.withColumn("time", hour_to_timestamp("hour")).withColumns(calendar_parts("time"))
    got = {r.hour: r for r in df.collect()}
    assert got[1].time == dt.datetime(2026, 1, 1, 0, 0)
    assert got[8760].time == dt.datetime(2026, 12, 31, 23, 0)
    assert got[8761].time is None and got[0].time is None
    # hour 1417 starts day 60 of a non-leap year: 1 March, 00:00
    assert (got[1417].month, got[1417].day, got[1417].hour_of_day, got[1417].month_name) == (3, 1, 0, "Mar")
    assert got[8760].hour_of_day == 23 and got[8760].month_name == "Dec"


def test_na_propagating_aggregates(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0)], "g string, x double")
    out = {r.g: r for r in df.groupBy("g").agg(na_mean("x").alias("m"), na_sum("x").alias("s"),
                                               mean("x").alias("pandas_mean")).collect()}
    assert out["a"].m is None and out["a"].s is None
    assert out["a"].pandas_mean == 1.0
    assert (out["b"].m, out["b"].s) == (3.0, 6.0)


def test_mean_of_decimals_is_one_division_of_the_exact_sum(spark):
    df = spark.createDataFrame([("0.10",), ("0.20",), ("0.30",), (None,)], "x string").select(F.col("x").cast("decimal(18,2)").alias("x"))
    assert df.agg(mean("x").alias("m")).first().m == 0.6 / 3
    assert df.limit(0).agg(mean("x").alias("m")).first().m is None


def test_checked_passes_listed_values_and_null_only(spark):
    df = spark.createDataFrame([(1,), (None,)], "y int")
    assert [r[0] for r in df.select(checked("y", [1, 2], "year")).collect()] == [1, None]
    with pytest.raises(Exception, match="year outside"):
        df.select(checked("y", [2], "year")).collect()


def test_floor0_keeps_null(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "x double")
    assert [r[0] for r in df.select(floor0(F.col("x"))).collect()] == [0.0, 2.0, None]


def test_weighted_mean_fallback(spark):
    # zero total capacity -> plain mean of the factors instead of an error / NaN
    df = spark.createDataFrame([(0.0, 0.0, 0.4), (3.0, 6.0, 0.9), (None, None, 0.2)], "g double, c double, m double")
    assert [r[0] for r in df.select(weighted_mean_fallback("g", "c", "m")).collect()] == [0.4, 0.5, 0.2]


def test_recode_and_tech_order(spark):
    df = spark.createDataFrame([("Storage-discharge",), ("Solar",), ("Offshore Wind",), (None,)], "tech string")
    df = df.withColumn("tech", recode_if("tech", ["Storage-discharge"], "Storage"))
    out = df.select("tech", tech_order("tech").alias("o"), ordered_tech("tech").alias("f")).collect()
    assert [tuple(r) for r in out] == [("Storage", 1, "Storage"), ("Solar", 2, "Solar"),
                                       ("Offshore Wind", None, None), (None, None, None)]
    assert len(lookups.TECH_ORDER) == 14 and lookups.TECH_ORDER[-1] == "Nuclear"


@pytest.mark.parametrize("taxonomy,size", [(lookups.TECH_SET, 36), (lookups.TYPE_TO_TECH, 30),
                                          (lookups.STATE_MAPPING, 17), (lookups.TECH_SUB, 38)])
def test_taxonomy_sizes(taxonomy, size):
    assert len(taxonomy) == size
