import pytest
from pyspark.sql import functions as F

from conftest import rows
from wattlens.operators import (apply_lookup, avg_rank, dense_over_values, drop_null_keys, expand_to_hours,
                                group_total, not_in_keep_null, ntile_nonnull, partial_rollup, pivot_values,
                                position_desc, ratio_to_group_max, separate, share_of_group, subset_region,
                                sum_by)


def test_subset_region_is_semi_join(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("A", 3.0), (None, 4.0)], "region string, v double")
    regions = spark.createDataFrame([("A",), ("A",), ("C",)], "region string")
    out = subset_region(df, regions)
    assert rows(out) == [("A", 1.0), ("A", 3.0)]
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()


def test_not_in_keeps_null(spark):
    df = spark.createDataFrame([("Coal",), ("Solar",), (None,)], "tech string")
    assert rows(df.where(not_in_keep_null("tech", ["Coal"]))) == [("Solar",), (None,)]


def test_sum_by_drops_null_keys_and_skips_null_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), (None, 5.0), ("b", None)], "k string, v double")
    assert rows(sum_by(df, ["k"], "v")) == [("a", 1.0), ("b", 0.0)]
    assert rows(drop_null_keys(df, ["k"]).select("k").distinct()) == [("a",), ("b",)]


def test_partial_rollup(spark):
    df = spark.createDataFrame([("A", 2020, 1.0), ("B", 2020, 2.0), ("C", 2020, 4.0)], "region string, year int, e double")
    regions = spark.createDataFrame([("A",), ("B",)], "region string")
    out = partial_rollup(df, regions, "California", ["year"], "e")
    assert rows(out.select("region", "year", "e")) == [("A", 2020, 1.0), ("B", 2020, 2.0), ("C", 2020, 4.0),
                                                       ("California", 2020, 3.0)]


def test_dense_over_values(spark):
    df = spark.createDataFrame([("Wind", 2020, 1.0), ("Wind", 2020, 2.0), ("Solar", 2030, 5.0)],
                               "tech string, year int, capacity double")
    out = dense_over_values(df, ["tech"], "year", [2020, 2030], "capacity")
    assert rows(out) == [("Solar", 2020, 0.0), ("Solar", 2030, 5.0), ("Wind", 2020, 3.0), ("Wind", 2030, 0.0)]
    assert dict(out.dtypes)["year"] == "int"
    with pytest.raises(Exception, match="year outside"):
        dense_over_values(df, ["tech"], "year", [2020], "capacity").collect()


def test_pivot_and_unpivot_and_separate(spark):
    df = spark.createDataFrame([("Wind", "2020", 1.0), ("Wind", "2020", 3.0), ("Wind", "2050+", 4.0)],
                               "tech string, vintage string, v double")
    wide = pivot_values(df, ["tech"], "vintage", ["2020", "2050+"], "v")
    assert wide.columns == ["tech", "2020", "2050+"] and rows(wide) == [("Wind", 2.0, 4.0)]
    with pytest.raises(Exception, match="vintage outside"):
        pivot_values(df, ["tech"], "vintage", ["2020"], "v").collect()
    sep = separate(spark.createDataFrame([("x", "load_hour")], "a string, id string"), "id", ["type", "aggregation"])
    assert sep.columns == ["a", "type", "aggregation"] and rows(sep) == [("x", "load", "hour")]


def test_avg_rank_ties(spark):
    # R rank(-x): ties share the average rank, so a cut at <= 2 can keep 3 rows; NAs come last
    # with distinct ranks in order
    df = spark.createDataFrame([(1, 10.0), (2, 9.0), (3, 9.0), (4, 1.0), (5, None), (0, None)], "h int, x double")
    out = {r.h: r.r for r in df.select("h", avg_rank("x", [F.lit(1)], tie_break=["h"]).alias("r")).collect()}
    assert out == {1: 1.0, 2: 2.5, 3: 2.5, 4: 4.0, 0: 5.0, 5: 6.0}


def test_position_desc_tie_break(spark):
    df = spark.createDataFrame([(3, 5.0), (1, 5.0), (2, 7.0)], "hour int, x double")
    out = {r.hour: r.p for r in df.select("hour", position_desc("x", [F.lit(1)], ["hour"]).alias("p")).collect()}
    assert out == {2: 1, 1: 2, 3: 3}


def test_ntile_larger_buckets_first_and_null_unbucketed(spark):
    data = [(i, float(i)) for i in range(1, 13)] + [(13, None)]
    df = spark.createDataFrame(data, "hour int, x double")
    out = {r.hour: r.n for r in df.select("hour", ntile_nonnull("x", 10, [F.lit(1)], ["hour"]).alias("n")).collect()}
    # 12 values into 10 buckets: buckets 1-2 hold two values, the rest one (dplyr/Spark rule)
    assert [out[h] for h in range(1, 13)] == [1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert out[13] is None


def test_group_total_share_and_ratio(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("b", None)], "g string, x double")
    out = rows(df.select("g", "x", group_total("x", ["g"]).alias("t"), share_of_group("x", ["g"]).alias("s"),
                         ratio_to_group_max("x", "x", ["g"]).alias("r")))
    assert out == [("a", 1.0, 4.0, 0.25, 1 / 3), ("a", 3.0, 4.0, 0.75, 1.0),
                   ("b", 2.0, None, None, None), ("b", None, None, None, None)]


def test_expand_to_hours(spark):
    seg = spark.createDataFrame([("Wind", 2020, "s1", 5.0)], "tech string, year int, segment string, level double")
    rep = spark.createDataFrame([(2020, 1, "s1"), (2020, 2, "s1"), (2020, 3, "s2")], "year int, hour int, segment string")
    assert rows(expand_to_hours(seg, rep).select("hour")) == [(1,), (2,)]


def test_apply_lookup_with_dataframe(spark):
    df = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    m = spark.createDataFrame([("x", "X")], "key string, value string")
    out = apply_lookup(df, "k", "out", m)
    assert out.columns == ["k", "v", "out"] and rows(out) == [("x", 1, "X"), ("y", 2, None)]
