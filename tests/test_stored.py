"""Stored symbols, marts and statistics: pruning, one scan, staged commits, strict CSV, file order, lazy pivots."""

import os
import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fixtures import capacity_symbols, hourly_symbols
from wattlens import catalog, session
from wattlens.operators.reshape import pivot_lazy, widen
from wattlens.operators.windows import avg_rank, top_ranked
from wattlens.plans import hourly, marts, pipeline
from wattlens.plans.params import Params
from wattlens.schemas import MART_ORDER, MARTS, WIDE_MARTS
from wattlens.sources import sinks
from wattlens.sources.driver import DriverSymbols, driver_params
from wattlens.sources.folders import Folders
from wattlens.sources.sinks import read_mart, recover, write_mart
from wattlens.sources.symbols import FrameSymbols, ParquetSymbols, SymbolMissing, scan_multi_file, write_symbols

P = Params()
SF = "/root/testdata/sf0.001"
CAPACITY = "tech string, year int, capacity double, scenario string"


def _scratch():
    return tempfile.mkdtemp(prefix="wattlens-test-")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _jobs(spark, build):
    """How many jobs ``build`` runs, and what it returns."""
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "count")
    try:
        out = build()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), out
    finally:
        spark.sparkContext._jsc.clearJobGroup()


# -- symbols -----------------------------------------------------------------------------------------

def test_registered_scan_reads_only_its_scenarios(spark):
    plan = _plan(catalog.run(spark, "scan_symbol", SF))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [scenario" in scan and "BUILDING" in scan and "MACHINERY" in scan
    assert "marginal" not in scan  # attributes are pruned, not read and dropped
    for name in ("stored_ca_capacity", "stored_dispatch_without_optional"):
        scans = [line for line in _plan(catalog.run(spark, name, SF)).splitlines() if "FileScan" in line and "level" in line]
        assert scans and all("PartitionFilters: [scenario" in line for line in scans), name


def test_stored_symbols_equal_their_source(spark):
    a, b = capacity_symbols(spark, "007"), capacity_symbols(spark, "7")
    both = FrameSymbols(spark, {k: a.frames[k].unionByName(b.frames[k]) if k != "cal_r" else a.frames[k] for k in a.frames})
    root = _scratch()
    write_symbols(both, both.frames, root)
    stored = ParquetSymbols(spark, root)
    for name in both.frames:
        assert rows(stored.get(name)) == rows(both.get(name)), name
    # names that look like numbers stay text; one of them alone is read alone
    assert rows(marts.ca_capacity(ParquetSymbols(spark, root, ["007"]), P).select("scenario").distinct()) == [("007",)]
    with pytest.raises(SymbolMissing):
        write_symbols(both, ["X"], root)
    # rebuilding one scenario leaves the other
    write_symbols(FrameSymbols(spark, {"XC": a.frames["XC"].limit(1)}), ["XC"], root, scenarios=["007"])
    assert rows(ParquetSymbols(spark, root).get("XC").groupBy("scenario").count()) == [("007", 1), ("7", 6)]


def test_scenarios_are_listed_without_a_job_or_a_scan(spark):
    root = _scratch()
    df = spark.createDataFrame([("pvft", "2020", "PGE", 2020, 1.0, s) for s in ("base", "007", "a b+c=d/é", None)],
                               "i string, v string, r string, t int, level double, scenario string")
    write_symbols(FrameSymbols(spark, {"IX": df}), ["IX"], root)
    n, listed = _jobs(spark, lambda: ParquetSymbols(spark, root).scenarios())
    assert n == 0 and "FileScan" not in _plan(listed)
    assert rows(listed) == sorted([("base",), ("007",), ("a b+c=d/é",), (None,)], key=lambda t: (t[0] is None, str(t[0])))
    assert rows(ParquetSymbols(spark, root, ["base", "gone"]).scenarios()) == [("base",)]
    with pytest.raises(SymbolMissing):
        ParquetSymbols(spark, _scratch()).scenarios()
    other = _scratch()
    df.write.parquet(os.path.join(other, "IX"))  # a column, no folders
    assert len(rows(ParquetSymbols(spark, other).scenarios())) == 4


def _hour_files(spark, years, schema="h int, s string"):
    root, paths = _scratch(), []
    for y in years:
        paths.append(os.path.join(root, f"hour_map_{y}"))
        spark.createDataFrame([(1, f"a{y}"), (2, f"b{y}")], schema).write.parquet(paths[-1])
    return paths


def test_multi_file_scan_is_one_scan_keyed_by_file_name(spark):
    paths = _hour_files(spark, range(2020, 2027))
    # two more: one holds its year, too; one has canonical names
    paths += _hour_files(spark, [2030]) + _hour_files(spark, [2035], "hour int, segment string")
    own = os.path.join(_scratch(), "hour_map_2040")
    spark.createDataFrame([(2040, 1, "a2040"), (2040, 2, "b2040")], "t int, h int, s string").write.parquet(own)
    df = scan_multi_file(spark, [*paths, own], "hrep", key="year", pattern=r"hour_map_(\d{4})")
    assert df.columns == ["year", "hour", "segment"]
    assert rows(df) == sorted((y, h, f"{s}{y}") for y in [*range(2020, 2027), 2030, 2035, 2040] for h, s in ((1, "a"), (2, "b")))
    assert _plan(df).count("FileScan") == 1
    assert _plan(catalog.run(spark, "scan_multi_file", SF)).count("ReadSchema: struct<h:") == 1


def test_multi_file_names_must_fit(spark):
    paths = _hour_files(spark, [2020])
    with pytest.raises(Exception, match="gives no year"):
        scan_multi_file(spark, paths, "hrep", key="year", pattern=r"segments_(\d{4})").collect()
    wrong = os.path.join(_scratch(), "hour_map_2040")
    spark.createDataFrame([(2045, 1, "a")], "t int, h int, s string").write.parquet(wrong)
    with pytest.raises(Exception, match="another one than the file"):
        scan_multi_file(spark, [*paths, wrong], "hrep", key="year", pattern=r"hour_map_(\d{4})").collect()


# -- marts -------------------------------------------------------------------------------------------

@pytest.mark.parametrize("line", ["Solar,2020,abc", "Solar,abc,1.0", "Solar,2020", "Solar,2020,1.0,extra"])
def test_malformed_csv_marts_are_errors(spark, line):
    path = os.path.join(_scratch(), "ca_capacity")
    write_mart(spark.createDataFrame([("Wind", 2020, 2.0, "base")], CAPACITY), path, fmt="csv")
    assert rows(read_mart(spark, path, "ca_capacity", "csv")) == [("Wind", 2020, 2.0, "base")]
    with open(os.path.join(path, "scenario=base", "part-bad.csv"), "w") as f:
        f.write(f"tech,year,capacity\nWind,2025,3.0\n{line}\n")
    with pytest.raises(Exception, match="(?i)malformed|number of columns|MALFORMED_RECORD"):
        read_mart(spark, path, "ca_capacity", "csv").collect()


def test_csv_round_trip_of_odd_values(spark):
    """Quotes, missing numbers, extreme numbers; CSV has one way to write a missing and an empty text, so both are missing."""
    path = os.path.join(_scratch(), "ca_capacity")
    data = [("a,b \"q\"", 2020, None, "x"), ("", None, -0.5, "x"), (None, 2030, 1e-300, "y"), ("n", 2031, float("inf"), "y")]
    write_mart(spark.createDataFrame(data, CAPACITY), path, fmt="csv")
    want = [(t or None, *rest) for t, *rest in data]
    assert rows(read_mart(spark, path, "ca_capacity", "csv")) == sorted(want, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
@pytest.mark.parametrize("scenarios", [None, ["base"]])
def test_a_failed_job_leaves_the_old_mart(spark, fmt, scenarios):
    root = _scratch()
    path = os.path.join(root, "ca_capacity")
    old = spark.createDataFrame([("Wind", 2020, 2.0, "base"), ("Wind", 2020, 3.0, "other")], CAPACITY)
    write_mart(old, path, fmt=fmt)
    # some tasks have written their rows when one fails
    bad = spark.range(0, 1000, 1, 8).select(
        F.lit("Solar").alias("tech"), F.when(F.col("id") == 900, F.raise_error(F.lit("killed midway")).cast("int")).otherwise(2020).alias("year"),
        F.col("id").cast("double").alias("capacity"), F.lit("base").alias("scenario"))
    with pytest.raises(Exception, match="killed midway"):
        write_mart(bad, path, fmt=fmt, scenarios=scenarios)
    assert rows(read_mart(spark, path, "ca_capacity", fmt)) == rows(old)
    assert os.listdir(root) == ["ca_capacity"]  # nothing staged is left
    write_mart(bad.where("id < 900"), path, fmt=fmt, scenarios=scenarios)
    assert read_mart(spark, path, "ca_capacity", fmt).where("scenario = 'base'").count() == 900


@pytest.mark.parametrize("scenarios", [None, ["base", "gone", "new"]])
def test_a_swap_cut_short_is_finished_later(spark, monkeypatch, scenarios):
    """The driver dies after each number of folder operations; the next write (or ``recover``) completes the commit."""
    old = spark.createDataFrame([("Wind", 2020, float(i), s) for i, s in enumerate(["base", "gone", "other"])], CAPACITY)
    new = spark.createDataFrame([("Solar", 2020, 7.0, "base"), ("Solar", 2020, 8.0, "new")], CAPACITY)
    want = rows(new.unionByName(old.where("scenario = 'other'")) if scenarios else new)
    for allowed in range(20):
        path = os.path.join(_scratch(), "ca_capacity")
        write_mart(old, path)
        left = [allowed]

        def dying(name, real):
            def call(self, *args):
                if not left[0]:
                    raise KeyboardInterrupt
                left[0] -= 1
                return real(self, *args)
            return call

        with monkeypatch.context() as m:
            for op in ("move", "delete", "make"):
                m.setattr(Folders, op, dying(op, getattr(Folders, op)))
            try:
                write_mart(new, path, scenarios=scenarios)
                finished = True
            except KeyboardInterrupt:
                finished = False
        committed = finished or os.path.exists(sinks._beside(path, "ready")) or rows(read_mart(spark, path, "ca_capacity")) == want
        recover(spark, path)
        assert rows(read_mart(spark, path, "ca_capacity")) == (want if committed else rows(old)), allowed
        assert not [n for n in os.listdir(os.path.dirname(path)) if n.startswith(("_ready", "_old"))]
        write_mart(old, path)
        assert rows(read_mart(spark, path, "ca_capacity")) == rows(old)
        if finished:
            break
    assert finished and allowed > 3


def test_unpartitioned_marts_are_replaced_whole(spark):
    path = os.path.join(_scratch(), "ca_capacity")
    df = spark.createDataFrame([("Wind", 2020, 2.0)], "tech string, year int, capacity double")
    write_mart(df, path)
    write_mart(df.withColumn("year", F.lit(2025)), path, scenarios=["ignored"])
    assert rows(read_mart(spark, path, "ca_capacity")) == [("Wind", 2025, 2.0)]
    write_mart(df, path, mode="append")
    assert len(rows(read_mart(spark, path, "ca_capacity"))) == 2


def _in_file_order(spark, path, fmt):
    """Rows as they stand in the files, by file name, of each scenario folder."""
    out = {}
    for folder in [f for f in sorted(os.listdir(path)) if "=" in f] or [""]:
        files = sorted(f for f in os.listdir(os.path.join(path, folder)) if f.startswith("part-"))
        read = spark.read.option("header", True) if fmt == "csv" else spark.read
        out[folder] = [r for f in files for r in read.format(fmt).load(os.path.join(path, folder, f)).coalesce(1).collect()]
    return out


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_marts_are_stored_in_key_order(spark, fmt):
    """Several files a scenario, sorted within and in the order of their names; wide marts found lazily, too."""
    sym, root = DriverSymbols(spark, SF, with_scenario=True), _scratch()
    names = ["capcosts_usd2024", "regional_emissions_mtco2", "capacity_by_region_gw", "marginal_costs_usd2024"]
    pipeline.build_marts(sym, driver_params(sym).with_(vintages=None, pivot_years=None), root, names, fmt=fmt)
    for name in names:
        for found in _in_file_order(spark, os.path.join(root, name), fmt).values():
            keys = [tuple(str(r[k]) for k in MART_ORDER[name]) for r in found]
            assert keys == sorted(keys) and len(keys) > 5, name
    folder = os.path.join(root, "capacity_by_region_gw", "scenario=BUILDING")
    assert sum(f.startswith("part-") for f in os.listdir(folder)) >= 1


def test_every_mart_has_an_order():
    assert set(pipeline.MART_JOBS) | {"capacity_factors_top_25"} == set(MART_ORDER) == {*MARTS, *WIDE_MARTS}


# -- lazy pivots --------------------------------------------------------------------------------------

def test_wide_marts_run_no_job_before_the_sink(spark):
    sym = capacity_symbols(spark, "base")
    for job, name, eager in ((marts.capcosts, "capcosts_usd2024", marts.capcosts_wide), (marts.fom_costs, "fom_costs_usd2024", marts.fom_costs_wide),
                             (marts.emissions, "regional_emissions_mtco2", marts.emissions_rollup)):
        n, lazy = _jobs(spark, lambda job=job: job(sym, P))
        assert n == 0, name
        path = os.path.join(_scratch(), name)
        write_mart(lazy, path, order_by=MART_ORDER[name])
        want = eager(sym, P)
        got = read_mart(spark, path, name)
        assert [c for c in got.columns if c != "scenario"] == [c for c in want.columns if c != "scenario"], name
        assert rows(got.select(*want.columns)) == rows(want), name
        # listed labels: wide at once, and still no job
        n, wide = _jobs(spark, lambda job=job: job(sym, P.with_(vintages=["2025", "2050+"], pivot_years=[2020, 2025])))
        assert n == 0 and "by_label" not in wide.columns


def test_lazy_pivot_odd_values(spark):
    data = [("a", "x y", 1.0, 1), ("a", "x y", 3.0, 1), ("a", "b.c`d", None, 0), ("b", "z", 5.0, 0), (None, "z", 7.0, 0)]
    df = spark.createDataFrame(data, "k string, label string, value double, place int")
    lazy = pivot_lazy(df, ["k"], "label", "value", place="place")
    wide = widen(lazy)
    assert wide.columns == ["k", "b.c`d", "z", "x y"]
    assert rows(wide) == [("a", None, None, 2.0), ("b", None, 5.0, None), (None, None, 7.0, None)]
    assert rows(widen(lazy, ["z", "x y", "b.c`d", "q"]).select("k", "q", "z")) == [("a", None, None), ("b", None, 5.0), (None, None, 7.0)]
    with pytest.raises(Exception, match="label outside the list"):
        widen(lazy, ["z"]).collect()
    assert widen(lazy.where("k = 'none'")).columns == ["k"]


# -- top k ---------------------------------------------------------------------------------------------

def test_peak_factors_limit_groups_before_the_shuffle(spark):
    for name in ("peak_capacity_factors", "peak_capacity_factors_scenarios"):
        plan = _plan(catalog.run(spark, name, SF))
        above, below = plan.split("WindowGroupLimit")[1:3]
        assert plan.count("WindowGroupLimit") == 2 and "Final" in above and "Exchange" in above and "Partial" in below, name


@pytest.mark.parametrize("k", [1, 3, 4, 25])
def test_top_ranked_keeps_average_ranks(spark, k):
    """Ties at the border, ties across it, missing values, a group with fewer rows than k."""
    values = [9.0, 8.0, 8.0, 8.0, 7.0, 7.0, 1.0, None, None]
    data = [(g, i, v) for g, n in (("a", 9), ("b", 2), ("c", 8)) for i, v in enumerate(values[:n])]
    df = spark.createDataFrame(data + [("d", 0, None), ("d", 1, None)], "g string, hour int, v double").repartition(4)
    ranked = df.withColumn("o", avg_rank("v", ["g"], tie_break=["hour"])).where(F.col("o") <= k)
    short = top_ranked(df, "v", ["g"], k)
    assert rows(short.withColumn("o", avg_rank("v", ["g"], tie_break=["hour"])).where(F.col("o") <= k)) == rows(ranked)


def test_peak_hours_equal_ranking_all_hours(spark):
    mapping = hourly.ca_hourly_mapping(hourly_symbols(spark), P)
    for k in (1, 2, 25):
        p = P.with_(top_k=k)
        want = hourly.net_load_hourly(mapping, p).where(F.col("order_id") <= k)
        got = hourly.peak_hours(mapping, p).where(F.col("order_id") <= k)
        assert got.columns == want.columns and rows(got) == rows(want) and got.count()


# -- intermediate tables ------------------------------------------------------------------------------

def test_intermediate_tables_have_sizes_and_go_on_request(spark):
    df = session.stored(spark.range(100).select(F.col("id"), F.lit("x" * 10).alias("t")), "test")
    assert "FileScan parquet" in _plan(df) and "ReadSchema: struct<id:bigint>" in _plan(df.select("id"))
    assert df.count() == 100
    root = session.scratch_root(spark)
    assert os.path.isdir(root.removeprefix("file:"))
    # the hourly jobs read such tables
    assert "Scan ExistingRDD" not in _plan(catalog.run(spark, "ca_loads", SF))
    session.clear_scratch(spark)
    assert not os.path.exists(root.removeprefix("file:"))
