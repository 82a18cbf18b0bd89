import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from fixtures import capacity_symbols, dispatch_symbols, hourly_symbols
from wattlens.plans import dispatch, marts, pipeline
from wattlens.plans.params import Params
from wattlens.schemas import MARTS, WIDE_MARTS
from wattlens.sources.sinks import read_mart, write_mart
from wattlens.sources.symbols import FrameSymbols, ParquetSymbols, SymbolMissing, rename_domains, scan_multi_file

P = Params()


def _scratch():
    return tempfile.mkdtemp(prefix="wattlens-test-")


def test_rename_domains_ignores_absent_names(spark):
    df = spark.createDataFrame([("a", 1)], "i string, t int")
    assert rename_domains(df, {"i": "tech_class", "j": "tech_class", "t": "year"}).columns == ["tech_class", "year"]


def test_parquet_symbols_prune_scenarios_and_drop_attributes(spark):
    root = _scratch()
    raw = spark.createDataFrame([("pvft-a", "2020", "PGE", 2020, 1.0, 0.5, "s1"), ("pvft-a", "2020", "PGE", 2020, 2.0, 0.5, "s2")],
                                "i string, v string, r string, t int, level double, marginal double, scenario string")
    raw.write.partitionBy("scenario").parquet(os.path.join(root, "XC"))
    sym = ParquetSymbols(spark, root, scenarios=["s2"])
    xc = sym.get("XC")
    assert xc.columns == ["tech_class", "vintage", "region", "year", "level", "scenario"]
    assert rows(xc) == [("pvft-a", "2020", "PGE", 2020, 2.0, "s2")]
    plan = xc._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "s2" in plan
    # missing symbols: required -> an error that names the folder, optional -> empty typed frame
    with pytest.raises(SymbolMissing, match="no folder .*X"):
        sym.get("X")
    assert sym.get("X_45V", required=False).count() == 0 and not sym.available("X_45V")
    raw.write.partitionBy("scenario").parquet(os.path.join(root, "IX"))
    assert rows(ParquetSymbols(spark, root).scenarios()) == [("s1",), ("s2",)]
    # a folder without data is not an absent symbol, and neither is one without the symbol's columns
    os.mkdir(os.path.join(root, "X_45V"))
    with pytest.raises(Exception, match="UNABLE_TO_INFER_SCHEMA"):
        ParquetSymbols(spark, root).get("X_45V", required=False)
    raw.drop("level").write.parquet(os.path.join(root, "X"))
    with pytest.raises(SymbolMissing, match="no column"):
        ParquetSymbols(spark, root).get("X")


def test_dispatch_needs_its_symbols(spark):
    frames = dict(dispatch_symbols(spark).frames)
    del frames["X"]
    with pytest.raises(SymbolMissing):
        dispatch.dispatch_by_segment(FrameSymbols(spark, frames), P)


def test_stacked_symbols_keep_their_columns(spark):
    rows_ = dispatch_symbols(spark).stacked(["X", "G"]).groupBy("symbol").agg(F.count("*"), F.count("vintage"), F.sum("level"))
    assert rows(rows_) == [("G", 1, 0, 0.5), ("X", 5, 5, 85.0)]


def test_multi_file(spark):
    root = _scratch()
    paths = []
    for y in (2020, 2025):
        p = os.path.join(root, f"hrep_{y}")
        names = "t int, h int, s string" if y == 2020 else "year int, hour int, segment string"
        spark.createDataFrame([(y, 1, "s1"), (y, 2, "s2")], names).write.parquet(p)
        paths.append(p)
    assert rows(scan_multi_file(spark, paths, "hrep")) == [(2020, 1, "s1"), (2020, 2, "s2"), (2025, 1, "s1"), (2025, 2, "s2")]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_write_and_read_mart(spark, fmt):
    path = os.path.join(_scratch(), "ca_capacity")
    both = marts.ca_capacity(capacity_symbols(spark, "base"), P).unionByName(marts.ca_capacity(capacity_symbols(spark, "2"), P))
    write_mart(both, path, fmt=fmt)
    back = read_mart(spark, path, "ca_capacity", fmt)
    assert rows(back.select(*both.columns)) == rows(both)
    assert dict(back.dtypes) == {"tech": "string", "year": "int", "capacity": "double", "scenario": "string"}
    # rebuilding some scenarios leaves the others in place, and drops rows of one that has none any more
    write_mart(both.where("scenario = 'base' AND tech = 'Solar'"), path, fmt=fmt, scenarios=["base"])
    assert rows(read_mart(spark, path, "ca_capacity", fmt).groupBy("scenario").count()) == [("2", 4), ("base", 1)]
    write_mart(both.where("scenario = 'none'"), path, fmt=fmt, scenarios=["base"])
    assert rows(read_mart(spark, path, "ca_capacity", fmt).select("scenario").distinct()) == [("2",)]


def _all_symbols(spark):
    frames = {}
    for s in (hourly_symbols(spark), capacity_symbols(spark), dispatch_symbols(spark)):
        frames.update({k: v for k, v in s.frames.items() if k not in frames})
    return FrameSymbols(spark, {k: v.withColumn("scenario", F.lit("base")) for k, v in frames.items()})


def test_marts_and_statistics_are_the_same_in_both_formats(spark):
    sym, out = _all_symbols(spark), {}
    for fmt in ("parquet", "csv"):
        root, stats = _scratch(), _scratch()
        pipeline.build_marts(sym, P, root, fmt=fmt)
        pipeline.write_statistics(spark, root, P, stats, fmt=fmt)
        out[fmt] = {n: read_mart(spark, os.path.join(root, n), n, fmt) for n in pipeline.MART_JOBS}
        out[fmt] |= {f"stat {n}": df for n, df in pipeline.statistics(spark, root, P, fmt).items()}
        # the files of the statistics by name are one order by type and year
        name = "capacity_factors_top_25"
        folder = os.path.join(stats, name, "scenario=base")
        read = spark.read if fmt == "parquet" else spark.read.option("header", True)
        written = [r for f in sorted(os.listdir(folder)) if f.startswith("part-") for r in read.format(fmt).load(os.path.join(folder, f)).collect()]
        assert [r.type for r in written] == ["af", "capacity", "generation"]
    assert set(out["csv"]) == set(out["parquet"]) and {*MARTS, *WIDE_MARTS} <= {*out["csv"], "capacity_factors_top_25"}
    for name, df in out["parquet"].items():
        other = out["csv"][name]
        assert dict(other.dtypes) == dict(df.dtypes), name
        assert rows(other.select(*df.columns)) == rows(df), name


def test_pipeline_marts_then_statistics(spark):
    sym, root = _all_symbols(spark), _scratch()
    names = ["ca_capacity", "ca_hourly_mapping", "dispatch_by_segment_gwh", "trade_gw"]
    pipeline.build_marts(sym, P, root, names=names)
    stats = pipeline.statistics(spark, root, P)
    assert rows(stats["trade_net"].select("hour", "net_imports")) == [(1, 7.0), (2, 7.0)]
    top = stats["capacity_factors_top_25"].where(F.col("type") == "generation").collect()
    assert len(top) == 1 and top[0].scenario == "base"


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from types import SimpleNamespace

    from wattlens.session import ensure_checkpoint_dir
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)


def test_cut_lineage_uses_shared_checkpoint_dir(spark):
    from wattlens.session import cut_lineage, ensure_checkpoint_dir
    d = ensure_checkpoint_dir(spark)
    assert d and spark.sparkContext.getCheckpointDir()
    df = cut_lineage(marts.ca_capacity(capacity_symbols(spark), P))
    assert "LogicalRDD" in df._jdf.queryExecution().analyzed().toString() or df.count() == 4
    assert rows(df) == rows(marts.ca_capacity(capacity_symbols(spark), P))
