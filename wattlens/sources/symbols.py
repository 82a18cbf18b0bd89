"""Scans of the model's result symbols.

A *symbol source* hands out one DataFrame per symbol, already in canonical form (canonical key
names, the measure column, attributes dropped). Jobs only ever call ``get``/``stacked``,
so the same job runs against stored Parquet symbol tables (``ParquetSymbols``) or against any
other binding (``sources.driver``).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DecimalType

from ..operators.aggregate import sum_by
from ..schemas import DROPPED_ATTRIBUTES, SYMBOLS, Symbol
from .folders import Folders, partition_value
from .sinks import load, write_table


class SymbolMissing(KeyError):
    pass


def rename_domains(df: DataFrame, mapping: dict) -> DataFrame:
    """Rename raw domain names to canonical ones; names absent from ``df`` are ignored."""
    present = {k: v for k, v in mapping.items() if k in df.columns and k != v}
    return df.withColumnsRenamed(present) if present else df


def canonicalize(df: DataFrame, symbol: Symbol) -> DataFrame:
    """Raw symbol records -> canonical layout: rename domains, drop attributes, keep the registry
    columns (plus ``scenario``) with the registry types. A DECIMAL measure stays DECIMAL, so that
    sums of it are exact."""
    df = rename_domains(df, symbol.renames())
    df = df.drop(*[c for c in DROPPED_ATTRIBUTES if c in df.columns])
    missing = [n for n, _ in symbol.columns if n not in df.columns]
    if missing:
        raise SymbolMissing(f"symbol {symbol.name!r} has no column {missing} (found: {df.columns})")

    def typed(name: str, type_: DataType) -> Column:
        exact = name == symbol.measure and isinstance(df.schema[name].dataType, DecimalType)
        return F.col(name) if exact else F.col(name).cast(type_).alias(name)

    cols = [typed(n, t) for n, t in symbol.columns]
    if "scenario" in df.columns:
        cols.append(F.col("scenario"))
    return df.select(*cols)


def empty_symbol(spark: SparkSession, symbol: Symbol, with_scenario: bool = False) -> DataFrame:
    schema = symbol.schema
    if with_scenario:
        schema = schema.add("scenario", "string")
    return spark.createDataFrame([], schema)


class Part(NamedTuple):
    """A symbol's share of a sum: the label of its rows, over canonical columns and those that ``prepare`` adds, and which rows count."""

    symbol: str
    label: Column
    rows: Column | None = None


class SymbolSource:
    """Base class: subclasses implement ``_load(name) -> DataFrame | None``."""

    spark: SparkSession
    with_scenario: bool = False

    def _load(self, name: str) -> DataFrame | None:  # pragma: no cover - interface
        raise NotImplementedError

    def get(self, name: str, required: bool = True) -> DataFrame:
        df = self._load(name)
        if df is None:
            if required:
                raise SymbolMissing(f"symbol {name!r} is not available")
            return empty_symbol(self.spark, SYMBOLS[name], self.with_scenario)
        return df

    def stacked(self, names: Sequence[str]) -> DataFrame:
        """Several symbols as one table: a ``symbol`` column and the union of their columns (NULL where
        a symbol has none). Sources whose symbols share a base override this with one pass over it."""
        frames = [self.get(n).withColumn("symbol", F.lit(n)) for n in names]
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out

    def summed(self, parts: Sequence[Part], keys: Sequence[str], measure: str = "level", label: str = "tech",
               prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """(label, keys, measure): the measure of all parts, summed by label and keys. Sources whose symbols share a
        base override this with one conditional aggregate over it."""
        rows = prepare(self.stacked([p.symbol for p in parts]))
        name, wanted = F.lit(None).cast("string"), F.lit(False)
        for p in parts:
            own = F.col("symbol") == p.symbol
            name, wanted = F.when(own, p.label).otherwise(name), wanted | (own if p.rows is None else own & p.rows)
        return sum_by(rows.where(wanted).withColumn(label, name), [label, *keys], measure)

    def raw(self, name: str) -> DataFrame | None:
        """The symbol as result files hold it: raw domain names, attribute columns. Sources that only have
        canonical symbols give those."""
        return self._load(name)

    def available(self, name: str) -> bool:
        return self._load(name) is not None

    def scenarios(self) -> DataFrame:
        """Distinct scenario names. Stored symbols list folders instead."""
        return self.get("IX").select("scenario").distinct()

    def override(self, **builders: Callable[[], DataFrame]) -> "SymbolSource":
        return _Overridden(self, builders)


class _Overridden(SymbolSource):
    def __init__(self, base: SymbolSource, builders: dict):
        self.base, self.builders = base, builders
        self.spark, self.with_scenario = base.spark, base.with_scenario

    def _load(self, name):
        if name in self.builders:
            return self.builders[name]()
        return self.base._load(name)

    def stacked(self, names):
        return super().stacked(names) if set(names) & set(self.builders) else self.base.stacked(names)

    def summed(self, parts, *args, **kw):
        return super().summed(parts, *args, **kw) if {p.symbol for p in parts} & set(self.builders) else self.base.summed(parts, *args, **kw)

    def scenarios(self):
        return self.base.scenarios()


class ParquetSymbols(SymbolSource):
    """Symbols stored as ``<root>/<symbol>/scenario=<s>/*.parquet``.

    The scenario list becomes a partition filter, so only the requested scenario folders are
    read. Column names are those of the files (raw or canonical); types become the registry's. A
    symbol without a folder is absent; anything else that can't be read is an error.
    """

    def __init__(self, spark: SparkSession, root: str, scenarios: Iterable[str] | None = None):
        self.spark, self.root = spark, root
        self.selected = list(scenarios) if scenarios is not None else None
        self.with_scenario = True
        self._memo: dict[str, DataFrame | None] = {}

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def _load(self, name: str) -> DataFrame | None:
        if name not in self._memo:
            self._memo[name] = self._scan(name)
        return self._memo[name]

    def _scan(self, name: str) -> DataFrame | None:
        if name not in SYMBOLS:
            return None
        try:
            df = load(self.spark, self.path(name))
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        if self.selected is not None and "scenario" in df.columns:
            df = df.where(F.col("scenario").isin(self.selected))
        return canonicalize(df, SYMBOLS[name])

    def scenarios(self) -> DataFrame:
        """The scenarios of ``IX``, from the names of its folders: no file is opened and no job runs. An ``IX`` without
        scenario folders is asked for its column."""
        listed = [partition_value(n) for n in Folders(self.spark, self.root).names(self.path("IX")) if n.startswith("scenario=")]
        if not listed:
            return super().scenarios()
        wanted = [v for v in listed if self.selected is None or v in self.selected]
        return self.spark.createDataFrame([(v,) for v in wanted], "scenario string")

    def get(self, name: str, required: bool = True) -> DataFrame:
        if required and self._load(name) is None:
            raise SymbolMissing(f"symbol {name!r} is missing: there is no folder {self.path(name)}")
        return super().get(name, required)


class FrameSymbols(SymbolSource):
    """Symbols given as DataFrames in raw or canonical form (tests, notebooks, other readers)."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame]):
        self.spark, self.frames = spark, dict(frames)
        self.with_scenario = any("scenario" in f.columns for f in self.frames.values())

    def raw(self, name: str) -> DataFrame | None:
        return self.frames.get(name)

    def _load(self, name: str) -> DataFrame | None:
        df = self.frames.get(name)
        return None if df is None else canonicalize(df, SYMBOLS[name])


def stack_parts(parts: Sequence[DataFrame], symbol: str) -> DataFrame:
    """Parts of one symbol (e.g. one hour map per model year) as one table."""
    out = canonicalize(parts[0], SYMBOLS[symbol])
    for part in parts[1:]:
        out = out.unionByName(canonicalize(part, SYMBOLS[symbol]))
    return out


def scan_multi_file(spark: SparkSession, paths: Sequence[str], symbol: str, key: str | None = None, pattern: str | None = None) -> DataFrame:
    """Several files (or folders) of one symbol in one scan; each may have raw or canonical names.

    ``key`` names a canonical column that the file's name gives: ``pattern`` is a regular expression whose first
    group is its value. Files that hold the column, too, must agree with their names; a name without the
    pattern, or a value that isn't of the column's type, is an error.
    """
    spec = SYMBOLS[symbol]
    df = load(spark, paths, mergeSchema="true")
    raw_of: dict[str, list[str]] = {}
    for raw in df.columns:
        raw_of.setdefault(spec.renames().get(raw, raw), []).append(raw)
    cols = {name: F.coalesce(*[F.col(f"`{c}`") for c in raws]) for name, raws in raw_of.items() if name not in DROPPED_ATTRIBUTES}
    if key is not None:
        type_ = dict(spec.columns)[key]
        text = F.regexp_extract(F.col("_metadata.file_path"), pattern, 1)
        named = F.try_to_number(text, F.lit("9" * 18)).cast(type_) if type_.simpleString() in ("int", "bigint") else F.nullif(text, F.lit(""))
        problem = F.raise_error(F.concat(F.lit(f"the name gives no {key}, or another one than the file: "), F.col("_metadata.file_path"))).cast(type_)
        own = cols.get(key, F.lit(None)).cast(type_)
        cols[key] = F.when(named.isNotNull() & (own.isNull() | (own == named)), named).otherwise(problem)
    return canonicalize(df.select(*[c.alias(n) for n, c in cols.items()]), spec)


def write_symbols(source: SymbolSource, names: Iterable[str], root: str, scenarios: Sequence[str] | None = None) -> None:
    """Store a source's raw symbols as ``<root>/<symbol>``, in a folder for each scenario where it has scenarios
    (rows of one scenario are spread over files of a fair size), with the staged commit of the marts."""
    for name in names:
        raw = source.raw(name)
        if raw is None:
            raise SymbolMissing(f"symbol {name!r} is not available")
        if "scenario" in raw.columns:
            raw = raw.hint("rebalance", "scenario")
        write_table(raw, os.path.join(root, name), scenarios=scenarios)
