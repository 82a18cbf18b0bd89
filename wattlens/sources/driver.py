"""Binding of the driver's TPC-H-shaped tables to the model's symbol tables.

Each symbol is a lazy DataFrame derived from ``region nation customer supplier part orders
lineitem events``, so every job's work grows with those tables. Like stored results, the symbols
come with raw domain names and attribute columns and pass through ``canonicalize``. Measures are
DECIMAL, so sums are exact whatever the order of addition. Rules (the DuckDB oracle follows the
same ones):

* region set: nations of region AMERICA; reporting aggregate region ``NATION_1``.
* lines = lineitem ⋈ supplier ⋈ nation (⋈ part only where a symbol needs the class);
  tech_class = ``lower(p_type)-lower(p_brand)``, vintage = line number, region = supplier nation,
  year = ship year. With ``codes=True`` classes, report types and labels are the model's own keys,
  number ``l_partkey mod n``.
* storage power / energy = return flag R / A, storage class li-ion = line status F; costs use the
  extended price with the last ship year written as an open vintage ``2001+``.
* emissions = order totals per customer nation and order year, in billions.
* report: type = ``lower(p_type)`` + brand digits; unit TWh (status O), gw (flag A, status F),
  other; value = quantity.
* hour map: one part per year 1995–2001, hours 1–8760; segment ``s((37·hour+year) mod 20)``.
* hourly symbols: events summed to cells (type, ``k = event_id mod 5``, nation ``user mod 25``, year
  ``1995+user mod 7``, hour of year), one row of each table per cell; class ``type-all``, vintage
  ``k``. Their capacity is that of the lines by type, vintage (1–7), region and year, so some factors
  find no capacity and much capacity no factor.
* dispatch: segment ``s(orderkey mod 20)``; X = flag N, X_45V = flag A, storage charge /
  discharge = flag R with status O / F.
* trade: importer = customer nation, exporter = supplier nation, order year.
* scenario (optional) = the customer's market segment.

A ship or order year outside 1995–2001 raises an error: it would fall out of the model years.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import lookups
from ..operators.aggregate import sum_by
from ..plans.params import Params
from ..schemas import SYMBOLS
from ..session import stored
from .symbols import SymbolSource, canonicalize, stack_parts

FIRST_YEAR, LAST_YEAR = 1995, 2001
YEARS = list(range(FIRST_YEAR, LAST_YEAR + 1))
SEGMENTS = 20
EVENT_EPOCH = "2024-01-01 00:00:00"
MONEY = "decimal(18,2)"
QUANTITY = "decimal(12,2)"
FACTOR = "decimal(6,5)"

# Binding taxonomies (test vocabulary -> model technologies).
CLASS_TAXONOMY = {"economy": "Gas-CC", "large": "Nuclear", "medium": "Wind", "promo": "Solar",
                  "small": "Offshore Wind"}
REPORT_TAXONOMY = {"large": "Nuclear", "medium": "Wind", "promo": "Solar", "small": "Peak Load",
                   "standard": "Storage", "standard2": "Hydrogen"}
EVENT_CLASS = {"click": "promo", "view": "medium", "signup": "small", "error": "standard",
               "purchase": "large"}
LONG_NAME_WORD = {"anvil": "Hydro", "bolt": "Bio", "gear": "Coal", "gizmo": "Geothermal",
                  "plate": "Hydrogen", "ring": "Gas-CT", "rod": "Gas-CC", "widget": "DROP"}
REPORT_TYPES = ["h2prod_ht", "h2prod_ne", "h2prod_pa", "h2stortrn", "elec_load"]


def cut_lineage(df: DataFrame) -> DataFrame:
    """A table that several symbols read, written once to the scratch folder: unlike a checkpoint it has sizes for the
    planner and columns that can be pruned."""
    return stored(df, "driver")


def segment_of(hour: Column, year: Column) -> Column:
    return F.concat(F.lit("s"), ((hour * 37 + year) % SEGMENTS).cast("string"))


def model_year(date: str) -> Column:
    """The year of a date; an error if it isn't a model year."""
    y = F.year(date)
    bad = F.raise_error(F.concat(F.lit(f"{date}: no model year: "), y.cast("string")))
    return F.when(y.between(FIRST_YEAR, LAST_YEAR) | y.isNull(), y).otherwise(bad.cast("int"))


class LineSymbol(NamedTuple):
    """A symbol whose rows are lines: which ones, and its raw columns."""

    rows: Column | None
    columns: dict[str, Column]

    @property
    def needs_part(self) -> bool:
        return "i" in self.columns or "grc_1" in self.columns


class DriverSymbols(SymbolSource):
    def __init__(self, spark: SparkSession, sf_dir: str, with_scenario: bool = False, codes: bool = False):
        self.spark, self.sf_dir, self.with_scenario, self.codes = spark, sf_dir.rstrip("/"), with_scenario, codes
        self._tables: dict[str, DataFrame] = {}
        self._memo: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        """One relation per table (file listing and footer read once per binding instance)."""
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    def _once(self, key: str, build) -> DataFrame:
        """Build a derived frame once per binding instance; identical subplans also let Spark
        reuse their exchanges."""
        if key not in self._memo:
            self._memo[key] = build()
        return self._memo[key]

    # -- shared bases --------------------------------------------------------------------------
    def nation_names(self) -> DataFrame:
        return self.table("nation").select("n_nationkey", F.col("n_name").alias("region"))

    def with_order_scenario(self, df: DataFrame) -> DataFrame:
        """Tag rows with the market segment of their order's customer (joined table by table)."""
        o = self.table("orders").select("o_orderkey", "o_custkey")
        c = self.table("customer").select("c_custkey", F.col("c_mktsegment").alias("scenario"))
        return (df.join(o, df.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
                .drop("o_orderkey", "o_custkey", "c_custkey"))

    def lines(self, part: bool) -> DataFrame:
        return self._once(f"lines-{part}", lambda: self._lines(part))

    @staticmethod
    def _code(taxonomy: dict[str, str]) -> Column:
        """A key of a taxonomy for every line: number ``l_partkey mod n``."""
        keys = F.array(*[F.lit(k) for k in taxonomy])
        return F.element_at(keys, (F.col("l_partkey") % len(taxonomy) + 1).cast("int"))

    def _lines(self, part: bool) -> DataFrame:
        l = self.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                          "l_quantity", "l_extendedprice", "l_returnflag",
                                          "l_linestatus", "l_shipdate")
        s = self.table("supplier").select("s_suppkey", "s_nationkey")
        # Each dimension is joined as a plain table, so the planner sees its file size: small
        # ones are broadcast, large ones (part/supplier at high scale) are shuffle-joined.
        df = (l.join(s, l.l_suppkey == s.s_suppkey)
              .join(self.nation_names(), F.col("s_nationkey") == F.col("n_nationkey")))
        if part and self.codes:
            df = df.withColumns({"class": F.concat(self._code(lookups.TECH_SET), F.lit("-1")),
                                 "report_type": self._code(lookups.TYPE_TO_TECH), "p_name": self._code(lookups.TECH_SUB)})
        elif part:
            p = self.table("part").select("p_partkey", "p_type", "p_brand", "p_name")
            df = df.join(p, l.l_partkey == p.p_partkey).withColumns({
                "class": F.concat(F.lower("p_type"), F.lit("-"), F.lower("p_brand")),
                "report_type": F.concat(F.lower("p_type"), F.regexp_replace("p_brand", "[^0-9]", ""))})
        year = model_year("l_shipdate")
        df = df.select(
            *(["class", "report_type", "p_name"] if part else []),
            F.col("l_linenumber").cast("string").alias("line"), "region", year.alias("year"),
            F.concat(F.lit("s"), (F.col("l_orderkey") % SEGMENTS).cast("string")).alias("segment"),
            "l_orderkey", "l_returnflag", "l_linestatus",
            F.col("l_quantity").cast(QUANTITY).alias("quantity"), F.col("l_extendedprice").cast(MONEY).alias("price"))
        return self.with_order_scenario(df) if self.with_scenario else df

    # -- symbols whose rows are lines ------------------------------------------------------------
    def line_symbols(self) -> dict[str, LineSymbol]:
        c, flag, status = F.col, F.col("l_returnflag"), F.col("l_linestatus")
        storage = {"j": F.when(status == "F", "li-ion").otherwise("pumped"), "r": c("region"), "t": c("year")}
        plant = {"i": c("class"), "v": c("line"), "r": c("region"), "t": c("year"), "level": c("quantity")}
        cost = {"i": c("class"), "v": F.when(c("year") == LAST_YEAR, f"{LAST_YEAR}+").otherwise(c("year").cast("string")),
                "r": c("region")}
        unit = (F.when(status == "O", "TWh").when((flag == "A") & (status == "F"), "gw").otherwise("other"))
        power, energy = flag == "R", flag == "A"
        return {
            "XC": LineSymbol(None, plant), "IX": LineSymbol(None, plant),
            "GC": LineSymbol(power, storage | {"level": c("quantity")}), "IGC": LineSymbol(power, storage | {"level": c("quantity")}),
            "GR": LineSymbol(energy, storage | {"level": c("quantity")}), "IGR": LineSymbol(energy, storage | {"level": c("quantity")}),
            "capcost": LineSymbol(None, cost | {"value": c("price")}), "fomcost": LineSymbol(None, cost | {"value": c("price")}),
            "icost": LineSymbol(None, cost | {"t": c("year"), "value": c("price")}),
            "icg": LineSymbol(power, storage | {"value": c("price")}), "irg": LineSymbol(energy, storage | {"value": c("price")}),
            "gencaprpt": LineSymbol(None, {"uni_0": c("region"), "grc_1": c("report_type"), "t_2": c("year"), "uni_3": unit,
                                           "value": c("quantity")}),
            "X": LineSymbol(flag == "N", plant | {"s": c("segment")}), "X_45V": LineSymbol(flag == "A", plant | {"s": c("segment")}),
            "G": LineSymbol(power & (status == "O"), storage | {"s": c("segment"), "level": c("quantity")}),
            "GD": LineSymbol(power & (status == "F"), storage | {"s": c("segment"), "level": c("quantity")}),
        }

    def _scen(self, *cols) -> list:
        return list(cols) + (["scenario"] if self.with_scenario else [])

    def _attributes(self, name: str) -> list[Column]:
        """The attribute columns that result files carry beside a variable's level or a set's keys."""
        kind, none = SYMBOLS[name].kind, F.lit(None).cast("double")
        if kind == "variable":
            return [none.alias("marginal"), F.lit(0.0).alias("lower"), none.alias("upper"), F.lit(1.0).alias("scale")]
        return [F.lit("").alias("element_text")] if kind == "set" else []

    def raw(self, name: str) -> DataFrame | None:
        line, fn = self.line_symbols().get(name), getattr(self, f"raw_{name}", None)
        if line is None and (fn is None or name == "hrep"):  # the hour map is stored year by year
            return None
        if line is None:
            rows = fn()
        else:
            rows = self.lines(line.needs_part)
            rows = rows if line.rows is None else rows.where(line.rows)
            rows = rows.select(*self._scen(*[e.alias(n) for n, e in line.columns.items()]))
        return rows.select("*", *self._attributes(name))

    def _load(self, name: str) -> DataFrame | None:
        if name == "hrep":
            return self._once("hrep", self._hour_map)
        if name not in self.line_symbols() and not hasattr(self, f"raw_{name}"):
            return None
        return self._once(f"symbol-{name}", lambda: canonicalize(self.raw(name), SYMBOLS[name]))

    def stacked(self, names: Sequence[str]) -> DataFrame:
        """Symbols made of lines are stacked in one pass over the lines: every line gives the rows
        of all the symbols it belongs to."""
        specs = self.line_symbols()
        if not all(n in specs for n in names):
            return super().stacked(names)
        types: dict[str, str] = {}
        renamed = {}
        for n in names:
            to = SYMBOLS[n].renames()
            renamed[n] = {to.get(raw, raw): e for raw, e in specs[n].columns.items()}
            types |= {k: t.simpleString() for k, t in SYMBOLS[n].columns}
        types |= {m: t for m, t in (("level", QUANTITY), ("value", MONEY)) if m in types}

        def row(n: str) -> Column:
            entry = F.struct(F.lit(n).alias("symbol"), *[renamed[n].get(k, F.lit(None)).cast(t).alias(k) for k, t in types.items()])
            return entry if specs[n].rows is None else F.when(specs[n].rows, entry)

        base = self.lines(any(specs[n].needs_part for n in names))
        return base.select(*self._scen(F.inline(F.array_compact(F.array(*[row(n) for n in names])))))

    def summed(self, parts, keys, measure="level", label="tech", prepare=lambda df: df):
        """Parts made of lines are summed side by side in one aggregate over the lines; only its few rows are then set
        one below the other."""
        specs = self.line_symbols()
        if not all(p.symbol in specs for p in parts):
            return super().summed(parts, keys, measure, label, prepare)
        base = prepare(self.lines(any(specs[p.symbol].needs_part for p in parts)).withColumnsRenamed({"class": "tech_class"}))
        labels, sums, entries = [], [], []
        for i, p in enumerate(parts):
            spec = specs[p.symbol]
            counted = F.lit(True)
            for cond in (spec.rows, p.rows):
                counted = counted if cond is None else counted & cond
            labels.append(p.label.alias(f"__label{i}"))
            sums += [F.sum(F.when(counted, spec.columns[measure])).alias(f"__sum{i}"), F.max(counted).alias(f"__any{i}")]
            entries.append(F.when(F.col(f"__any{i}"), F.struct(F.col(f"__label{i}").alias(label), F.col(f"__sum{i}").alias(measure))))
        found = base.groupBy(*self._scen(*keys), *labels).agg(*sums)
        rows = found.select(*self._scen(*keys), F.inline(F.array_compact(F.array(*entries))))
        return sum_by(rows, [label, *keys], measure)

    # -- other symbols ---------------------------------------------------------------------------
    def raw_cal_r(self) -> DataFrame:
        r = self.table("region").where(F.col("r_name") == "AMERICA").select("r_regionkey")
        n = self.table("nation")
        return n.join(r, n.n_regionkey == r.r_regionkey, "left_semi").select(F.col("n_name").alias("r"))

    def raw_CO2_ELEC(self) -> DataFrame:
        o = self.table("orders").select("o_custkey", "o_totalprice", "o_orderdate")
        c = self.table("customer").select("c_custkey", "c_nationkey")
        df = (o.join(c, o.o_custkey == c.c_custkey)
              .join(self.nation_names(), F.col("c_nationkey") == F.col("n_nationkey")))
        total = F.sum(F.col("o_totalprice").cast(MONEY)).cast("decimal(24,2)") * F.lit("0.000000001").cast("decimal(9,9)")
        return df.groupBy(F.col("region").alias("r"), model_year("o_orderdate").alias("t")).agg(total.alias("level"))

    def raw_hrep(self, year: int) -> DataFrame:
        """The hour map of one model year, as its own file would hold it."""
        h = self.spark.range(1, lookups.HOURS_PER_YEAR + 1).select(F.lit(year).alias("t"), F.col("id").cast("int").alias("h"))
        return h.withColumn("s", segment_of(F.col("h"), F.col("t"))).select("*", *self._attributes("hrep"))

    def _hour_map(self) -> DataFrame:
        return stack_parts([self.raw_hrep(y) for y in YEARS], "hrep")

    def cells(self) -> DataFrame:
        """Events summed once to (type, k, region, year, hour): at most 5 x 5 x 25 x 7 x 8,760 rows, however
        many events. All hourly symbols read this stored table, so the events are scanned once."""
        return self._once("cells", lambda: cut_lineage(self._cells()))

    def _cells(self) -> DataFrame:
        hours = F.expr(f"timestampdiff(HOUR, timestamp_ntz'{EVENT_EPOCH}', ts)")
        cells = (self.table("events")
                 .groupBy("event_type", (F.col("event_id") % len(REPORT_TYPES)).cast("int").alias("k"),
                          (F.col("user_id") % 25).cast("int").alias("n_nationkey"),
                          (F.lit(FIRST_YEAR) + F.col("user_id") % len(YEARS)).cast("int").alias("t"),
                          (hours % lookups.HOURS_PER_YEAR + 1).cast("int").alias("h"))
                 .agg(F.sum(F.col("value").cast(MONEY)).cast(MONEY).alias("value")))
        cells = cells.join(self.nation_names().withColumnRenamed("region", "r"), "n_nationkey").drop("n_nationkey")
        return cells.withColumn("s", segment_of(F.col("h"), F.col("t")))

    def raw_load_8760(self):
        return self.cells().select("r", "t", "h", "value")

    def raw_load_100(self):
        return self.cells().select("r", "t", "s", "value")

    def raw_dspsrpt_r(self) -> DataFrame:
        group = F.when(F.col("event_type") == "error", F.lit("demand")).otherwise(F.lit("supply"))
        typ = F.element_at(F.array(*[F.lit(t) for t in REPORT_TYPES]), F.col("k") + 1)
        return self.cells().select(group.alias("uni_0"), F.col("s").alias("s_1"), F.col("r").alias("r_2"),
                                   typ.alias("uni_3"), F.col("t").alias("t_4"), "value")

    def _vrsc(self, slot: str) -> DataFrame:
        word = F.try_element_at(F.create_map(*[x for k, v in EVENT_CLASS.items() for x in (F.lit(k), F.lit(v))]),
                                F.col("event_type"))
        factor = F.least(F.lit(1).cast(FACTOR), (F.least(F.col("value"), F.lit(500).cast(MONEY)) * F.lit("0.002").cast("decimal(3,3)")).cast(FACTOR))
        return self.cells().select(F.concat(word, F.lit("-all")).alias("uni"),
                                   F.col("k").cast("string").alias("v"), "r", "t", slot, factor.alias("value"))

    def raw_vrsc_8760(self):
        return self._vrsc("h")

    def raw_vrsc_100(self):
        return self._vrsc("s")

    def raw_E(self) -> DataFrame:
        l = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        c = self.table("customer").select("c_custkey", "c_nationkey", *(["c_mktsegment"] if self.with_scenario else []))
        s = self.table("supplier").select("s_suppkey", "s_nationkey")
        n = self.table("nation").select("n_nationkey", "n_name")
        ni = n.select(F.col("n_nationkey").alias("ni_key"), F.col("n_name").alias("r_2"))
        ne = n.select(F.col("n_nationkey").alias("ne_key"), F.col("n_name").alias("r_1"))
        df = (l.join(o, l.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey)
              .join(ni, F.col("c_nationkey") == F.col("ni_key"))
              .join(s, l.l_suppkey == s.s_suppkey).join(ne, F.col("s_nationkey") == F.col("ne_key")))
        scen = [F.col("c_mktsegment").alias("scenario")] if self.with_scenario else []
        return df.select(F.concat(F.lit("s"), (F.col("l_orderkey") % SEGMENTS).cast("string")).alias("s_0"),
                         "r_1", "r_2", model_year("o_orderdate").alias("t_3"),
                         F.col("l_quantity").cast(QUANTITY).alias("level"), *scen)

    def hourly_capacity(self) -> DataFrame:
        """Capacity of the lines, one row per part type (class ``type-all``), vintage, region and year (and
        scenario): at most 6 x 7 x 25 x 7 rows each, however many lines. Stored, as the factors of both
        time slots and the scenarios' model years read it."""
        def build() -> DataFrame:
            xc = self.get("XC").withColumn("tech_class", F.concat(F.substring_index("tech_class", "-", 1), F.lit("-all")))
            return cut_lineage(sum_by(xc, ["tech_class", "vintage", "region", "year"], "level")
                               .withColumn("level", F.col("level").cast(QUANTITY)))
        return self._once("hourly_capacity", build)

    # -- data-derived taxonomies and names -------------------------------------------------------
    def scenarios(self) -> DataFrame:
        return self.table("customer").select(F.col("c_mktsegment").alias("scenario")).distinct()

    def area_map(self) -> DataFrame:
        return self._once("area_map", self._area_map)

    def _area_map(self) -> DataFrame:
        n = self.table("nation").select("n_name", "n_regionkey")
        r = self.table("region").select("r_regionkey", "r_name")
        area = (F.when(F.col("r_name") == "AMERICA", F.lit("ca"))
                .when(F.col("r_name").isin("ASIA", "EUROPE"), F.lit("rest")))
        return (n.join(r, n.n_regionkey == r.r_regionkey)
                .select(F.col("n_name").alias("key"), area.alias("value")).where(F.col("value").isNotNull()))

    def report_labels(self) -> DataFrame:
        """Report rows labelled with a long technology label: the last word of the part name
        (mapped by the 8-entry long-name taxonomy of the binding)."""
        label = F.col("p_name") if self.codes else F.substring_index(F.col("p_name"), " ", -1)
        return self.lines(True).select("region", label.alias("label"), "year", F.col("quantity").alias("value"))


def driver_params(symbols: DriverSymbols | None = None) -> Params:
    """Job parameters that fit the binding (years 1995–2001 stand for 2020–2050)."""
    p = Params(
        class_taxonomy=dict(CLASS_TAXONOMY), report_taxonomy=dict(REPORT_TAXONOMY),
        years=list(YEARS), vintages=[str(y) for y in YEARS[:-1]] + [f"{LAST_YEAR}+"], pivot_years=list(YEARS),
        open_vintage=f"{LAST_YEAR}+", report_region="NATION_1", home_area="ca",
        dispatch_excluded=["Nuclear"], cumulative_cutoff=1999, comparison_years=[1997, 1999, 2001],
        window_year=1996, long_name_taxonomy=dict(LONG_NAME_WORD))
    if symbols is not None:
        p = p.with_(area_map=symbols.area_map)  # built on first use (trade jobs only)
        if symbols.codes:
            p = p.with_(class_taxonomy=dict(lookups.TECH_SET), report_taxonomy=dict(lookups.TYPE_TO_TECH),
                        long_name_taxonomy=dict(lookups.TECH_SUB))
    return p
