"""Dispatch and trade marts (segment values fanned out to hours) and their statistics.

The regional/technology aggregation happens *before* the fan-out, so the hour join only sees
(scenario, tech, year, segment) rows; the hour map is bounded by years x 8,760 per scenario.
Windows are partitioned by (scenario, year, ...), i.e. at most one model year of hours each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.aggregates import na_mean, na_sum
from ..functions.scalar import calendar_parts, hour_to_timestamp, ordered_tech, recode_if, tech_order
from ..lookups import storage_label
from ..operators.aggregate import scen_keys, sum_by
from ..operators.expand import expand_to_hours, rep_hours
from ..operators.filters import not_in_keep_null, subset_region
from ..operators.lookup import apply_lookup
from ..operators.partitioning import cluster_by_year
from ..operators.windows import group_total, ntile_nonnull, share_of_group
from ..sources.symbols import Part, SymbolSource
from .marts import with_tech
from .params import Params


#: Symbols of dispatch; only the last may be absent.
DISPATCH_SYMBOLS = ("X", "G", "GD", "X_45V")


def dispatch_by_segment(sym: SymbolSource, p: Params, symbols: Sequence[str] = DISPATCH_SYMBOLS) -> DataFrame:
    """tech, year, segment, level, hour: generator dispatch by technology (``X`` and the
    optional ``X_45V``) plus storage charge and discharge, summed over the region set in one
    aggregate, fanned out to the hours of each segment. ``symbols`` limits the job to some."""
    names = [n for n in symbols if n != "X_45V" or sym.available(n)]
    stored = {"G": F.lit(storage_label("charge")), "GD": F.lit(storage_label("discharge"))}
    parts = [Part(n, stored.get(n, F.col("tech"))) for n in names]
    plants = set(names) - set(stored)

    def regional(df: DataFrame) -> DataFrame:
        own = subset_region(df, sym.get("cal_r"))
        return with_tech(own, p) if plants else own

    seg = sym.summed(parts, ["year", "segment"], prepare=regional)
    out = expand_to_hours(seg, rep_hours(sym))
    return out.select(*scen_keys(out), "tech", "year", "segment", "level", "hour")


def trade_by_segment(sym: SymbolSource, p: Params) -> DataFrame:
    """year, segment, region_exp, region_imp, trade_gw, hour: flows between reporting areas
    (regions outside the area map vanish), fanned out to hours."""
    e = sym.get("E")
    areas = p.area_map() if callable(p.area_map) else p.area_map
    e = apply_lookup(e, "region_exp", "area_exp", areas)
    e = apply_lookup(e, "region_imp", "area_imp", areas)
    e = e.drop("region_exp", "region_imp").withColumnsRenamed({"area_exp": "region_exp", "area_imp": "region_imp"})
    agg = sum_by(e, ["year", "segment", "region_exp", "region_imp"], "level", "trade_gw")
    out = expand_to_hours(agg, rep_hours(sym))
    return out.select(*scen_keys(out), "year", "segment", "region_exp", "region_imp", "trade_gw", "hour")


# -- statistics ----------------------------------------------------------------------------------

def _calendar(df: DataFrame) -> DataFrame:
    df = df.withColumn("time", hour_to_timestamp("hour"))
    return df.withColumns(calendar_parts("time"))


def _generation_rows(d: DataFrame, p: Params) -> DataFrame:
    """Dispatch without excluded technologies and storage charging; discharge becomes Storage."""
    d = d.where(not_in_keep_null("tech", p.dispatch_excluded) & (F.col("tech") != storage_label("charge")))
    return d.withColumn("tech", recode_if("tech", [storage_label("discharge")], "Storage"))


def dispatch_clean(d: DataFrame, p: Params) -> DataFrame:
    """Dispatch for the figures: base year left out, excluded technologies and charging
    removed, calendar parts added, ``tech`` as ordered category (NULL when unlisted) plus its
    position ``tech_order``."""
    d = _generation_rows(d.where(F.col("year") != p.base_year), p)
    d = _calendar(d)
    return d.withColumns({"tech_order": tech_order("tech", p.tech_order),
                          "tech": ordered_tech("tech", p.tech_order)})


def storage_charge(d: DataFrame, p: Params) -> DataFrame:
    """year, segment, hour, storage_charge."""
    d = d.where((F.col("year") != p.base_year) & not_in_keep_null("tech", p.dispatch_excluded))
    d = d.where(F.col("tech") == storage_label("charge"))
    return d.select(*scen_keys(d), "year", "segment", "hour", F.col("level").alias("storage_charge"))


def dispatch_hour_profile(clean: DataFrame, p: Params) -> DataFrame:
    """tech, year, hour_of_day, level: mean dispatch per hour of day."""
    keys = scen_keys(clean) + ["tech", "year", "hour_of_day"]
    return clean.groupBy(*keys).agg(na_mean("level").alias("level"))


def dispatch_window(clean: DataFrame, p: Params) -> DataFrame:
    """The first ``window_hours`` hours of one model year."""
    return clean.where((F.col("year") == p.window_year) & (F.col("hour") < p.window_hours + 1))


def dispatch_deciles(d: DataFrame, p: Params) -> DataFrame:
    """year, tech, gen_ntile, generation, pct_gen: hours split into deciles of total generation
    per (year, tech); mean dispatch per decile and its share within (year, decile). Ties in
    total generation are broken by hour."""
    d = _generation_rows(cluster_by_year(d).dropDuplicates(), p)
    d = d.withColumn("tech", ordered_tech("tech", p.tech_order))
    sk = scen_keys(d)
    d = d.withColumn("total_gen", group_total("level", sk + ["year", "hour"]))
    d = d.withColumn("gen_ntile", ntile_nonnull("total_gen", 10, sk + ["year", "tech"], ["hour", "segment"]))
    g = d.groupBy(*sk, "year", "tech", "gen_ntile").agg(na_mean("level").alias("generation"))
    return g.withColumn("pct_gen", share_of_group("generation", sk + ["year", "gen_ntile"]))


def trade_net(t: DataFrame, p: Params) -> DataFrame:
    """year, hour, imports, exports, net_imports of the home area (flows inside the area and
    between other areas ignored; a missing flow makes its sum missing); base year left out."""
    home = p.home_area
    imp = (F.col("region_imp") == home) & (F.col("region_exp") != home)
    exp = (F.col("region_exp") == home) & (F.col("region_imp") != home)
    keys = scen_keys(t) + ["year", "hour"]
    g = (t.where(F.col("year") != p.base_year).groupBy(*keys)
         .agg(na_sum(F.when(imp, F.col("trade_gw")).otherwise(F.lit(0))).alias("imports"),
              na_sum(F.when(exp, F.col("trade_gw")).otherwise(F.lit(0))).alias("exports")))
    return g.withColumn("net_imports", F.col("imports") - F.col("exports"))
