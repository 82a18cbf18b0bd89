"""Hourly marts (loads, availability factors, the hourly mapping) and the statistics derived
from them (net load, peak-hour factors, profiles, hour-vs-segment comparisons, duration curves).

Size: the hourly mapping holds at most techs x years x 8,760 rows per scenario whatever the size
of the inputs; the heavy work is the availability-factor aggregation over the (class, vintage,
region, hour) symbol, which runs as a partial + final aggregate after a join with capacity
(small: one row per class/vintage/region/year, so AQE broadcasts it from its runtime size).

Dense mode (default): every renewable technology present in the inputs gets a row for every
calendar (year, hour) of the hour map, with 0 generation/capacity/load where the inputs hold nothing (the categorical
group-by behaviour the downstream net-load arithmetic relies on). The calendar spine is the
hour map itself (expanded to each scenario's model years when it is shared by all scenarios, see
``hour_map``) and the technology list is a fixed 3-entry literal, so no cross join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.aggregates import floor0, mean, na_mean, weighted_mean_fallback
from ..functions.scalar import calendar_parts, hour_to_timestamp
from ..operators.aggregate import scen_keys, sum_by
from ..operators.expand import rep_hours
from ..operators.filters import subset_data, subset_region
from ..operators.partitioning import cluster_by_year
from ..operators.reshape import separate
from ..operators.windows import avg_rank, position_desc, ratio_to_group_max, top_ranked
from ..sources.symbols import SymbolSource
from .marts import with_tech
from .params import Params


# Scenario-specific inputs of the hourly marts (the hour map, loads and availability factors are
# usually shared by all scenarios).
SCENARIO_SOURCES = ("XC", "dspsrpt_r")


def hour_map(sym: SymbolSource, sources: Sequence[str] = SCENARIO_SOURCES) -> DataFrame:
    """The hour map for every scenario of the run.

    A shared hour map (no ``scenario`` column) is expanded to each scenario's model years by an
    equi-join on ``year`` with the distinct (scenario, year) pairs of the scenario-specific
    inputs: a fan-out bounded by the hours of one year, not a cross join."""
    rep = rep_hours(sym)
    if "scenario" in rep.columns:
        return rep
    pairs = [sym.get(n, required=False) for n in sources]
    pairs = [f.select("scenario", "year") for f in pairs if "scenario" in f.columns]
    if not pairs:
        return rep
    sy = pairs[0]
    for f in pairs[1:]:
        sy = sy.unionByName(f)
    return rep.join(sy.distinct(), on="year")


def _join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    keys = list(keys) + (["scenario"] if "scenario" in left.columns and "scenario" in right.columns else [])
    return left.join(right, on=keys, how=how)


# -- loads ---------------------------------------------------------------------------------------

def load_hour(sym: SymbolSource, p: Params) -> DataFrame:
    return sum_by(subset_region(sym.get("load_8760"), sym.get("cal_r")), ["year", "hour"], "value", "load_h")


def load_segment(sym: SymbolSource, p: Params) -> DataFrame:
    return sum_by(subset_region(sym.get("load_100"), sym.get("cal_r")), ["year", "segment"], "value", "load_s")


def hydrogen_load(sym: SymbolSource, p: Params) -> DataFrame:
    """year, segment, hydrogen_load: hydrogen line items of the demand report, summed over the
    region set."""
    df = sym.get("dspsrpt_r").where(F.col("group") == p.hydrogen_group)
    df = subset_region(subset_data(df, "type", p.hydrogen_types), sym.get("cal_r"))
    return sum_by(df, ["year", "segment"], "value", "hydrogen_load")


def ca_loads(sym: SymbolSource, p: Params) -> DataFrame:
    """year, hour, segment, load_hour, load_segment, hydrogen_load on the hour map."""
    how = "left" if p.dense else "inner"
    df = _join(hour_map(sym), load_hour(sym, p), ["year", "hour"], how)
    df = _join(df, load_segment(sym, p), ["year", "segment"], how)
    df = _join(df, hydrogen_load(sym, p), ["year", "segment"], how)
    z = (lambda c: F.coalesce(F.col(c), F.lit(0))) if p.dense else F.col
    return df.select(*scen_keys(df), "year", "hour", "segment", z("load_h").alias("load_hour"),
                     z("load_s").alias("load_segment"), z("hydrogen_load").alias("hydrogen_load"))


# -- availability factors ------------------------------------------------------------------------

def _af_sparse(sym: SymbolSource, p: Params, slot: str) -> DataFrame:
    """tech, year, <slot>, generation, capacity, af for the renewable technologies."""
    symbol = "vrsc_8760" if slot == "hour" else "vrsc_100"
    cal = sym.get("cal_r")
    af = subset_data(with_tech(subset_region(sym.get(symbol), cal), p), "tech", p.re_tech)
    # Capacity rows outside the region set or of other technologies can never match (tech is a
    # function of the join key tech_class), so they are dropped before the join: the build side
    # shrinks to the home-region renewables, which keeps it under the broadcast size check.
    cap = subset_data(with_tech(subset_region(sym.get("XC"), cal), p), "tech", p.re_tech)
    cap = cap.select(*scen_keys(cap), "tech_class", "vintage", "region", "year",
                     F.col("level").alias("capacity"))
    df = _join(af, cap, ["tech_class", "vintage", "region", "year"], "inner")
    keys = scen_keys(df) + ["tech", "year", slot]
    agg = (df.groupBy(*keys)
           .agg(F.sum(F.col("capacity") * F.col("value")).alias("generation"),
                F.sum("capacity").alias("capacity"), mean("value").alias("af_base")))
    return agg.select(*keys, "generation", "capacity",
                      weighted_mean_fallback("generation", "capacity", "af_base").alias("af"))


def _tech_spine(spine: DataFrame, techs: Sequence[str]) -> DataFrame:
    """Calendar rows x renewable technologies (a fixed literal list: no cross join)."""
    return spine.withColumn("tech", F.explode(F.array(*[F.lit(t) for t in techs])))


def _keep_observed(df: DataFrame, *markers: str) -> DataFrame:
    """Keep the technologies that matched at least one row of every marked aggregate (a
    group-by over a plain text key only emits observed values). ``markers`` are columns that
    are non-NULL where the left join found a row. One window per (scenario, tech), over the hours
    of all model years (61,320 for seven): asking the aggregates instead would compute them, and
    so scan the availability factors, a second time."""
    w = Window.partitionBy(*scen_keys(df), "tech")
    cond = None
    for m in markers:
        hit = F.max(F.col(m).isNotNull()).over(w)
        cond = hit if cond is None else cond & hit
    return df.withColumn("_observed", cond).where(F.col("_observed")).drop("_observed", *markers)


def _af(sym: SymbolSource, p: Params, slot: str) -> DataFrame:
    sparse = _af_sparse(sym, p, slot)
    if not p.dense:
        return sparse
    spine = hour_map(sym)
    spine = spine.select(*scen_keys(spine), "year", slot).distinct()
    df = _join(_tech_spine(spine, p.re_tech), sparse.withColumn("_hit", F.lit(True)),
               ["tech", "year", slot], "left")
    df = _keep_observed(df, "_hit")
    return df.select(*scen_keys(df), "tech", "year", slot,
                     F.coalesce("generation", F.lit(0)).alias("generation"),
                     F.coalesce("capacity", F.lit(0)).alias("capacity"), "af")


def af_hour(sym: SymbolSource, p: Params) -> DataFrame:
    """tech, year, hour, generation_h, capacity, af_h (capacity-weighted availability)."""
    df = _af(sym, p, "hour")
    return df.select(*scen_keys(df), "tech", "year", "hour", F.col("generation").alias("generation_h"),
                     "capacity", F.col("af").alias("af_h"))


def af_segment(sym: SymbolSource, p: Params) -> DataFrame:
    """tech, year, segment, generation_s, af_s."""
    df = _af(sym, p, "segment")
    return df.select(*scen_keys(df), "tech", "year", "segment", F.col("generation").alias("generation_s"),
                     F.col("af").alias("af_s"))


def ca_hourly_mapping(sym: SymbolSource, p: Params) -> DataFrame:
    """tech, year, hour, generation_h, capacity, af_h, segment, generation_s, af_s, load_h,
    load_s, hydrogen_load; missing availability factors written as 0.

    Star join around the hour map. Every right side is an aggregate keyed by its join keys and
    the hour map is de-duplicated, so the result has no duplicate rows to remove."""
    how = "left" if p.dense else "inner"
    rep = hour_map(sym)
    h = (_af_sparse(sym, p, "hour").withColumnsRenamed({"generation": "generation_h", "af": "af_h"})
         .withColumn("_hit_h", F.lit(True)))
    s = (_af_sparse(sym, p, "segment").drop("capacity")
         .withColumnsRenamed({"generation": "generation_s", "af": "af_s"}).withColumn("_hit_s", F.lit(True)))
    if p.dense:
        df = _join(_tech_spine(rep, p.re_tech), h, ["tech", "year", "hour"], "left")
    else:
        df = _join(h, rep, ["year", "hour"], "inner")
    df = _join(df, s, ["year", "segment", "tech"], how)
    df = _keep_observed(df, "_hit_h", "_hit_s") if p.dense else df.drop("_hit_h", "_hit_s")
    df = _join(df, load_hour(sym, p), ["year", "hour"], how)
    df = _join(df, load_segment(sym, p), ["year", "segment"], how)
    df = _join(df, hydrogen_load(sym, p), ["year", "segment"], how)
    z = (lambda c: F.coalesce(F.col(c), F.lit(0))) if p.dense else F.col
    return df.select(*scen_keys(df), "tech", "year", "hour", z("generation_h").alias("generation_h"),
                     z("capacity").alias("capacity"), F.coalesce("af_h", F.lit(0.0)).alias("af_h"),
                     "segment", z("generation_s").alias("generation_s"),
                     F.coalesce("af_s", F.lit(0.0)).alias("af_s"), z("load_h").alias("load_h"),
                     z("load_s").alias("load_s"), z("hydrogen_load").alias("hydrogen_load"))


# -- statistics on the hourly mapping --------------------------------------------------------------

_MEASURES = [("generation_h", "generation_hour"), ("generation_s", "generation_segment"),
             ("af_h", "af_hour"), ("af_s", "af_segment"), ("load_h", "load_hour"),
             ("load_s", "load_segment"), ("capacity", "capacity_hour"), ("capacity", "capacity_segment")]


def hourly_long(mapping: DataFrame) -> DataFrame:
    """tech, year, hour, segment, hydrogen_load, type, aggregation, value: eight measures per
    mapping row (loads include hydrogen; capacity is repeated for both aggregations)."""
    ids = scen_keys(mapping) + ["tech", "year", "hour", "segment", "hydrogen_load"]
    cols = []
    for src, name in _MEASURES:
        c = F.col(src)
        if src in ("load_h", "load_s"):
            c = c + F.col("hydrogen_load")
        cols.append(c.alias(name))
    wide = mapping.select(*ids, *cols)
    long = wide.unpivot(ids, [n for _, n in _MEASURES], "id", "value")
    return separate(long, "id", ["type", "aggregation"], "_")


def _by_tech(techs: Sequence[str], measure: str | Column, name: str) -> list[Column]:
    m = F.col(measure) if isinstance(measure, str) else measure
    return [F.max(F.when(F.col("tech") == t, m)).alias(f"{t}|{name}") for t in techs]


_NET_MEASURES = (("generation", "generation_h"), ("capacity", "capacity"), ("af", "af_h"))


def _net_load(mapping: DataFrame, p: Params) -> DataFrame:
    """One row per (year, hour): every renewable technology's generation, capacity and factor, the load (incl.
    hydrogen) and net load = load - renewable generation."""
    techs = p.re_tech
    keys = scen_keys(mapping) + ["year", "hour", "segment", "hydrogen_load"]
    aggs = [F.max(F.col("load_h") + F.col("hydrogen_load")).alias("load")]
    for name, src in _NET_MEASURES:
        aggs += _by_tech(techs, src, name)
    net = F.col("load")
    for t in techs:
        net = net - F.col(f"`{t}|generation`")
    return mapping.groupBy(*keys).agg(*aggs).withColumn("net_load", net)


def _by_type(wide: DataFrame, p: Params) -> DataFrame:
    """Three rows per hour, of type generation, capacity and af, with one column per renewable technology."""
    keys = scen_keys(wide) + ["year", "hour", "segment", "hydrogen_load"]
    rows = F.array(*[F.struct(F.lit(name).alias("type"), *[F.col(f"`{t}|{name}`").alias(t) for t in p.re_tech])
                     for name, _ in _NET_MEASURES])
    own = [c for c in ("order_id",) if c in wide.columns]
    long = wide.select(*keys, "load", "net_load", *own, F.inline(rows))
    return long.select(*keys, "load", "type", *[F.col(f"`{t}`") for t in p.re_tech], "net_load", *own)


def _net_rank(wide: DataFrame, p: Params) -> Column:
    """Average-tie rank of descending net load within a year. The three types of an hour share it."""
    return avg_rank("net_load", scen_keys(wide) + ["year"], tie_break=["hour", "segment"], nullable=not p.dense)


def net_load_hourly(mapping: DataFrame, p: Params) -> DataFrame:
    """Per (year, hour) and type in {generation, capacity, af}: one column per renewable
    technology, the load (incl. hydrogen), net load = load - renewable generation, and
    ``order_id`` = average-tie rank of descending net load within (year, type).

    One pivot of the wide mapping replaces the long->wide->long->wide round trip; the peer
    lookup of generation becomes plain arithmetic on the wide row. Ranks are taken before an hour becomes three rows."""
    wide = _net_load(cluster_by_year(mapping), p)
    return _by_type(wide.withColumn("order_id", _net_rank(wide, p)), p)


def peak_hours(mapping: DataFrame, p: Params) -> DataFrame:
    """The rows of ``net_load_hourly`` among the top ``k`` net-load hours, without ranking the others.

    An average rank is never below the plain rank, so hours of plain rank over k can go first; ties share a
    plain rank, so they stay or go together and the average ranks of the others don't change. Spark limits each
    group by the plain rank before its rows are shuffled."""
    wide = _net_load(mapping, p)
    top = top_ranked(wide, "net_load", scen_keys(wide) + ["year"], p.top_k)
    return _by_type(top.withColumn("order_id", _net_rank(top, p)), p)


def normalized_profile(net: DataFrame, p: Params) -> DataFrame:
    """year, hour_of_day, solar, type in {Load, Net Load}, value: mean hour-of-day profile of
    load and net load normalised by the year's peak load (net load floored at 0); the last
    model year is left out."""
    g = net.where(F.col("type") == "generation")
    yr = scen_keys(g) + ["year"]
    t = hour_to_timestamp("hour")
    g = g.select(*yr, F.hour(t).alias("hour_of_day"),
                 ratio_to_group_max("load", "load", yr).alias("load_norm"),
                 ratio_to_group_max("net_load", "load", yr).alias("net_load_norm"),
                 ratio_to_group_max(F.col("`Solar`"), "load", yr).alias("solar"))
    keys = yr + ["hour_of_day"]
    agg = g.groupBy(*keys).agg(na_mean("load_norm").alias("Load"),
                               floor0(na_mean("net_load_norm")).alias("Net Load"),
                               na_mean("solar").alias("solar"))
    long = agg.unpivot(keys + ["solar"], ["Load", "Net Load"], "type", "value")
    return long.where(F.col("year") != p.last_year)


def peak_capacity_factors(net: DataFrame, p: Params) -> DataFrame:
    """year, type, load, net_load, solar, wind, offshore_wind: means over the hours ranked within
    the top ``k`` net-load hours (average ranks, so ties can keep more or fewer than k)."""
    top = net.where(F.col("order_id") <= p.top_k)
    keys = scen_keys(top) + ["year", "type"]
    return top.groupBy(*keys).agg(
        na_mean("load").alias("load"), na_mean("net_load").alias("net_load"),
        na_mean(F.col("`Solar`")).alias("solar"), na_mean(F.col("`Wind`")).alias("wind"),
        na_mean(F.col("`Offshore Wind`")).alias("offshore_wind"))


def hour_vs_segment(mapping: DataFrame, p: Params) -> DataFrame:
    """Per (year, hour) and aggregation in {hour, segment}: the availability factor of each
    renewable technology, the load (incl. hydrogen) and calendar parts of the hour."""
    techs = p.re_tech
    keys = scen_keys(mapping) + ["year", "hour", "segment", "hydrogen_load"]
    aggs = (_by_tech(techs, "af_h", "hour") + _by_tech(techs, "af_s", "segment")
            + [F.max(F.col("load_h") + F.col("hydrogen_load")).alias("load|hour"),
               F.max(F.col("load_s") + F.col("hydrogen_load")).alias("load|segment")])
    wide = cluster_by_year(mapping).groupBy(*keys).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("aggregation"),
                              *[F.col(f"`{t}|{a}`").alias(t) for t in techs],
                              F.col(f"`load|{a}`").alias("Load"))
                     for a in ("hour", "segment")])
    ts = wide.select(*keys, F.inline(rows))
    ts = ts.withColumn("time", hour_to_timestamp("hour"))
    return ts.withColumns(calendar_parts("time"))


def monthly_comparison(ts: DataFrame, p: Params) -> DataFrame:
    """year, month, aggregation, Wind, Solar, Load, month_name: monthly means (base year left
    out). The month label is a function of the month, so min() is its first value."""
    keys = scen_keys(ts) + ["year", "month", "aggregation"]
    return (ts.where(F.col("year") != p.base_year).groupBy(*keys)
            .agg(na_mean(F.col("`Wind`")).alias("Wind"), na_mean(F.col("`Solar`")).alias("Solar"),
                 na_mean("Load").alias("Load"), F.min("month_name").alias("month_name")))


def duration_curve(ts: DataFrame, p: Params, measure: str, floor: float | None = None) -> DataFrame:
    """``ts`` rows with ``order_hour`` = position in descending order of ``measure`` within
    (year, aggregation); base year left out; rows at or under ``floor`` removed *after*
    numbering (positions are not renumbered). Ties are broken by hour."""
    part = scen_keys(ts) + ["year", "aggregation"]
    df = ts.withColumn("order_hour", position_desc(F.col(f"`{measure}`"), part, ["hour", "segment"]))
    df = df.where(F.col("year") != p.base_year)
    if floor is not None:
        df = df.where(F.col(f"`{measure}`") > floor)
    return df


def duration_curve_load(ts: DataFrame, p: Params) -> DataFrame:
    return duration_curve(ts, p, "Load", p.load_floor)


def duration_curve_solar(ts: DataFrame, p: Params) -> DataFrame:
    return duration_curve(ts, p, "Solar")


def duration_curve_wind(ts: DataFrame, p: Params) -> DataFrame:
    return duration_curve(ts, p, "Wind")
