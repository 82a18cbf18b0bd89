"""DuckDB reference SQL for the driver-bound queries (the correctness gate).

Each query is written straight from the job definitions, over the pre-registered driver tables. CTE
fragments below bind the tables to symbol tables with the same rules as ``wattlens.sources.driver``,
so this gate compares engines and plans; the hand-computed marts in ``tests/`` hold the jobs to
the definitions. Measures are DECIMAL: sums are exact, and a mean is one division of the exact
sum by the count, so only means and shares of inexact numbers are rounded (``ROUNDED``).
"""

from __future__ import annotations

from . import lookups

DEFLATOR = "1.396161885"

#: Scenarios that the queries on stored symbols select.
STORED_SCENARIOS = ["BUILDING", "MACHINERY"]

# name -> (sql, dependencies)
_CTE: dict[str, tuple[str, tuple[str, ...]]] = {
    "cal_r": ("""SELECT n.n_name AS region FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey
               WHERE r.r_name = 'AMERICA'""", ()),
    "osc": ("""SELECT o.o_orderkey, c.c_mktsegment AS scenario FROM orders o
               JOIN customer c ON o.o_custkey = c.c_custkey""", ()),
    "li": ("""SELECT lower(p.p_type) || '-' || lower(p.p_brand) AS tech_class,
                     CAST(l.l_linenumber AS VARCHAR) AS vintage, n.n_name AS region,
                     CAST(year(l.l_shipdate) AS INTEGER) AS year,
                     's' || CAST(l.l_orderkey % 20 AS VARCHAR) AS segment,
                     lower(p.p_type) || regexp_replace(p.p_brand, '[^0-9]', '', 'g') AS report_type,
                     p.p_name, l.l_orderkey, l.l_partkey, CAST(l.l_quantity AS DECIMAL(12,2)) AS l_quantity,
                     CAST(l.l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice, l.l_returnflag, l.l_linestatus
              FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
                   JOIN supplier s ON l.l_suppkey = s.s_suppkey
                   JOIN nation n ON s.s_nationkey = n.n_nationkey""", ()),
    "lis": ("SELECT li.*, osc.scenario FROM li JOIN osc ON li.l_orderkey = osc.o_orderkey", ("li", "osc")),
    "xc": ("SELECT tech_class, vintage, region, year, l_quantity AS level FROM li", ("li",)),
    "gc": ("SELECT tech_class, region, year, l_quantity AS level FROM li WHERE l_returnflag = 'R'", ("li",)),
    "gr": ("SELECT tech_class, region, year, l_quantity AS level FROM li WHERE l_returnflag = 'A'", ("li",)),
    "cost": ("""SELECT tech_class, CASE WHEN year = 2001 THEN '2001+' ELSE CAST(year AS VARCHAR) END AS vintage,
                       region, year, l_extendedprice AS value FROM li""", ("li",)),
    "icg": ("""SELECT CASE WHEN l_linestatus = 'F' THEN 'li-ion' ELSE 'pumped' END AS tech_class, year, region,
                      l_extendedprice AS value FROM li WHERE l_returnflag = 'R'""", ("li",)),
    "irg": ("""SELECT CASE WHEN l_linestatus = 'F' THEN 'li-ion' ELSE 'pumped' END AS tech_class, year, region,
                      l_extendedprice AS value FROM li WHERE l_returnflag = 'A'""", ("li",)),
    "co2": ("""SELECT n.n_name AS region, CAST(year(o.o_orderdate) AS INTEGER) AS year,
                      CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DECIMAL(24,2)) * CAST(0.000000001 AS DECIMAL(9,9)) AS level
               FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
                    JOIN nation n ON c.c_nationkey = n.n_nationkey GROUP BY 1, 2""", ()),
    "rpt": ("""SELECT region, report_type AS type, year,
                      CASE WHEN l_linestatus = 'O' THEN 'TWh'
                           WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'gw' ELSE 'other' END AS unit,
                      l_quantity AS value FROM li""", ("li",)),
    "class_tax": ("""SELECT * FROM (VALUES ('economy', 'Gas-CC'), ('large', 'Nuclear'), ('medium', 'Wind'),
                      ('promo', 'Solar'), ('small', 'Offshore Wind')) t(prefix, tech)""", ()),
    "report_tax": ("""SELECT * FROM (VALUES ('large', 'Nuclear'), ('medium', 'Wind'), ('promo', 'Solar'),
                       ('small', 'Peak Load'), ('standard', 'Storage'), ('standard2', 'Hydrogen')) t(rkey, tech)""", ()),
}


def _closure(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        if n in out:
            return
        for d in _CTE[n][1]:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def mean(x: str) -> str:
    return f"CAST(sum({x}) AS DOUBLE) / count({x})"


def with_ctes(needed, body: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause holding the needed binding CTEs (in dependency order) plus query-local
    CTEs from ``extra`` (in the given order)."""
    parts = [f"{n} AS ({_CTE[n][0]})" for n in _closure(needed)]
    parts += [f"{n} AS ({sql})" for n, sql in (extra or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def tech_of(col: str = "tech_class") -> str:
    return f"(SELECT tech FROM class_tax WHERE prefix = split_part({col}, '-', 1))"


# -- capacity / investment ------------------------------------------------------------------------

_CAP_BY_REGION = {
    "gen": f"""SELECT tech, region, year, sum(level) AS capacity FROM
                 (SELECT {tech_of()} AS tech, region, year, level FROM xc) WHERE tech IS NOT NULL
               GROUP BY tech, region, year""",
    "cap": """SELECT * FROM gen
              UNION ALL SELECT 'Storage-capacity', region, year, sum(level) FROM gc GROUP BY region, year
              UNION ALL SELECT 'Storage-energy', region, year, sum(level) FROM gr GROUP BY region, year""",
}

_INV_BY_REGION = {
    "igen": f"""SELECT tech, region, year, sum(level) AS investment FROM
                 (SELECT {tech_of()} AS tech, region, year, level FROM xc) WHERE tech IS NOT NULL
               GROUP BY tech, region, year""",
    "inv": """SELECT * FROM igen
              UNION ALL SELECT 'Storage-capacity', region, year, sum(level) FROM gc WHERE year <> 1995 GROUP BY region, year
              UNION ALL SELECT 'Storage-energy', region, year, sum(level) FROM gr WHERE year <> 1995 GROUP BY region, year""",
}

_DEPS_CAP = ("xc", "gc", "gr", "class_tax", "cal_r")


def q_capacity_by_region() -> str:
    return with_ctes(_DEPS_CAP, "SELECT * FROM cap", _CAP_BY_REGION)


def q_ca_capacity() -> str:
    return with_ctes(_DEPS_CAP, """SELECT tech, year, sum(capacity) AS capacity FROM cap
                                   WHERE region IN (SELECT region FROM cal_r) GROUP BY tech, year""",
                     _CAP_BY_REGION)


def q_capacity_dense() -> str:
    return with_ctes(_DEPS_CAP, """
        SELECT t.tech, y.year, coalesce(c.capacity, 0) AS capacity
        FROM (SELECT DISTINCT tech FROM cap WHERE region IN (SELECT region FROM cal_r)) t
        CROSS JOIN (SELECT CAST(range AS INTEGER) AS year FROM range(1995, 2002)) y
        LEFT JOIN (SELECT tech, year, sum(capacity) AS capacity FROM cap
                   WHERE region IN (SELECT region FROM cal_r) GROUP BY tech, year) c
          ON c.tech = t.tech AND c.year = y.year""", _CAP_BY_REGION)


def q_investment_by_region() -> str:
    return with_ctes(_DEPS_CAP, "SELECT * FROM inv", _INV_BY_REGION)


def q_ca_investment() -> str:
    return with_ctes(_DEPS_CAP, """SELECT tech, year, sum(investment) AS investment FROM inv
                                   WHERE region IN (SELECT region FROM cal_r) GROUP BY tech, year""",
                     _INV_BY_REGION)


# -- costs ----------------------------------------------------------------------------------------

_VINTAGES = ["1996", "1997", "1998", "1999", "2000"]


def _cost_pivot(open_name: str) -> str:
    cols = ",\n".join(f"{mean(f"CASE WHEN vintage = '{v}' THEN value END")} * {DEFLATOR} AS \"{v}\"" for v in _VINTAGES)
    cols += f",\n{mean("CASE WHEN vintage = '2001+' THEN value END")} * {DEFLATOR} AS \"{open_name}\""
    return f"""SELECT tech, {cols} FROM
                (SELECT {tech_of()} AS tech, vintage, value FROM cost
                 WHERE region IN (SELECT region FROM cal_r)) WHERE tech IS NOT NULL AND vintage IS NOT NULL
               GROUP BY tech"""


def q_capcosts_wide() -> str:
    years = ["1996", "1997", "1998", "1999", "2000", "2001"]
    st_cols = ",\n".join(f"{mean(f'CASE WHEN year = {y} THEN value END')} * {DEFLATOR} AS \"{y}\"" for y in years + ["1995"])
    body = f"""
        SELECT tech, {', '.join(f'"{y}"' for y in years)}, CAST(NULL AS DOUBLE) AS "1995" FROM gen_wide
        UNION ALL
        SELECT tech, {st_cols} FROM (
            SELECT 'li-ion-power' AS tech, year, value FROM icg WHERE tech_class = 'li-ion'
            UNION ALL SELECT 'li-ion-energy', year, value FROM irg WHERE tech_class = 'li-ion') GROUP BY tech"""
    return with_ctes(("cost", "icg", "irg", "class_tax", "cal_r"), body, {"gen_wide": _cost_pivot("2001")})


def q_fom_costs_wide() -> str:
    return with_ctes(("cost", "class_tax", "cal_r"), _cost_pivot("2001+"))


def q_marginal_costs() -> str:
    return with_ctes(("cost", "class_tax", "cal_r"), f"""
        SELECT tech, vintage, {mean('value')} * {DEFLATOR} AS marginal_cost FROM
          (SELECT {tech_of()} AS tech, vintage, value FROM cost WHERE region IN (SELECT region FROM cal_r))
        WHERE tech IS NOT NULL AND vintage IS NOT NULL GROUP BY tech, vintage""")


def q_emissions_rollup() -> str:
    cols = ", ".join(f"max(CASE WHEN year = {y} THEN emissions END) AS \"{y}\"" for y in range(1995, 2002))
    return with_ctes(("co2", "cal_r"), f"""
        SELECT region, {cols} FROM (
            SELECT region, year, CAST(level * 1000 AS DOUBLE) AS emissions FROM co2
            UNION ALL
            SELECT 'California', year, CAST(sum(level * 1000) AS DOUBLE) FROM co2
            WHERE region IN (SELECT region FROM cal_r) GROUP BY year)
        WHERE region IS NOT NULL GROUP BY region""")


def _report(unit: str) -> str:
    return with_ctes(("rpt", "report_tax"), f"""
        SELECT tech, region, unit, year, sum(value) AS value FROM
          (SELECT (SELECT tech FROM report_tax WHERE rkey = regexp_replace(type, '[0-9]+', '', 'g')) AS tech,
                  region, unit, year, value FROM rpt WHERE unit = '{unit}')
        WHERE tech IS NOT NULL GROUP BY tech, region, unit, year""")


def q_generation_report() -> str:
    return _report("TWh")


def q_capacity_report() -> str:
    return _report("gw")



# -- helpers ----------------------------------------------------------------------------------------

TECH_ORDER = ["Storage", "Solar", "Wind", "Hydrogen", "Gas CCS", "Gas-CT", "Gas-CC",
              "Coal CCS", "Coal", "Bio CCS", "Bio", "Hydro", "Geothermal", "Nuclear"]
RE = ["Solar", "Wind", "Offshore Wind"]


def na_avg(x: str) -> str:
    return f"CASE WHEN count(*) = count({x}) THEN {mean(x)} END"


def na_sum(x: str) -> str:
    return f"CASE WHEN count(*) = count({x}) THEN sum({x}) END"


def order_of(x: str) -> str:
    whens = " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(TECH_ORDER))
    return f"CASE {x} {whens} END"


def ordered(x: str) -> str:
    listed = ", ".join(f"'{t}'" for t in TECH_ORDER)
    return f"CASE WHEN {x} IN ({listed}) THEN {x} END"


def ts_of(hour: str) -> str:
    return f"CASE WHEN {hour} BETWEEN 1 AND 8760 THEN TIMESTAMP '2026-01-01 00:00:00' + to_hours({hour} - 1) END"


def calendar(t: str) -> str:
    return (f"CAST(month({t}) AS INTEGER) AS month, CAST(day({t}) AS INTEGER) AS day, "
            f"CAST(hour({t}) AS INTEGER) AS hour_of_day, strftime({t}, '%b') AS month_name")


_CTE.update({
    "cells": ("""SELECT event_type, k, region, year, hour, value, 's' || CAST((hour * 37 + year) % 20 AS VARCHAR) AS segment FROM (
                   SELECT e.event_type, CAST(e.event_id % 5 AS INTEGER) AS k, n.n_name AS region,
                          CAST(1995 + e.user_id % 7 AS INTEGER) AS year,
                          CAST(date_diff('hour', TIMESTAMP '2024-01-01 00:00:00', e.ts) % 8760 + 1 AS INTEGER) AS hour,
                          CAST(sum(CAST(e.value AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS value
                   FROM events e JOIN nation n ON n.n_nationkey = e.user_id % 25 GROUP BY 1, 2, 3, 4, 5)""", ()),
    "hrep": ("""SELECT CAST(y.yr AS INTEGER) AS year, CAST(k.k AS INTEGER) AS hour,
                       's' || CAST((k.k * 37 + y.yr) % 20 AS VARCHAR) AS segment
                FROM (SELECT range AS yr FROM range(1995, 2002)) y CROSS JOIN (SELECT range AS k FROM range(1, 8761)) k""", ()),
    "reph": ("SELECT DISTINCT year, hour, segment FROM hrep", ("hrep",)),
    "techs": ("SELECT * FROM (VALUES ('Solar'), ('Wind'), ('Offshore Wind')) t(tech)", ()),
    "load_h": ("""SELECT year, hour, sum(value) AS load_h FROM cells WHERE region IN (SELECT region FROM cal_r)
                  GROUP BY year, hour""", ("cells", "cal_r")),
    "load_s": ("""SELECT year, segment, sum(value) AS load_s FROM cells WHERE region IN (SELECT region FROM cal_r)
                  GROUP BY year, segment""", ("cells", "cal_r")),
    "h2": ("""SELECT year, segment, sum(value) AS hydrogen_load FROM cells
              WHERE event_type = 'error' AND k < 4 AND region IN (SELECT region FROM cal_r)
              GROUP BY year, segment""", ("cells", "cal_r")),
    "vr": ("""SELECT CASE event_type WHEN 'click' THEN 'promo' WHEN 'view' THEN 'medium' WHEN 'signup' THEN 'small'
                       WHEN 'error' THEN 'standard' WHEN 'purchase' THEN 'large' END || '-all' AS tech_class,
                     CAST(k AS VARCHAR) AS vintage, region, year, hour, segment,
                     CAST(least(CAST(1 AS DECIMAL(18,5)), CAST(least(value, 500) * CAST(0.002 AS DECIMAL(3,3)) AS DECIMAL(18,5))) AS DECIMAL(6,5)) AS value
              FROM cells""", ("cells",)),
})


def _hourly_ctes(scen: bool) -> dict[str, tuple[str, tuple[str, ...]]]:
    """The hourly chain; with ``scen`` every table from capacity on is kept per scenario (names end in _s)."""
    x, src = ("_s", "lis") if scen else ("", "li")
    sk = "scenario, " if scen else ""

    def on(a: str, b: str, *keys: str) -> str:
        return " AND ".join(f"{a}.{k} = {b}.{k}" for k in (*(["scenario"] if scen else []), *keys))

    def af(slot: str) -> str:
        return f"""SELECT {sk}tech, year, {slot}, sum(capacity * value) AS generation, sum(capacity) AS capacity,
                          {mean('value')} AS af_base FROM (
                     SELECT {sk}{tech_of('v.tech_class')} AS tech, v.year, v.{slot}, c.level AS capacity, v.value
                     FROM vr v JOIN hcap{x} c ON v.tech_class = c.tech_class AND v.vintage = c.vintage
                          AND v.region = c.region AND v.year = c.year
                     WHERE v.region IN (SELECT region FROM cal_r))
                   WHERE tech IN ('Solar', 'Wind', 'Offshore Wind') GROUP BY {sk}tech, year, {slot}"""

    spine = (f"SELECT sy.scenario, r.* FROM reph r JOIN (SELECT DISTINCT scenario, year FROM hcap{x}) sy ON r.year = sy.year"
             if scen else "SELECT * FROM reph")
    seen = (f"SELECT DISTINCT scenario, tech FROM afh{x} INTERSECT SELECT DISTINCT scenario, tech FROM afs{x}" if scen
            else "SELECT tech FROM techs WHERE tech IN (SELECT tech FROM afh) AND tech IN (SELECT tech FROM afs)")
    return {
        f"hcap{x}": (f"""SELECT {sk}split_part(tech_class, '-', 1) || '-all' AS tech_class, vintage, region, year,
                                CAST(sum(l_quantity) AS DECIMAL(12,2)) AS level
                         FROM {src} GROUP BY ALL""", (src,)),
        f"afh{x}": (af("hour"), ("vr", f"hcap{x}", "cal_r", "class_tax")),
        f"afs{x}": (af("segment"), ("vr", f"hcap{x}", "cal_r", "class_tax")),
        f"hm{x}": (f"""SELECT {"r.scenario, " if scen else ""}t.tech, r.year, r.hour, coalesce(a.generation, 0) AS generation_h,
                         coalesce(a.capacity, 0) AS capacity,
                         coalesce(CAST(a.generation AS DOUBLE) / NULLIF(CAST(a.capacity AS DOUBLE), 0), a.af_base, 0.0) AS af_h, r.segment,
                         coalesce(s.generation, 0) AS generation_s,
                         coalesce(CAST(s.generation AS DOUBLE) / NULLIF(CAST(s.capacity AS DOUBLE), 0), s.af_base, 0.0) AS af_s,
                         coalesce(lh.load_h, 0) AS load_h, coalesce(ls.load_s, 0) AS load_s,
                         coalesce(h.hydrogen_load, 0) AS hydrogen_load
                  FROM ({spine}) r JOIN ({seen}) t ON {on('r', 't') or 'TRUE'}
                  LEFT JOIN afh{x} a ON {on('a', 'r', 'year', 'hour')} AND a.tech = t.tech
                  LEFT JOIN afs{x} s ON {on('s', 'r', 'year', 'segment')} AND s.tech = t.tech
                  LEFT JOIN load_h lh ON lh.year = r.year AND lh.hour = r.hour
                  LEFT JOIN load_s ls ON ls.year = r.year AND ls.segment = r.segment
                  LEFT JOIN h2 h ON h.year = r.year AND h.segment = r.segment""",
                   ("reph", "techs", f"afh{x}", f"afs{x}", "load_h", "load_s", "h2")),
        f"hw{x}": (f"""SELECT {sk}year, hour, segment, hydrogen_load, max(load_h + hydrogen_load) AS load,
                         """ + ",\n".join(f"max(CASE WHEN tech = '{t}' THEN {src_} END) AS \"{t}|{name}\""
                                          for name, src_ in (("generation", "generation_h"), ("capacity", "capacity"),
                                                             ("af", "af_h")) for t in RE) + f"""
                  FROM hm{x} GROUP BY {sk}year, hour, segment, hydrogen_load""", (f"hm{x}",)),
        f"nl{x}": (" UNION ALL ".join(
            f"""SELECT {sk}year, hour, segment, hydrogen_load, load, '{name}' AS type,
                       "Solar|{name}" AS "Solar", "Wind|{name}" AS "Wind", "Offshore Wind|{name}" AS "Offshore Wind",
                       load - "Solar|generation" - "Wind|generation" - "Offshore Wind|generation" AS net_load FROM hw{x}"""
            for name in ("generation", "capacity", "af")), (f"hw{x}",)),
        f"nlr{x}": (f"""SELECT *, CASE WHEN net_load IS NULL THEN
                              CAST(count(net_load) OVER (PARTITION BY {sk}year, type)
                                   + row_number() OVER (PARTITION BY {sk}year, type, net_load IS NULL ORDER BY hour, segment) AS DOUBLE)
                            ELSE rank() OVER (PARTITION BY {sk}year, type ORDER BY net_load DESC NULLS LAST)
                                 + (count(*) OVER (PARTITION BY {sk}year, type, net_load) - 1) / 2.0 END AS order_id FROM nl{x}""", (f"nl{x}",)),
    }


_CTE.update(_hourly_ctes(False) | _hourly_ctes(True))
_CTE.update({
    "sw": ("""SELECT year, hour, segment, hydrogen_load,
                     """ + ",\n".join(f"max(CASE WHEN tech = '{t}' THEN {src} END) AS \"{t}|{a}\""
                                      for a, src in (("hour", "af_h"), ("segment", "af_s")) for t in RE) + """,
                     max(load_h + hydrogen_load) AS "load|hour", max(load_s + hydrogen_load) AS "load|segment"
              FROM hm GROUP BY year, hour, segment, hydrogen_load""", ("hm",)),
    "ts0": (" UNION ALL ".join(
        f"""SELECT year, hour, segment, hydrogen_load, '{a}' AS aggregation, "Solar|{a}" AS "Solar",
                   "Wind|{a}" AS "Wind", "Offshore Wind|{a}" AS "Offshore Wind", "load|{a}" AS "Load" FROM sw"""
        for a in ("hour", "segment")), ("sw",)),
    "tsc": (f"SELECT *, {calendar('time')} FROM (SELECT *, {ts_of('hour')} AS time FROM ts0)", ("ts0",)),
})


def q_hydrogen_load() -> str:
    return with_ctes(("h2",), "SELECT * FROM h2")


_LOADS = """SELECT r.year, r.hour, r.segment, coalesce(lh.load_h, 0) AS load_hour,
                   coalesce(ls.load_s, 0) AS load_segment, coalesce(h.hydrogen_load, 0) AS hydrogen_load
            FROM reph r LEFT JOIN load_h lh ON lh.year = r.year AND lh.hour = r.hour
            LEFT JOIN load_s ls ON ls.year = r.year AND ls.segment = r.segment
            LEFT JOIN h2 h ON h.year = r.year AND h.segment = r.segment"""


def q_ca_loads() -> str:
    return with_ctes(("reph", "load_h", "load_s", "h2"), _LOADS)


def q_loads_filtered() -> str:
    return with_ctes(("reph", "load_h", "load_s", "h2"), f"SELECT * FROM ({_LOADS}) WHERE year <> 1995")


def _af_dense(slot: str, cte: str) -> str:
    sfx = "h" if slot == "hour" else "s"
    cap = ", coalesce(a.capacity, 0) AS capacity" if slot == "hour" else ""
    return with_ctes((cte, "hrep", "techs"), f"""
        SELECT t.tech, r.year, r.{slot}, coalesce(a.generation, 0) AS generation_{sfx}{cap},
               coalesce(CAST(a.generation AS DOUBLE) / NULLIF(CAST(a.capacity AS DOUBLE), 0), a.af_base) AS af_{sfx}
        FROM (SELECT DISTINCT year, {slot} FROM hrep) r
        CROSS JOIN (SELECT * FROM techs WHERE tech IN (SELECT tech FROM {cte})) t
        LEFT JOIN {cte} a ON a.tech = t.tech AND a.year = r.year AND a.{slot} = r.{slot}""")


def q_af_hour() -> str:
    return _af_dense("hour", "afh")


def q_af_segment() -> str:
    return _af_dense("segment", "afs")


def q_ca_hourly_mapping() -> str:
    return with_ctes(("hm",), "SELECT * FROM hm")


def q_hourly_long() -> str:
    parts = []
    for src, name in (("generation_h", "generation_hour"), ("generation_s", "generation_segment"),
                      ("af_h", "af_hour"), ("af_s", "af_segment"), ("load_h + hydrogen_load", "load_hour"),
                      ("load_s + hydrogen_load", "load_segment"), ("capacity", "capacity_hour"),
                      ("capacity", "capacity_segment")):
        typ, agg = name.split("_", 1)
        parts.append(f"SELECT tech, year, hour, segment, hydrogen_load, '{typ}' AS type, '{agg}' AS aggregation, "
                     f"{src} AS value FROM hm")
    return with_ctes(("hm",), "\nUNION ALL ".join(parts))


def q_net_load_hourly() -> str:
    return with_ctes(("nlr",), "SELECT * FROM nlr")


def _normalized_profile(scen: bool = False) -> str:
    x, sk = ("_s", "scenario, ") if scen else ("", "")
    w = f"(PARTITION BY {sk}year)"
    mx = f"CAST(CASE WHEN count(*) OVER {w} = count(load) OVER {w} THEN max(load) OVER {w} END AS DOUBLE)"
    return with_ctes((f"nlr{x}",), f"""
        SELECT {sk}year, hour_of_day, solar, 'Load' AS type, "Load" AS value FROM agg WHERE year <> 2001
        UNION ALL
        SELECT {sk}year, hour_of_day, solar, 'Net Load', "Net Load" FROM agg WHERE year <> 2001""", {
        "g": f"""SELECT {sk}year, CAST(hour({ts_of('hour')}) AS INTEGER) AS hour_of_day,
                        CAST(load AS DOUBLE) / NULLIF({mx}, 0) AS load_norm, CAST(net_load AS DOUBLE) / NULLIF({mx}, 0) AS net_load_norm,
                        "Solar" / NULLIF({mx}, 0) AS solar
                 FROM nlr{x} WHERE type = 'generation'""",
        "agg": f"""SELECT {sk}year, hour_of_day, {na_avg('load_norm')} AS "Load",
                          CASE WHEN {na_avg('net_load_norm')} IS NOT NULL THEN greatest(0.0, {na_avg('net_load_norm')}) END AS "Net Load",
                          {na_avg('solar')} AS solar
                   FROM g GROUP BY {sk}year, hour_of_day"""})


def q_normalized_profile() -> str:
    return _normalized_profile()


def q_normalized_profile_scenarios() -> str:
    return _normalized_profile(True)


def _peak_capacity_factors(scen: bool = False) -> str:
    x, sk = ("_s", "scenario, ") if scen else ("", "")
    return with_ctes((f"nlr{x}",), f"""
        SELECT {sk}year, type, {na_avg('load')} AS load, {na_avg('net_load')} AS net_load,
               {na_avg('"Solar"')} AS solar, {na_avg('"Wind"')} AS wind, {na_avg('"Offshore Wind"')} AS offshore_wind
        FROM nlr{x} WHERE order_id <= 25 GROUP BY {sk}year, type""")


def q_peak_capacity_factors() -> str:
    return _peak_capacity_factors()


def q_peak_capacity_factors_scenarios() -> str:
    return _peak_capacity_factors(True)


def q_hour_vs_segment() -> str:
    return with_ctes(("tsc",), "SELECT * FROM tsc")


def q_monthly_comparison() -> str:
    return with_ctes(("tsc",), f"""
        SELECT year, month, aggregation, {na_avg('"Wind"')} AS "Wind", {na_avg('"Solar"')} AS "Solar",
               {na_avg('"Load"')} AS "Load", min(month_name) AS month_name
        FROM tsc WHERE year <> 1995 GROUP BY year, month, aggregation""")


def _duration(measure: str, floor: str = "") -> str:
    cond = f' AND "{measure}" > {floor}' if floor else ""
    return with_ctes(("tsc",), f"""
        SELECT * FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY year, aggregation
                     ORDER BY "{measure}" DESC NULLS LAST, hour ASC NULLS LAST, segment ASC NULLS LAST) AS INTEGER) AS order_hour
          FROM tsc) WHERE year <> 1995{cond}""")


def q_duration_curve_load() -> str:
    return _duration("Load", "5")


def q_duration_curve_solar() -> str:
    return _duration("Solar")


def q_duration_curve_wind() -> str:
    return _duration("Wind")


# -- dispatch and trade ---------------------------------------------------------------------------

def _dispatch_cte(scen: bool) -> str:
    src, sk, dk = ("lis", "scenario, ", "d.scenario, ") if scen else ("li", "", "")
    return f"""SELECT {dk}d.tech, d.year, d.segment, d.level, h.hour FROM (
                 SELECT {sk}tech, year, segment, sum(level) AS level FROM (
                   SELECT {sk}CASE WHEN l_returnflag <> 'R' THEN {tech_of()} WHEN l_linestatus = 'O' THEN 'Storage-charge'
                                   WHEN l_linestatus = 'F' THEN 'Storage-discharge' END AS tech, year, segment, l_quantity AS level
                   FROM {src} WHERE l_returnflag IN ('N', 'A', 'R') AND region IN (SELECT region FROM cal_r))
                 WHERE tech IS NOT NULL GROUP BY {sk}tech, year, segment) d
               JOIN reph h ON d.year = h.year AND d.segment = h.segment"""


def _trade_cte(scen: bool) -> str:
    sk, ek, tk = ("scenario, ", "e.scenario, ", "t.scenario, ") if scen else ("", "", "")
    return f"""SELECT {tk}t.year, t.segment, t.region_exp, t.region_imp, t.trade_gw, h.hour FROM (
                 SELECT {sk}year, segment, region_exp, region_imp, sum(level) AS trade_gw FROM (
                   SELECT {ek}e.year, e.segment, ae.value AS region_exp, ai.value AS region_imp, e.level FROM trade e
                   LEFT JOIN area ae ON e.region_exp = ae.key LEFT JOIN area ai ON e.region_imp = ai.key)
                 WHERE region_exp IS NOT NULL AND region_imp IS NOT NULL
                 GROUP BY {sk}year, segment, region_exp, region_imp) t
               JOIN reph h ON t.year = h.year AND t.segment = h.segment"""


_CTE.update({
    "disp": (_dispatch_cte(False), ("li", "cal_r", "class_tax", "reph")),
    "disp_s": (_dispatch_cte(True), ("lis", "cal_r", "class_tax", "reph")),
    "dclean": (f"""SELECT {ordered('tech')} AS tech, year, segment, level, hour, time, {calendar('time')},
                          {order_of('tech')} AS tech_order
                   FROM (SELECT CASE WHEN tech = 'Storage-discharge' THEN 'Storage' ELSE tech END AS tech,
                                year, segment, level, hour, {ts_of('hour')} AS time FROM disp
                         WHERE year <> 1995 AND (tech IS NULL OR tech NOT IN ('Nuclear')) AND tech <> 'Storage-charge')""",
               ("disp",)),
    "trade": ("""SELECT 's' || CAST(l.l_orderkey % 20 AS VARCHAR) AS segment, sn.n_name AS region_exp,
                        cn.n_name AS region_imp, CAST(year(o.o_orderdate) AS INTEGER) AS year,
                        CAST(l.l_quantity AS DECIMAL(12,2)) AS level, c.c_mktsegment AS scenario
                 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                      JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation cn ON c.c_nationkey = cn.n_nationkey
                      JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN nation sn ON s.s_nationkey = sn.n_nationkey""", ()),
    "area": ("""SELECT n.n_name AS key, CASE WHEN r.r_name = 'AMERICA' THEN 'ca'
                       WHEN r.r_name IN ('ASIA', 'EUROPE') THEN 'rest' END AS value
                FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""", ()),
    "trh": (_trade_cte(False), ("trade", "area", "reph")),
    "trh_s": (_trade_cte(True), ("trade", "area", "reph")),
})


def q_dispatch_by_segment() -> str:
    return with_ctes(("disp",), "SELECT * FROM disp")


def q_dispatch_clean() -> str:
    return with_ctes(("dclean",), "SELECT * FROM dclean")


def q_storage_charge() -> str:
    return with_ctes(("disp",), """SELECT year, segment, hour, level AS storage_charge FROM disp
        WHERE year <> 1995 AND (tech IS NULL OR tech NOT IN ('Nuclear')) AND tech = 'Storage-charge'""")


def q_dispatch_hour_profile() -> str:
    return with_ctes(("dclean",), f"""SELECT tech, year, hour_of_day, {na_avg('level')} AS level
        FROM dclean GROUP BY tech, year, hour_of_day""")


def q_dispatch_window() -> str:
    return with_ctes(("dclean",), "SELECT * FROM dclean WHERE year = 1996 AND hour < 121")


def _deciles(scen: bool = False) -> str:
    x, sk = ("_s", "scenario, ") if scen else ("", "")
    w = f"PARTITION BY {sk}year, hour"
    return with_ctes((f"disp{x}",), f"""
        SELECT {sk}year, tech, gen_ntile, generation,
               generation / NULLIF(CASE WHEN count(*) OVER w = count(generation) OVER w
                                        THEN sum(generation) OVER w END, 0) AS pct_gen
        FROM a WINDOW w AS (PARTITION BY {sk}year, gen_ntile)""", {
        "d": f"SELECT DISTINCT {sk}tech, year, segment, level, hour FROM disp{x}",
        "g": f"""SELECT {sk}{ordered('t2')} AS tech, year, segment, level, hour FROM (
                   SELECT {sk}CASE WHEN tech = 'Storage-discharge' THEN 'Storage' ELSE tech END AS t2, year, segment, level, hour
                   FROM d WHERE (tech IS NULL OR tech NOT IN ('Nuclear')) AND tech <> 'Storage-charge')""",
        "t": f"""SELECT *, CASE WHEN count(*) OVER ({w}) = count(level) OVER ({w}) THEN sum(level) OVER ({w}) END AS total_gen
                 FROM g""",
        "n": f"""SELECT *, CASE WHEN total_gen IS NOT NULL THEN
                       ntile(10) OVER (PARTITION BY {sk}year, tech, total_gen IS NULL ORDER BY total_gen, hour, segment) END AS gen_ntile
                FROM t""",
        "a": f"""SELECT {sk}year, tech, CAST(gen_ntile AS INTEGER) AS gen_ntile, {na_avg('level')} AS generation
                 FROM n GROUP BY {sk}year, tech, gen_ntile"""})


def q_dispatch_deciles() -> str:
    return _deciles()


def q_dispatch_deciles_scenarios() -> str:
    return _deciles(True)


def q_trade_by_segment() -> str:
    return with_ctes(("trh",), "SELECT * FROM trh")


def _trade_net(scen: bool = False) -> str:
    x, sk = ("_s", "scenario, ") if scen else ("", "")
    imports = "CASE WHEN region_imp = 'ca' AND region_exp <> 'ca' THEN trade_gw ELSE 0 END"
    exports = "CASE WHEN region_exp = 'ca' AND region_imp <> 'ca' THEN trade_gw ELSE 0 END"
    return with_ctes((f"trh{x}",), f"""
        SELECT {sk}year, hour, imports, exports, imports - exports AS net_imports FROM (
          SELECT {sk}year, hour, {na_sum(imports)} AS imports, {na_sum(exports)} AS exports
          FROM trh{x} WHERE year <> 1995 GROUP BY {sk}year, hour)""")


def q_trade_net() -> str:
    return _trade_net()


def q_trade_net_scenarios() -> str:
    return _trade_net(True)


# -- figure tables --------------------------------------------------------------------------------


def _report_cte(unit: str, scen: bool = False) -> str:
    src = "lis" if scen else "li"
    sk = "scenario, " if scen else ""
    return f"""SELECT {sk}tech, region, unit, year, sum(value) AS value FROM (
                 SELECT {sk}(SELECT tech FROM report_tax WHERE rkey = regexp_replace(report_type, '[0-9]+', '', 'g')) AS tech,
                        region, CASE WHEN l_linestatus = 'O' THEN 'TWh'
                                     WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'gw' ELSE 'other' END AS unit,
                        year, l_quantity AS value FROM {src})
               WHERE unit = '{unit}' AND tech IS NOT NULL GROUP BY {sk}tech, region, unit, year"""


def q_fig_generation() -> str:
    return with_ctes(("li", "report_tax"), f"""
        SELECT {ordered('tech')} AS tech, region, unit, year, value, {order_of('tech')} AS tech_order FROM r
        WHERE region = 'NATION_1' AND (tech IS NULL OR tech NOT IN ('Storage', 'Peak Load'))""",
                     {"r": _report_cte("TWh")})


def q_fig_capacity() -> str:
    return with_ctes(("li", "report_tax"), f"""
        SELECT {ordered('tech')} AS tech, region, unit, year, value, {order_of('tech')} AS tech_order FROM r
        WHERE region = 'NATION_1' AND (tech IS NULL OR tech NOT IN ('Peak Load'))""",
                     {"r": _report_cte("gw")})


def q_fig_peak_load() -> str:
    return with_ctes(("li", "report_tax"), "SELECT * FROM r WHERE region = 'NATION_1' AND tech = 'Peak Load'",
                     {"r": _report_cte("gw")})


def _investment_ctes(scen: bool) -> dict[str, str]:
    src = "lis" if scen else "li"
    sk = "scenario, " if scen else ""
    return {
        "inv": f"""SELECT {sk}tech, region, year, sum(level) AS investment FROM
                     (SELECT {sk}{tech_of()} AS tech, region, year, l_quantity AS level FROM {src})
                   WHERE tech IS NOT NULL GROUP BY {sk}tech, region, year
                   UNION ALL SELECT {sk}'Storage-capacity', region, year, sum(l_quantity) FROM {src}
                   WHERE l_returnflag = 'R' AND year <> 1995 GROUP BY {sk}region, year
                   UNION ALL SELECT {sk}'Storage-energy', region, year, sum(l_quantity) FROM {src}
                   WHERE l_returnflag = 'A' AND year <> 1995 GROUP BY {sk}region, year""",
        "ci": f"""SELECT {sk}tech, year, sum(investment) AS investment FROM inv
                  WHERE region IN (SELECT region FROM cal_r) GROUP BY {sk}tech, year""",
        "fi": f"""SELECT {sk}year, tech, tech_order, {na_sum('investment')} AS investment FROM (
                    SELECT {sk}year, {ordered('t2')} AS tech, {order_of('t2')} AS tech_order, investment FROM (
                      SELECT {sk}year, CASE WHEN tech IN ('Storage-capacity') THEN 'Storage' ELSE tech END AS t2, investment
                      FROM ci WHERE year <> 1995))
                  WHERE tech IS NOT NULL GROUP BY {sk}year, tech, tech_order""",
    }


def q_fig_investment() -> str:
    return with_ctes(("li", "class_tax", "cal_r"), "SELECT * FROM fi", _investment_ctes(False))


def q_fig_investment_scenarios() -> str:
    return with_ctes(("lis", "class_tax", "cal_r"), "SELECT * FROM fi", _investment_ctes(True))


def q_fig_cumulative_investment() -> str:
    return with_ctes(("lis", "class_tax", "cal_r"), f"""
        SELECT scenario, tech, tech_order, {na_sum('investment')} AS investment FROM fi
        WHERE year <= 1999 GROUP BY scenario, tech, tech_order""", _investment_ctes(True))


def q_fig_capacity_scenarios() -> str:
    return with_ctes(("lis", "report_tax"), f"""
        SELECT {ordered('tech')} AS tech, region, unit, year, value, scenario, {order_of('tech')} AS tech_order FROM r
        WHERE region = 'NATION_1' AND (tech IS NULL OR tech NOT IN ('Peak Load'))
          AND year IN (1997, 1999, 2001)""", {"r": _report_cte("gw", scen=True)})


def q_fig_peak_load_scenarios() -> str:
    return with_ctes(("lis", "report_tax"), f"""
        SELECT * FROM r WHERE region = 'NATION_1' AND tech = 'Peak Load'
          AND year IN (1997, 1999, 2001)""", {"r": _report_cte("gw", scen=True)})


def q_list_scenarios() -> str:
    return "SELECT DISTINCT c_mktsegment AS scenario FROM customer"


def q_map_long_name() -> str:
    return with_ctes(("li",), """
        SELECT tech, year, sum(value) AS value FROM (
          SELECT CASE string_split(p_name, ' ')[-1]
                   WHEN 'anvil' THEN 'Hydro' WHEN 'bolt' THEN 'Bio' WHEN 'gear' THEN 'Coal'
                   WHEN 'gizmo' THEN 'Geothermal' WHEN 'plate' THEN 'Hydrogen' WHEN 'ring' THEN 'Gas-CT'
                   WHEN 'rod' THEN 'Gas-CC' WHEN 'widget' THEN 'DROP' END AS tech,
                 year, l_quantity AS value FROM li)
        WHERE tech IS NOT NULL AND tech <> 'DROP' GROUP BY tech, year""")


def _values(mapping: dict[str, str]) -> str:
    return ", ".join(f"({i}, '{k}', '{v}')" for i, (k, v) in enumerate(mapping.items()))


def q_class_code_capacity() -> str:
    return with_ctes(("li", "cal_r"), f"""
        SELECT tech, year, sum(level) AS capacity FROM (
          SELECT t.tech, year, l_quantity AS level FROM li JOIN codes t ON l_partkey % {len(lookups.TECH_SET)} = t.i WHERE region IN (SELECT region FROM cal_r)
          UNION ALL SELECT 'Storage-capacity', year, l_quantity FROM li WHERE l_returnflag = 'R' AND region IN (SELECT region FROM cal_r)
          UNION ALL SELECT 'Storage-energy', year, l_quantity FROM li WHERE l_returnflag = 'A' AND region IN (SELECT region FROM cal_r))
        GROUP BY tech, year""", {"codes": f"SELECT * FROM (VALUES {_values(lookups.TECH_SET)}) t(i, code, tech)"})


def q_report_code_generation() -> str:
    return with_ctes(("li",), f"""
        SELECT n.tech, region, 'TWh' AS unit, year, sum(l_quantity) AS value
        FROM li JOIN codes c ON l_partkey % {len(lookups.TYPE_TO_TECH)} = c.i JOIN codes n ON n.code = regexp_replace(c.code, '[0-9]+', '', 'g')
        WHERE l_linestatus = 'O' GROUP BY n.tech, region, year""",
                     {"codes": f"SELECT * FROM (VALUES {_values(lookups.TYPE_TO_TECH)}) t(i, code, tech)"})


def q_long_label_value() -> str:
    return with_ctes(("li",), f"""
        SELECT tech, year, sum(l_quantity) AS value FROM li JOIN codes c ON l_partkey % {len(lookups.TECH_SUB)} = c.i
        WHERE tech <> 'DROP' GROUP BY tech, year""", {"codes": f"SELECT * FROM (VALUES {_values(lookups.TECH_SUB)}) t(i, code, tech)"})


def _of_stored() -> str:
    return "scenario IN (" + ", ".join(f"'{x}'" for x in STORED_SCENARIOS) + ")"


def q_scan_symbol() -> str:
    return with_ctes(("lis",), f"SELECT scenario, tech_class, vintage, region, year, l_quantity AS level FROM lis WHERE {_of_stored()}")


def q_stored_ca_capacity() -> str:
    return with_ctes(("lis", "class_tax", "cal_r"), """
        SELECT scenario, tech, year, sum(level) AS capacity FROM rows WHERE tech IS NOT NULL GROUP BY scenario, tech, year""", {
        "own": f"SELECT * FROM lis WHERE {_of_stored()} AND region IN (SELECT region FROM cal_r)",
        "rows": f"""SELECT scenario, {tech_of()} AS tech, year, l_quantity AS level FROM own
                    UNION ALL SELECT scenario, 'Storage-capacity', year, l_quantity FROM own WHERE l_returnflag = 'R'
                    UNION ALL SELECT scenario, 'Storage-energy', year, l_quantity FROM own WHERE l_returnflag = 'A'"""})


def q_stored_dispatch_without_optional() -> str:
    return with_ctes(("lis", "class_tax", "cal_r", "reph"), """
        SELECT seg.scenario, seg.tech, seg.year, seg.segment, seg.level, reph.hour
        FROM (SELECT scenario, tech, year, segment, sum(level) AS level FROM rows WHERE tech IS NOT NULL GROUP BY scenario, tech, year, segment) seg
        JOIN reph ON seg.year = reph.year AND seg.segment = reph.segment""", {
        "own": f"SELECT * FROM lis WHERE {_of_stored()} AND region IN (SELECT region FROM cal_r)",
        "rows": f"""SELECT scenario, {tech_of()} AS tech, year, segment, l_quantity AS level FROM own WHERE l_returnflag = 'N'
                    UNION ALL SELECT scenario, CASE l_linestatus WHEN 'O' THEN 'Storage-charge' ELSE 'Storage-discharge' END, year, segment, l_quantity
                    FROM own WHERE l_returnflag = 'R'"""})


def q_stored_list_scenarios() -> str:
    return with_ctes(("lis",), "SELECT DISTINCT scenario FROM lis")


def q_mart_csv_fom_costs() -> str:
    cols = ", ".join(f"{mean(f"CASE WHEN vintage = '{v}' THEN value END")} * {DEFLATOR} AS \"{v}\"" for v in [*_VINTAGES, "2001+"])
    return with_ctes(("lis", "class_tax", "cal_r"), f"""
        SELECT scenario, tech, {cols} FROM (
          SELECT scenario, {tech_of()} AS tech, CASE WHEN year = 2001 THEN '2001+' ELSE CAST(year AS VARCHAR) END AS vintage, l_extendedprice AS value
          FROM lis WHERE region IN (SELECT region FROM cal_r))
        WHERE tech IS NOT NULL AND vintage <> '1995' GROUP BY scenario, tech""")


def q_mart_csv_capcosts() -> str:
    cols = ", ".join(f"{mean(f'CASE WHEN year = {y} THEN value END')} * {DEFLATOR} AS \"{y}\"" for y in range(1995, 2002))
    return with_ctes(("lis", "class_tax", "cal_r"), f"""
        SELECT scenario, tech, {cols} FROM (
          SELECT scenario, {tech_of()} AS tech, year, l_extendedprice AS value FROM lis WHERE year <> 1995 AND region IN (SELECT region FROM cal_r)
          UNION ALL SELECT scenario, 'li-ion-power', year, l_extendedprice FROM lis WHERE l_returnflag = 'R' AND l_linestatus = 'F'
          UNION ALL SELECT scenario, 'li-ion-energy', year, l_extendedprice FROM lis WHERE l_returnflag = 'A' AND l_linestatus = 'F')
        WHERE tech IS NOT NULL GROUP BY scenario, tech""")


def q_mart_parquet_capacity() -> str:
    return with_ctes(("lis", "class_tax"), f"""
        SELECT scenario, tech, region, year, sum(level) AS capacity FROM (
          SELECT scenario, {tech_of()} AS tech, region, year, l_quantity AS level FROM lis
          UNION ALL SELECT scenario, 'Storage-capacity', region, year, l_quantity FROM lis WHERE l_returnflag = 'R'
          UNION ALL SELECT scenario, 'Storage-energy', region, year, l_quantity FROM lis WHERE l_returnflag = 'A')
        WHERE tech IS NOT NULL GROUP BY scenario, tech, region, year""")


QUERIES = {
    "scan_symbol": q_scan_symbol,
    "stored_ca_capacity": q_stored_ca_capacity,
    "stored_dispatch_without_optional": q_stored_dispatch_without_optional,
    "stored_list_scenarios": q_stored_list_scenarios,
    "scan_multi_file": q_ca_loads,
    "mart_csv_fom_costs": q_mart_csv_fom_costs,
    "mart_csv_capcosts": q_mart_csv_capcosts,
    "mart_parquet_capacity": q_mart_parquet_capacity,
    "statistics_csv_peak_factors": q_peak_capacity_factors,
    "class_code_capacity": q_class_code_capacity,
    "report_code_generation": q_report_code_generation,
    "long_label_value": q_long_label_value,
    "normalized_profile_scenarios": q_normalized_profile_scenarios,
    "peak_capacity_factors_scenarios": q_peak_capacity_factors_scenarios,
    "dispatch_deciles_scenarios": q_dispatch_deciles_scenarios,
    "trade_net_scenarios": q_trade_net_scenarios,
    "ca_capacity": q_ca_capacity,
    "capacity_by_region": q_capacity_by_region,
    "capacity_dense": q_capacity_dense,
    "investment_by_region": q_investment_by_region,
    "ca_investment": q_ca_investment,
    "capcosts_wide": q_capcosts_wide,
    "fom_costs_wide": q_fom_costs_wide,
    "marginal_costs": q_marginal_costs,
    "emissions_rollup": q_emissions_rollup,
    "generation_report": q_generation_report,
    "capacity_report": q_capacity_report,
    "hydrogen_load": q_hydrogen_load,
    "ca_loads": q_ca_loads,
    "loads_filtered": q_loads_filtered,
    "af_hour": q_af_hour,
    "af_segment": q_af_segment,
    "ca_hourly_mapping": q_ca_hourly_mapping,
    "hourly_long": q_hourly_long,
    "net_load_hourly": q_net_load_hourly,
    "normalized_profile": q_normalized_profile,
    "peak_capacity_factors": q_peak_capacity_factors,
    "hour_vs_segment": q_hour_vs_segment,
    "monthly_comparison": q_monthly_comparison,
    "duration_curve_load": q_duration_curve_load,
    "duration_curve_solar": q_duration_curve_solar,
    "duration_curve_wind": q_duration_curve_wind,
    "dispatch_by_segment": q_dispatch_by_segment,
    "dispatch_clean": q_dispatch_clean,
    "storage_charge": q_storage_charge,
    "dispatch_hour_profile": q_dispatch_hour_profile,
    "dispatch_window": q_dispatch_window,
    "dispatch_deciles": q_dispatch_deciles,
    "trade_by_segment": q_trade_by_segment,
    "trade_net": q_trade_net,
    "fig_generation": q_fig_generation,
    "fig_capacity": q_fig_capacity,
    "fig_peak_load": q_fig_peak_load,
    "fig_investment": q_fig_investment,
    "fig_investment_scenarios": q_fig_investment_scenarios,
    "fig_cumulative_investment": q_fig_cumulative_investment,
    "fig_capacity_scenarios": q_fig_capacity_scenarios,
    "fig_peak_load_scenarios": q_fig_peak_load_scenarios,
    "list_scenarios": q_list_scenarios,
    "map_long_name": q_map_long_name,
}

# DOUBLE result columns per query (exact DECIMAL sums become DOUBLE; checked by tools/check_oracle.py).
DOUBLE_COLUMNS: dict[str, list[str]] = {
    "ca_capacity": ["capacity"],
    "capacity_by_region": ["capacity"],
    "capacity_dense": ["capacity"],
    "investment_by_region": ["investment"],
    "ca_investment": ["investment"],
    "capcosts_wide": ["1996", "1997", "1998", "1999", "2000", "2001", "1995"],
    "fom_costs_wide": ["1996", "1997", "1998", "1999", "2000", "2001+"],
    "marginal_costs": ["marginal_cost"],
    "emissions_rollup": ["1995", "1996", "1997", "1998", "1999", "2000", "2001"],
    "generation_report": ["value"],
    "capacity_report": ["value"],
    "ca_loads": ["load_hour", "load_segment", "hydrogen_load"],
    "hydrogen_load": ["hydrogen_load"],
    "loads_filtered": ["load_hour", "load_segment", "hydrogen_load"],
    "af_hour": ["generation_h", "capacity", "af_h"],
    "af_segment": ["generation_s", "af_s"],
    "ca_hourly_mapping": ["generation_h", "capacity", "af_h", "generation_s", "af_s", "load_h", "load_s", "hydrogen_load"],
    "hourly_long": ["hydrogen_load", "value"],
    "net_load_hourly": ["hydrogen_load", "load", "Solar", "Wind", "Offshore Wind", "net_load", "order_id"],
    "normalized_profile": ["solar", "value"],
    "peak_capacity_factors": ["load", "net_load", "solar", "wind", "offshore_wind"],
    "hour_vs_segment": ["hydrogen_load", "Solar", "Wind", "Offshore Wind", "Load"],
    "monthly_comparison": ["Wind", "Solar", "Load"],
    "duration_curve_load": ["hydrogen_load", "Solar", "Wind", "Offshore Wind", "Load"],
    "duration_curve_solar": ["hydrogen_load", "Solar", "Wind", "Offshore Wind", "Load"],
    "duration_curve_wind": ["hydrogen_load", "Solar", "Wind", "Offshore Wind", "Load"],
    "dispatch_by_segment": ["level"],
    "dispatch_clean": ["level"],
    "storage_charge": ["storage_charge"],
    "dispatch_hour_profile": ["level"],
    "dispatch_window": ["level"],
    "dispatch_deciles": ["generation", "pct_gen"],
    "trade_by_segment": ["trade_gw"],
    "trade_net": ["imports", "exports", "net_imports"],
    "fig_generation": ["value"],
    "fig_capacity": ["value"],
    "fig_peak_load": ["value"],
    "fig_investment": ["investment"],
    "fig_investment_scenarios": ["investment"],
    "fig_cumulative_investment": ["investment"],
    "fig_capacity_scenarios": ["value"],
    "fig_peak_load_scenarios": ["value"],
    "map_long_name": ["value"],
    "class_code_capacity": ["capacity"],
    "report_code_generation": ["value"],
    "long_label_value": ["value"],
    "normalized_profile_scenarios": ["solar", "value"],
    "peak_capacity_factors_scenarios": ["load", "net_load", "solar", "wind", "offshore_wind"],
    "dispatch_deciles_scenarios": ["generation", "pct_gen"],
    "trade_net_scenarios": ["imports", "exports", "net_imports"],
    "scan_symbol": ["level"],
    "stored_ca_capacity": ["capacity"],
    "stored_dispatch_without_optional": ["level"],
    "scan_multi_file": ["load_hour", "load_segment", "hydrogen_load"],
    "mart_csv_fom_costs": ["1996", "1997", "1998", "1999", "2000", "2001+"],
    "mart_csv_capcosts": ["1996", "1997", "1998", "1999", "2000", "2001", "1995"],
    "mart_parquet_capacity": ["capacity"],
    "statistics_csv_peak_factors": ["load", "net_load", "solar", "wind", "offshore_wind"],
}

# Means and shares of inexact numbers, whose last digits depend on the order of addition.
ROUNDED: dict[str, list[str]] = {
    "normalized_profile": ["solar", "value"],
    "peak_capacity_factors": ["solar", "wind", "offshore_wind"],
    "statistics_csv_peak_factors": ["solar", "wind", "offshore_wind"],
    "monthly_comparison": ["Wind", "Solar"],
    "dispatch_deciles": ["pct_gen"],
    "normalized_profile_scenarios": ["solar", "value"],
    "peak_capacity_factors_scenarios": ["solar", "wind", "offshore_wind"],
    "dispatch_deciles_scenarios": ["pct_gen"],
}
