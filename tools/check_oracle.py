"""Local mirror of the driver's correctness gate: run each registered query in Spark and its
oracle SQL in DuckDB on the same parquet tables, compare schema, row count and values.

usage: python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v
    if hasattr(v, "item"):
        return norm(v.item())
    return v


def key(row):
    return tuple((0, "") if v is None else (1, str(v)) for v in row)


def main():
    args = sys.argv[1:]
    sf = args[0] if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    names = [a for a in args if not os.path.isdir(a)]
    from wattlens import catalog, oracle
    from wattlens.session import build_session
    spark = build_session("local[8]", 8)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sqls = catalog.oracle_sql()
    ok = bad = 0
    for name in (names or list(catalog.QUERIES)):
        t0 = time.time()
        df = catalog.run(spark, name, sf)
        doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
        if sorted(doubles) != sorted(oracle.DOUBLE_COLUMNS.get(name, [])):
            print(f"  DOUBLE_COLUMNS[{name!r}] = {doubles!r}")
        rows = [tuple(r) for r in df.collect()]
        t1 = time.time()
        if name not in sqls:
            print(f"{name:28s} spark rows={len(rows)} ({t1 - t0:.1f}s)  [no oracle]")
            continue
        rel = con.sql(sqls[name])
        ocols = rel.columns
        otypes = [str(t) for t in rel.types]
        orows = rel.fetchall()
        scols = df.columns
        msg = []
        if sorted(scols) != sorted(ocols):
            msg.append(f"columns spark={scols} oracle={ocols}")
        else:
            stypes = {f.name: f.dataType.simpleString() for f in df.schema.fields}
            tmap = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
                    "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}
            tdiff = [(c, stypes[c], t) for c, t in zip(ocols, otypes) if tmap.get(t, t) != stypes[c]]
            if tdiff:
                msg.append(f"types {tdiff}")
            order = [ocols.index(c) for c in scols]
            orows = [tuple(r[i] for i in order) for r in orows]
            a = sorted((tuple(norm(v) for v in r) for r in rows), key=key)
            b = sorted((tuple(norm(v) for v in r) for r in orows), key=key)
            if len(a) != len(b):
                msg.append(f"rows spark={len(a)} oracle={len(b)}")
            diff = [(x, y) for x, y in zip(a, b) if x != y]
            if diff:
                msg.append(f"{len(diff)} differing rows, e.g. spark={diff[0][0]} oracle={diff[0][1]}")
        status = "OK " if not msg else "BAD"
        ok += not msg
        bad += bool(msg)
        print(f"{status} {name:28s} rows={len(rows)} ({t1 - t0:.1f}s) {'; '.join(msg)}")
    print(f"ok={ok} bad={bad}")
    spark.stop()


if __name__ == "__main__":
    main()
