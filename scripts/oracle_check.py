"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

usage: python scripts/oracle_check.py [sf_dir] [name ...]
"""
from __future__ import annotations

import datetime
import math

import pandas as pd
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

from forumshift.plans.fixtures import TABLES  # noqa: E402
from forumshift.plans.registry import all_queries  # noqa: E402
from forumshift.session import get_spark  # noqa: E402


def normalise(pdf):
    pdf = pdf[sorted(pdf.columns)]
    rows = []
    for rec in pdf.itertuples(index=False):
        row = []
        for v in rec:
            if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
                row.append("<null>")
            elif isinstance(v, (pd.Timestamp, datetime.datetime)):
                row.append(v.strftime("%Y-%m-%d") if (v.hour, v.minute, v.second, v.microsecond) == (0, 0, 0, 0)
                           else v.strftime("%Y-%m-%d %H:%M:%S.%f"))
            elif isinstance(v, datetime.date):
                row.append(v.isoformat())
            elif isinstance(v, float):
                row.append(str(int(v)) if v.is_integer() else f"{v:.6f}")
            elif hasattr(v, "tolist"):
                row.append(repr(v.tolist()))
            else:
                row.append(str(v))
        rows.append(tuple(row))
    return list(pdf.columns), sorted(rows)


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


DUCK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
              "DATE": "date", "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}


def check(spark, con, q, sf_dir, verbose=True):
    t0 = time.time()
    sdf = q.build(spark, sf_dir)
    sp = sdf.toPandas()
    t1 = time.time()
    if q.sql is None:
        return "rows-only", len(sp), t1 - t0
    rel = con.sql(q.sql)
    dtypes = {c: DUCK_TYPES.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types)}
    stypes = dict(sdf.dtypes)
    if stypes != dtypes:
        diff = {c: (stypes.get(c), dtypes.get(c)) for c in set(stypes) | set(dtypes)
                if stypes.get(c) != dtypes.get(c)}
        return f"TYPES {diff}", len(sp), t1 - t0
    dp = rel.df()
    sc, sr = normalise(sp)
    dc, dr = normalise(dp)
    if sc != dc:
        return f"COLS {sc} vs {dc}", len(sp), t1 - t0
    if len(sr) != len(dr):
        return f"ROWS {len(sr)} vs {len(dr)}", len(sp), t1 - t0
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        if verbose:
            for a, b in bad[:3]:
                print("  spark:", a, "\n  duck: ", b)
        return f"VALUES {len(bad)} rows differ", len(sp), t1 - t0
    return "ok", len(sp), t1 - t0


def main(argv):
    sf_dir = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            sf_dir = a
        else:
            names.append(a)
    spark = get_spark("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs = all_queries()
    bad = 0
    for name, q in qs.items():
        if names and name not in names:
            continue
        try:
            status, n, dt = check(spark, con, q, sf_dir)
        except Exception as e:  # noqa: BLE001
            status, n, dt = f"ERROR {type(e).__name__}: {str(e)[:300]}", -1, 0
        bad += status not in ("ok", "rows-only")
        print(f"{name:28s} {status:12s} rows={n} {dt:.1f}s", flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
