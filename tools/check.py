"""Run registered queries on Spark and their SQL on DuckDB over the same tables and compare."""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tickloom.catalog import load  # noqa: E402
from tickloom.session import local_session  # noqa: E402


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        pdf[c] = pdf[c].map(lambda v: "NULL" if v is None or v is pd.NaT or v != v else
                            (repr(float(v)) if isinstance(v, float) else str(v)))
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*", help="name prefixes")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--explain", action="store_true")
    ap.add_argument("--show", action="store_true")
    args = ap.parse_args()
    root = f"/root/testdata/sf{args.sf}"
    spark = local_session()
    con = duckdb.connect()
    for f in glob.glob(f"{root}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    bad = []
    for name, q in load().items():
        if args.names and not any(name.startswith(p) for p in args.names):
            continue
        try:
            t0 = time.time()
            df = q.run(spark, root)
            if args.explain:
                df.explain("formatted")
            got = df.toPandas()
            t1 = time.time()
            if args.show:
                print(got.head(8).to_string())
            nulls = [c for c in got.columns if len(got) and got[c].isna().all()]
            note = f" all-NULL {nulls}" if nulls else ""
            if q.sql is None:
                print(f"rows  {name}: {len(got)} rows {t1 - t0:.2f}s{note}", flush=True)
                continue
            want = con.execute(q.sql).df()
            t2 = time.time()
            a, b = canonical(got), canonical(want)
            if list(a.columns) == list(b.columns) and (a.equals(b) or len(a) == len(b) == 0):
                print(f"OK    {name}: {len(got)} rows spark {t1 - t0:.2f}s duck {t2 - t1:.2f}s{note}", flush=True)
                continue
            bad.append(name)
            print(f"DIFF  {name}: {len(got)} vs {len(want)} rows, {list(a.columns)} vs {list(b.columns)}", flush=True)
            if len(a) == len(b) and list(a.columns) == list(b.columns):
                keep = (a != b).any(axis=1)
                print(int(keep.sum()), "rows differ")
                m = a.merge(b, how="outer", indicator=True)
                m = m[m._merge != "both"]
                keys = [c for c in ("trading_pair", "symbol", "ts") if c in m]
                print(m.sort_values(keys).head(8).to_string())
            else:
                m = a.merge(b, how="outer", indicator=True) if list(a.columns) == list(b.columns) else a
                if "_merge" in m:
                    print(m[m._merge != "both"].head(8).to_string())
        except Exception as e:  # noqa: BLE001
            bad.append(name)
            print(f"FAIL  {name}: {type(e).__name__} {str(e)[:600]}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
