"""Run registered queries against their SQL twins: python tests/compare.py [names..]"""

import glob
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    con.execute("SET TimeZone='UTC'")
    return con


def canon(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return pdf.sort_values(list(pdf.columns), na_position="first").reset_index(drop=True)


def difference(spark_df, con, sql):
    """None when equal, else a short reason."""
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    types = {c: (got[c].dtype, want[c].dtype) for c in got if got[c].dtype != want[c].dtype}
    types = {c: t for c, t in types.items() if not (t[0].kind in "OT" and t[1].kind in "OT")}
    got, want = canon(got), canon(want)
    for c in got:
        a, b = got[c], want[c]
        if a.dtype.kind == "f" or b.dtype.kind == "f":
            a, b = a.astype(float), b.astype(float)
            same = (a == b) | (a.isna() & b.isna())
        else:
            same = (a.astype(object) == b.astype(object)) | (a.isna() & b.isna())
        if not same.all():
            i = int(np.flatnonzero(~same.to_numpy())[0])
            return f"{int((~same).sum())} of {len(a)} differ in {c}:\n{pd.concat([got.iloc[i], want.iloc[i]], axis=1)}"
    return f"types {types}" if types else None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tabulearn.session import local_session

    sf = os.environ.get("SF", "0.01")
    folder = f"/root/testdata/sf{sf}"
    spark, con = local_session(os.environ.get("CPUS", "8"), int(os.environ.get("PARTS", "8"))), duck(folder)
    names, sqls = entry.queries(), entry.oracle_sql()
    chosen = sys.argv[1:] or list(names)
    bad = []
    for name in chosen:
        start = time.time()
        try:
            df = names[name](spark, folder)
            if name in sqls:
                why = difference(df, con, sqls[name])
                status = "ok" if why is None else f"DIFF {why}"
            else:
                status = f"rows only {df.count()}"
        except Exception as e:  # report and go on with the next query
            status = f"ERROR {type(e).__name__} {str(e)[:900]}"
        if not status.startswith(("ok", "rows")):
            bad.append(name)
        print(f"{name:26s} {time.time() - start:6.2f}s {status}", flush=True)
    print(f"{len(chosen) - len(bad)} of {len(chosen)} good; bad: {bad}; sql without query: {sorted(set(sqls) - set(names))}")
