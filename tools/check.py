"""Compare registered queries with their SQL over the given tables: python tools/check.py [-sf 0.01] [name ...]."""
import argparse, hashlib, sys, time, traceback
sys.path.insert(0, __file__.rsplit("/", 2)[0])
import duckdb
import pandas as pd
from lodegrid.session import build_session
from lodegrid.catalog import load_all
from lodegrid.catalog.registry import QUERIES, ORACLES

ap = argparse.ArgumentParser()
ap.add_argument("-sf", default="0.01"); ap.add_argument("names", nargs="*"); ap.add_argument("-k", default="")
ap.add_argument("--explain", action="store_true"); ap.add_argument("--list", action="store_true"); ap.add_argument("--slow", type=float, default=0)
a = ap.parse_args()
load_all()
if a.list:
    print(len(QUERIES), len(ORACLES)); print(sorted(set(QUERIES) - set(ORACLES))); sys.exit()
names = [n for n in QUERIES if (not a.names or n in a.names) and a.k in n]
spark = build_session(8, spark__ui__showConsoleProgress="false"); spark.sparkContext.setLogLevel("ERROR")
d = f"/root/testdata/sf{a.sf}"
con = duckdb.connect()
for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
    con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
con.execute("SET TimeZone='UTC'")

def norm(v):
    if v is None: return "∅"
    if isinstance(v, bool): return str(v)
    if isinstance(v, float):
        if v != v: return "nan"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)) : return "[" + ",".join(norm(x) for x in v) + "]"
    if hasattr(v, "asDict"): return norm(list(v.asDict().values()))
    if isinstance(v, dict): return norm(list(v.values()))
    if hasattr(v, "as_tuple"): return repr(float(v))
    if isinstance(v, int): return str(v)
    return str(v)

bad = 0
for n in names:
    t0 = time.time()
    try:
        df = QUERIES[n](spark, d)
        if a.explain: df.explain("formatted")
        rows = df.collect(); cols = df.columns; ts = time.time() - t0
        if n not in ORACLES:
            print(f"rows  {n}: {len(rows)} rows {ts:.1f}s", flush=True); continue
        t1 = time.time(); r = con.execute(ORACLES[n]); dcols = [c[0] for c in r.description]; drows = r.fetchall(); td = time.time() - t1
        if sorted(cols) != sorted(dcols):
            print(f"FAIL  {n}: columns {sorted(cols)} vs {sorted(dcols)}"); bad += 1; continue
        order = sorted(cols); si = [cols.index(c) for c in order]; di = [dcols.index(c) for c in order]
        S = sorted(tuple(norm(r[i]) for i in si) for r in rows); D = sorted(tuple(norm(r[i]) for i in di) for r in drows)
        if S == D: print(f"ok    {n}: {len(rows)} rows spark {ts:.1f}s duck {td:.1f}s", flush=True)
        else:
            bad += 1; s, dd = set(S), set(D)
            print(f"FAIL  {n}: {len(S)} vs {len(D)} rows; {order}")
            for x in list(sorted(s - dd))[:4]: print("   spark", x)
            for x in list(sorted(dd - s))[:4]: print("   duck ", x)
    except Exception as e:
        bad += 1; print(f"ERROR {n}: {str(e)[:900]}", flush=True)
        if not isinstance(e, duckdb.Error) and "AnalysisException" not in type(e).__name__: traceback.print_exc(limit=-3)
print("bad", bad)
