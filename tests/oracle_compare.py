"""Side-by-side check of a Spark query and its DuckDB oracle (driver-like).

Row count, column names and an order-insensitive hash of canonicalised
values are compared.  Used by the pytest suite and runnable by hand:

    python tests/oracle_compare.py /root/testdata/sf0.01 [query ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import math
import sys

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(v) -> str:
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        if v.is_integer() and abs(v) < 2**53:
            return str(int(v))
        return f"{round(v, 6):.6f}"
    if isinstance(v, decimal.Decimal):
        return canon(float(v))
    if isinstance(v, (bool,)):
        return str(v)
    if isinstance(v, (pd.Timestamp, dt.datetime)):
        return pd.Timestamp(v).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canon(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return canon(v.tolist())
    if hasattr(v, "item"):
        return canon(v.item())
    return str(v)


def digest(df: pd.DataFrame) -> tuple[int, list[str], str]:
    cols = sorted(df.columns)
    rows = sorted("|".join(canon(r[c]) for c in cols) for r in df[cols].to_dict("records"))
    return len(rows), cols, hashlib.sha256("\n".join(rows).encode()).hexdigest()


def spark_pdf(sdf) -> pd.DataFrame:
    rows = sdf.collect()
    return pd.DataFrame([r.asDict(recursive=True) for r in rows], columns=sdf.columns)


def compare(spark, sf_dir: str, name: str, fn, sql: str, con=None) -> dict:
    con = con or duck(sf_dir)
    s = spark_pdf(fn(spark, sf_dir))
    o = con.execute(sql).df()
    o = o.astype(object).where(o.notna(), None)
    ds, do = digest(s), digest(o)
    res = {"query": name, "rows_spark": ds[0], "rows_oracle": do[0],
           "cols_match": ds[1] == do[1], "hash_match": ds[2] == do[2]}
    if not res["hash_match"]:
        res["spark_cols"], res["oracle_cols"] = ds[1], do[1]
        ss = sorted("|".join(canon(r[c]) for c in ds[1]) for r in s[ds[1]].to_dict("records")) if res["cols_match"] else []
        oo = sorted("|".join(canon(r[c]) for c in do[1]) for r in o[do[1]].to_dict("records")) if res["cols_match"] else []
        res["only_spark"] = [x[:300] for x in sorted(set(ss) - set(oo))[:3]]
        res["only_oracle"] = [x[:300] for x in sorted(set(oo) - set(ss))[:3]]
    return res


if __name__ == "__main__":
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from support_signals.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark = build_session()
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = 0
    for name in sorted(q):
        if wanted and name not in wanted:
            continue
        if name not in o:
            n = q[name](spark, sf).count()
            print(f"{name:28s} rows={n} (no oracle)")
            continue
        try:
            r = compare(spark, sf, name, q[name], o[name], con)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"{name:28s} ERROR {type(e).__name__}: {str(e)[:400]}")
            continue
        ok = r["hash_match"] and r["rows_spark"] == r["rows_oracle"]
        bad += not ok
        print(f"{name:28s} {'OK ' if ok else 'BAD'} rows={r['rows_spark']}/{r['rows_oracle']}"
              + ("" if ok else f" {r}"))
    print("bad", bad)
