"""Compare a Spark query with its DuckDB oracle (order-insensitive).

Usable from pytest and as a script:
    python tests/oracle_compare.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()[:10] if not isinstance(v, dt.datetime) else v.isoformat()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return float(v)
    return v


def normalise(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    out.sort(key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))
    return cols, out


def _frame(pdf):
    """Canonical pandas frame: columns sorted by name, floats rounded to 6
    decimals, dates/decimals/bools unified, rows sorted."""
    import pandas as pd
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        col = pdf[c]
        if pd.api.types.is_bool_dtype(col):
            pdf[c] = col.astype("float64")
        elif pd.api.types.is_numeric_dtype(col):
            pdf[c] = col.astype("float64").round(6) + 0.0
        elif pd.api.types.is_datetime64_any_dtype(col):
            pdf[c] = col.dt.strftime("%Y-%m-%d")
        else:
            pdf[c] = col.map(_norm).astype("object")
    pdf = pdf.astype("object").where(pdf.notna(), None)
    key = pdf.astype(str)
    order = key.sort_values(list(key.columns)).index
    return pdf.loc[order].reset_index(drop=True)


def compare(spark, con, name, spark_fn, sql, sf_dir):
    t0 = time.time()
    sdf = spark_fn(spark, sf_dir)
    s_pdf = sdf.toPandas()
    t1 = time.time()
    d_pdf = con.execute(sql).df()
    t2 = time.time()
    info = {"name": name, "spark_rows": len(s_pdf), "oracle_rows": len(d_pdf),
            "spark_s": round(t1 - t0, 2), "oracle_s": round(t2 - t1, 2)}
    if sorted(s_pdf.columns) != sorted(d_pdf.columns):
        info.update(ok=False, cols=(sorted(s_pdf.columns), sorted(d_pdf.columns)))
        return info
    a, b = _frame(s_pdf), _frame(d_pdf)
    ok = len(a) == len(b) and a.equals(b)
    info["ok"] = bool(ok)
    if not ok and len(a) == len(b):
        ne = (a != b) & ~(a.isna() & b.isna())
        rows = ne.any(axis=1)
        info["diff"] = [(a[rows].head(3).to_dict("records")), (b[rows].head(3).to_dict("records"))]
    return info


def compare_in_duckdb(spark, con, name, spark_fn, sql, sf_dir, out):
    """For large outputs: the Spark rows are written to ``out`` and both sides are subtracted
    from each other, repeated rows included, in DuckDB."""
    spark_fn(spark, sf_dir).write.mode("overwrite").parquet(out)
    source = f"read_parquet('{out}/*.parquet')"
    kinds = {r[0]: r[1] for r in con.execute(f"DESCRIBE SELECT * FROM {source}").fetchall()}
    other = {r[0]: r[1] for r in con.execute(f"DESCRIBE SELECT * FROM ({sql})").fetchall()}
    if set(kinds) != set(other):
        return {"name": name, "ok": False, "cols": (sorted(kinds), sorted(other))}
    number = ("INT", "DOUBLE", "FLOAT", "DECIMAL", "BOOLEAN")

    def cols(types):
        return ", ".join(f"ROUND(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" if any(k in types[c] for k in number)
                         else f"CAST({c} AS VARCHAR) AS {c}" for c in sorted(types))
    a, b = f"SELECT {cols(kinds)} FROM {source}", f"SELECT {cols(other)} FROM ({sql})"
    con.execute(f"CREATE OR REPLACE TEMP TABLE _spark AS {a}")
    con.execute(f"CREATE OR REPLACE TEMP TABLE _oracle AS {b}")
    rows, extra, missing = con.execute(
        "SELECT (SELECT COUNT(*) FROM _spark), (SELECT COUNT(*) FROM (FROM _spark EXCEPT ALL FROM _oracle)), "
        "(SELECT COUNT(*) FROM (FROM _oracle EXCEPT ALL FROM _spark))").fetchone()
    return {"name": name, "ok": extra == missing == 0, "rows": rows, "extra": extra, "missing": missing}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from mercato.session import build_session
    import __spark_entry__ as E
    spark = build_session("local[8]")
    qs, oq = E.queries(), E.oracle_sql()
    con = duck_connect(sf_dir)
    bad = 0
    for name in (names or list(qs)):
        if name not in oq:
            df = qs[name](spark, sf_dir)
            print({"name": name, "rows_only": df.count()}, flush=True)
            continue
        try:
            info = compare(spark, con, name, qs[name], oq[name], sf_dir)
        except Exception as e:  # noqa: BLE001
            info = {"name": name, "ok": False, "error": repr(e)[:600]}
        bad += not info["ok"]
        print(info, flush=True)
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main(sys.argv)
