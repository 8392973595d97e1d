"""Run registered Spark queries next to their DuckDB oracle and compare.

Usage: python tests/oracle_compare.py [sf_dir] [name ...]

Comparison mirrors the driver's gate: row count, column names, and an
order-insensitive comparison of the values.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, os.path.dirname(HERE))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


TYPE_MAP = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
            "boolean": "BOOLEAN", "float": "FLOAT", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
            "date": "DATE", "array<float>": "FLOAT[]"}


def _canon(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        if math.isnan(v):
            return "∅"
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if hasattr(v, "tolist"):
        return _canon(v.tolist())
    if isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [tuple(_canon(r[i]) for i in order) for r in rows]


def compare(spark, sf_dir, name, fn, sql, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    out = {"name": name, "spark_rows": len(s_rows), "duck_rows": len(d_rows),
           "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    out["schema_ok"] = sorted(s_cols) == sorted(d_cols)
    if not out["schema_ok"]:
        out["spark_cols"], out["duck_cols"] = s_cols, d_cols
    s_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    d_types = {d[0]: str(d[1]) for d in res.description}
    bad_types = {c: (s_types[c], d_types.get(c)) for c in s_types
                 if TYPE_MAP.get(s_types[c], s_types[c]) != TYPE_MAP.get(d_types.get(c), d_types.get(c))}
    if bad_types:
        out["type_mismatch"] = bad_types
    a = sorted(rows_of(s_cols, s_rows))
    b = sorted(rows_of(d_cols, d_rows))
    out["values_ok"] = a == b
    if not out["values_ok"]:
        sa, sb = set(a), set(b)
        out["only_spark"] = sorted(sa - sb)[:3]
        out["only_duck"] = sorted(sb - sa)[:3]
    return out


def main(argv):
    from bibliospark.session import build_session
    import __spark_entry__ as E

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in names or sorted(qs):
        if name not in sqls:
            t0 = time.time()
            n = qs[name](spark, sf_dir).count()
            print({"name": name, "rows_only": n, "spark_s": round(time.time() - t0, 2)}, flush=True)
            continue
        try:
            r = compare(spark, sf_dir, name, qs[name], sqls[name], con)
        except Exception as e:  # report and continue
            r = {"name": name, "error": repr(e)[:800]}
        ok = (r.get("schema_ok") and r.get("values_ok") and r["spark_rows"] == r["duck_rows"]
              and not r.get("type_mismatch"))
        bad += 0 if ok else 1
        print(("OK  " if ok else "FAIL"), r, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
