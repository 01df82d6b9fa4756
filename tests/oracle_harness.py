"""Side-by-side check of a Spark query and its DuckDB oracle SQL.

Mirrors the driver's gate: same column names, same row count, and an
order-insensitive comparison of all values (columns sorted by name).
"""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


STRICT = False


def _norm(v):
    if STRICT and v is not None and not isinstance(v, bool):
        if isinstance(v, int):
            return ("i", v)
        if isinstance(v, decimal.Decimal):
            return ("dec", str(v))
    if v is None:
        return ("~null",)
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int,)):
        return ("n", float(v))
    if isinstance(v, decimal.Decimal):
        return ("n", float(v))
    if isinstance(v, float):
        if math.isnan(v):
            return ("nan",)
        return ("n", v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return ("t", v.isoformat())
    if isinstance(v, (list, tuple)):
        return ("l", tuple(_norm(x) for x in v))
    if isinstance(v, dict):
        return ("d", tuple(sorted((k, _norm(x)) for k, x in v.items())))
    return ("s", str(v))


def compare(spark_df, con, sql: str) -> dict:
    sp_cols = spark_df.columns
    rows_sp = [tuple(r) for r in spark_df.collect()]
    rel = con.execute(sql)
    db_cols = [d[0] for d in rel.description]
    rows_db = rel.fetchall()
    out = {"spark_rows": len(rows_sp), "oracle_rows": len(rows_db)}
    if sorted(sp_cols) != sorted(db_cols):
        out["ok"] = False
        out["why"] = f"columns differ: {sorted(sp_cols)} vs {sorted(db_cols)}"
        return out
    order_sp = [sp_cols.index(c) for c in sorted(sp_cols)]
    order_db = [db_cols.index(c) for c in sorted(db_cols)]
    a = sorted(tuple(_norm(r[i]) for i in order_sp) for r in rows_sp)
    b = sorted(tuple(_norm(r[i]) for i in order_db) for r in rows_db)
    out["ok"] = a == b
    if not out["ok"]:
        sa, sb = set(a), set(b)
        diff_a = [x for x in a if x not in sb][:3]
        diff_b = [x for x in b if x not in sa][:3]
        out["why"] = f"values differ; spark-only {diff_a}; oracle-only {diff_b}"
    return out
