"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def _norm(v, digits):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), digits) + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x, digits) for x in v)
    return str(v)


def rows_of(columns, rows, digits=9):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_norm(r[i], digits) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def differences(spark_df, con, sql, digits=9):
    """None when equal, else a short description."""
    cur = con.execute(sql)
    oc = [d[0] for d in cur.description]
    oracle = rows_of(oc, cur.fetchall(), digits)
    sc = spark_df.columns
    if sorted(sc) != sorted(oc):
        return f"columns {sorted(sc)} != {sorted(oc)}"
    mine = rows_of(sc, [tuple(r) for r in spark_df.collect()], digits)
    if mine == oracle:
        return None if mine else "EMPTY"
    only_mine = [r for r in mine if r not in set(oracle)][:3]
    only_oracle = [r for r in oracle if r not in set(mine)][:3]
    return f"{len(mine)} vs {len(oracle)} rows; cols {sorted(sc)}\n   spark {only_mine}\n   duck  {only_oracle}"
