"""Compare a registered query with its DuckDB oracle (development check).

Row count, column names and an order-insensitive comparison of values; floats
are compared after rounding to 9 decimals.
"""

from __future__ import annotations

import datetime as _dt
import math

from meterflow.plans import catalog, oracle

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def duckdb_connection(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 9) + 0.0
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict, str)):
        try:
            return _norm(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and not isinstance(v, str)):
        seq = v.tolist() if hasattr(v, "tolist") else v
        return tuple(_norm(x) for x in seq)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def _rows(records, cols):
    out = []
    for r in records:
        out.append(tuple(_norm(r[c]) for c in cols))
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


SPARK_TO_DUCK = {"IntegerType": "INTEGER", "LongType": "BIGINT", "DoubleType": "DOUBLE",
                 "StringType": "VARCHAR", "BooleanType": "BOOLEAN", "TimestampNTZType": "TIMESTAMP",
                 "DateType": "DATE", "FloatType": "FLOAT", "ShortType": "SMALLINT",
                 "ByteType": "TINYINT"}


def type_differences(sdf, rel) -> dict:
    """Columns whose Spark type and DuckDB type differ (scalar types)."""
    spark_types = {f.name: SPARK_TO_DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__)
                   for f in sdf.schema.fields}
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    return {c: (t, duck_types.get(c)) for c, t in spark_types.items()
            if t in SPARK_TO_DUCK.values() and t != duck_types.get(c)}


def compare(spark, name: str, sf_dir: str, con=None) -> dict:
    con = con or duckdb_connection(sf_dir)
    sdf = catalog.REGISTRY[name](spark, sf_dir)
    s_cols = sorted(sdf.columns)
    s_rows = [r.asDict(recursive=True) for r in sdf.collect()]
    rel = con.sql(oracle.ORACLE[name])
    d_cols = sorted(rel.columns)
    d_raw = rel.fetchall()
    d_rows = [dict(zip(rel.columns, r)) for r in d_raw]
    result = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
              "columns_match": s_cols == d_cols, "spark_cols": s_cols, "oracle_cols": d_cols,
              "type_differences": type_differences(sdf, rel)}
    if s_cols != d_cols:
        result["ok"] = False
        return result
    a, b = _rows(s_rows, s_cols), _rows(d_rows, s_cols)
    diffs = []
    if a != b:
        sa, sb = set(a), set(b)
        diffs = [("spark_only", x) for x in list(sa - sb)[:3]] + \
                [("oracle_only", x) for x in list(sb - sa)[:3]]
    result["values_match"] = a == b
    result["diffs"] = diffs
    result["ok"] = len(s_rows) == len(d_rows) and a == b
    return result
