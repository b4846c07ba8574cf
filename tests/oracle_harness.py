"""Run registered queries in Spark and their oracle SQL in DuckDB; compare.

Usage: python tests/oracle_harness.py [sf_dir] [name ...]
Compares row count, column names and an order-insensitive multiset of rows
(floats rounded to 9 significant digits).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events "
          "documents embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        if math.isinf(v):
            return "inf" if v > 0 else "-inf"
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "asDict"):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "isoformat"):
        return v.isoformat()
    try:
        import decimal
        if isinstance(v, decimal.Decimal):
            return float(f"{float(v):.9g}")
    except Exception:
        pass
    return v


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "boolean": "BOOLEAN", "array<int>": "INTEGER[]", "binary": "BLOB"}


def type_mismatches(df, rel):
    """Columns whose Spark type and DuckDB type differ."""
    sdt = dict(df.dtypes)
    return [(c, sdt.get(c), str(t)) for c, t in zip(rel.columns, rel.types)
            if SPARK_TO_DUCK.get(sdt.get(c), sdt.get(c)) != str(t)]


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, sf_dir, names=None, verbose=True):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    qs, os_ = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(qs):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols, srows = rows_of(df.columns, srows)
            ts = time.time() - t0
            if name not in os_:
                results[name] = ("rows-only", len(srows))
                if verbose:
                    print(f"{name:32s} rows-only {len(srows)} ({ts:.1f}s)")
                continue
            rel = con.sql(os_[name])
            dcols, drows = rows_of(rel.columns, rel.fetchall())
            ok = (scols == dcols, len(srows) == len(drows), srows == drows)
            bad_types = type_mismatches(df, rel)
            if bad_types:
                ok = ok + (False,)
            results[name] = ok
            if verbose:
                print(f"{name:32s} cols={ok[0]} rows={ok[1]}({len(srows)}/{len(drows)})"
                      f" values={ok[2]} ({ts:.1f}s)")
                if bad_types:
                    print("   types:", bad_types)
                if not ok[0]:
                    print("   spark:", scols, "\n   duck: ", dcols)
                elif not ok[2]:
                    sa, da = set(srows), set(drows)
                    print("   only spark:", list(sa - da)[:3])
                    print("   only duck: ", list(da - sa)[:3])
        except Exception as e:  # report and go on
            results[name] = ("error", repr(e)[:300])
            if verbose:
                print(f"{name:32s} ERROR {repr(e)[:600]}")
    return results


if __name__ == "__main__":
    from opinio.session import get_spark
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    res = compare(spark, sf, sys.argv[2:] or None)
    bad = [k for k, v in res.items() if v != (True, True, True)
           and not (isinstance(v, tuple) and v[0] == "rows-only")]
    print("NOT OK:", bad)
