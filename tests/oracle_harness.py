"""Local replica of the driver's correctness gate: Spark query vs DuckDB oracle SQL.

Usage:  python tests/oracle_harness.py [sf_dir] [name-substring ...]
Prints one line per query: OK / MISMATCH with row counts and the first differing column.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    try:
        import numpy as np
        if isinstance(v, np.ndarray):
            return tuple(_norm(x) for x in v.tolist())
        if isinstance(v, np.generic):
            return _norm(v.item())
    except ImportError:
        pass
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return float(v) if False else v
    return v


def rows_of(df: pd.DataFrame):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(x) for x in rec))
    return cols, sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(sp: pd.DataFrame, dk: pd.DataFrame) -> str | None:
    cs, rs = rows_of(sp)
    cd, rd = rows_of(dk)
    if cs != cd:
        return f"columns differ spark={cs} duck={cd}"
    if len(rs) != len(rd):
        return f"rows differ spark={len(rs)} duck={len(rd)}"
    for a, b in zip(rs, rd):
        if a != b:
            for c, x, y in zip(cs, a, b):
                if x != y:
                    if isinstance(x, (int, float)) and isinstance(y, (int, float)) and x == y:
                        continue
                    return f"value differ col={c} spark={x!r} duck={y!r}"
    return None


def main(argv):
    sf = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in argv[1:] if not a.startswith("/")]
    from tallyframe.plans.catalog import oracle_queries, spark_queries
    from tallyframe.session import get_spark
    if os.environ.get("PLAIN_SESSION"):
        from pyspark.sql import SparkSession  # the driver's kind of session: no package defaults
        spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
                 .config("spark.ui.enabled", "false").getOrCreate())
    else:
        spark = get_spark("local[8]", 8)
    qs = spark_queries()
    sqls = oracle_queries()
    con = duck(sf)
    bad = 0
    for name in sorted(qs):
        if pats and not any(p in name for p in pats):
            continue
        t0 = time.time()
        try:
            sp = qs[name](spark, sf).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"SPARK-ERROR {name}: {str(e).splitlines()[0][:300]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"ROWS-ONLY {name}: rows={len(sp)} ({t1 - t0:.1f}s)")
            continue
        try:
            dk = con.execute(sqls[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"DUCK-ERROR {name}: {str(e)[:400]}")
            bad += 1
            continue
        msg = compare(sp, dk)
        if msg:
            bad += 1
            print(f"MISMATCH {name}: {msg}")
        else:
            print(f"OK {name}: rows={len(sp)} ({t1 - t0:.1f}s)")
    print(f"done, {bad} problems")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
