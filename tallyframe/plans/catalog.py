"""Query catalogue: one entry per implemented operator, run over the supplied test tables.

Each entry pairs a Spark callable ``(spark, sf_dir) -> DataFrame`` with the equivalent DuckDB
SQL (or ``None`` when the operator is not SQL-expressible).  Output double columns are
rounded to ``DIGITS`` decimals on both sides (floating sums differ in the last bits between
engines); the list of double columns per query is generated from the Spark schemas into
``double_cols.json`` by ``python -m tallyframe.plans.catalog --write-doubles``.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, DateType, DecimalType, DoubleType, FloatType, TimestampNTZType,
                               TimestampType)

DIGITS = 6
SCALE = float(10 ** DIGITS)
_DOUBLES_FILE = os.path.join(os.path.dirname(__file__), "double_cols.json")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def finalize(df: DataFrame) -> DataFrame:
    """Presentation normalisation applied identically on the oracle side (``wrap_sql``):
    decimals/doubles -> double rounded to DIGITS decimals (-0.0 -> 0.0); dates -> 'yyyy-MM-dd';
    timestamps -> 'yyyy-MM-dd HH:mm:ss.SSSSSS'; arrays -> comma-joined text."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (DoubleType, FloatType, DecimalType)):
            x = c.cast("double")
            # sign(x) * floor(|x| * 10^d + 0.5) / 10^d: the same IEEE steps as the SQL side, so both
            # engines produce bit-identical values (their built-in round() break ties differently)
            r = F.signum(x) * F.floor(F.abs(x) * SCALE + 0.5) / SCALE
            out.append((r + F.lit(0.0)).alias(f.name))
        elif isinstance(f.dataType, DateType):
            out.append(F.date_format(c, "yyyy-MM-dd").alias(f.name))
        elif isinstance(f.dataType, (TimestampType, TimestampNTZType)):
            out.append(F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(f.name))
        elif isinstance(f.dataType, ArrayType):
            out.append(F.array_join(c.cast("array<string>"), ",").alias(f.name))
        else:
            out.append(c)
    return df.select(*out)


def _load_doubles() -> dict[str, list[str]]:
    if os.path.exists(_DOUBLES_FILE):
        with open(_DOUBLES_FILE) as fh:
            return json.load(fh)
    return {}


_SQL_TYPE = {"bigint": "BIGINT", "int": "INTEGER"}


def wrap_sql(name: str, sql: str, types: dict) -> str:
    """Cast the oracle's output to the Spark output types and apply ``finalize``'s normalisation."""
    t = types.get(name) or {}
    repl = [f'sign(CAST("{c}" AS DOUBLE)) * floor(abs(CAST("{c}" AS DOUBLE)) * 1e{DIGITS} + 0.5) / 1e{DIGITS} + 0.0 AS "{c}"'
            for c in t.get("double", [])]
    for k, sqlt in _SQL_TYPE.items():
        repl += [f'CAST("{c}" AS {sqlt}) AS "{c}"' for c in t.get(k, [])]
    repl += [f'strftime(CAST("{c}" AS DATE), \'%Y-%m-%d\') AS "{c}"' for c in t.get("date", [])]
    repl += [f'strftime(CAST("{c}" AS TIMESTAMP), \'%Y-%m-%d %H:%M:%S.%f\') AS "{c}"' for c in t.get("timestamp", [])]
    repl += [f'array_to_string("{c}", \',\') AS "{c}"' for c in t.get("array", [])]
    if not repl:
        return sql
    return f"SELECT * REPLACE ({', '.join(repl)}) FROM (\n{sql}\n) AS q"


def _ensure_loaded():
    # import report query modules so their @register decorators run
    from . import queries  # noqa: F401


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _ensure_loaded()

    def mk(q: Query):
        return lambda spark, d: finalize(q.build(spark, d))

    return {n: mk(q) for n, q in REGISTRY.items()}


def oracle_queries() -> dict[str, str]:
    _ensure_loaded()
    dbl = _load_doubles()
    return {n: wrap_sql(n, q.sql, dbl) for n, q in REGISTRY.items() if q.sql is not None}


def _kind(dt) -> str | None:
    if isinstance(dt, (DoubleType, FloatType, DecimalType)):
        return "double"
    if isinstance(dt, DateType):
        return "date"
    if isinstance(dt, (TimestampType, TimestampNTZType)):
        return "timestamp"
    if isinstance(dt, ArrayType):
        return "array"
    return {"bigint": "bigint", "int": "int"}.get(dt.simpleString())


def write_doubles(spark: SparkSession, d: str) -> dict:
    """Record each query's output column kinds (from the Spark schema) for ``wrap_sql``."""
    _ensure_loaded()
    out = {}
    for n, q in REGISTRY.items():
        schema = q.build(spark, d).schema
        kinds: dict[str, list[str]] = {k: [] for k in ("double", "bigint", "int", "date", "timestamp", "array")}
        for f in schema.fields:
            k = _kind(f.dataType)
            if k:
                kinds[k].append(f.name)
        out[n] = kinds
    with open(_DOUBLES_FILE, "w") as fh:
        json.dump(out, fh, indent=0, sort_keys=True, ensure_ascii=False)
    return out


if __name__ == "__main__":
    import sys

    from tallyframe.plans import catalog as _cat
    from tallyframe.session import get_spark
    if "--write-doubles" in sys.argv:
        s = get_spark("local[4]", 4)
        r = _cat.write_doubles(s, "/root/testdata/sf0.001")
        print(f"wrote {len(r)} entries")
