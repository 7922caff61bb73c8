"""Run registered queries beside their SQL and compare all rows."""

from __future__ import annotations

import datetime
import math
import os
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    db = duckdb.connect()
    for table in TABLES:
        path = f"{sf_dir}/{table}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        elif not os.path.exists(path):
            continue
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return db


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_value(x) for x in v) + "]"
    return f"{type(v).__name__}:{v}"


def rows_of_spark(df):
    order = sorted(df.columns)
    return order, Counter(tuple(_value(r[c]) for c in order) for r in df.collect())


def rows_of_sql(db, sql):
    cursor = db.execute(sql)
    names = [c[0] for c in cursor.description]
    order = sorted(names)
    at = [names.index(c) for c in order]
    return order, Counter(tuple(_value(r[i]) for i in at) for r in cursor.fetchall())


SQL_TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def type_difference(df, db, sql) -> str | None:
    expected = {r[0]: r[1] for r in db.execute(f"DESCRIBE {sql}").fetchall()}
    got = {name: SQL_TYPES.get(kind, kind) for name, kind in df.dtypes}
    wrong = {n: (got[n], expected.get(n)) for n in got if got[n] != expected.get(n)}
    return f"types {wrong}" if wrong else None


def difference(df, db, sql) -> str | None:
    """None where both give the same columns, types and rows; otherwise what differs."""
    wrong = type_difference(df, db, sql)
    if wrong:
        return wrong
    columns, got = rows_of_spark(df)
    expected_columns, expected = rows_of_sql(db, sql)
    if columns != expected_columns:
        return f"columns {columns} != {expected_columns}"
    if got != expected:
        extra, missing = got - expected, expected - got
        return (
            f"{sum(extra.values())} extra, {sum(missing.values())} missing; "
            f"extra {str(list(extra)[:2])[:400]}; missing {str(list(missing)[:2])[:400]}"
        )
    return None


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry_point
    from tests.conftest import make_session

    sf_dir = sys.argv[1]
    chosen = sys.argv[2:]
    spark, db = make_session(), connect(sf_dir)
    sqls = entry_point.oracle_sql()
    for name, query in entry_point.queries().items():
        if chosen and name not in chosen:
            continue
        start = time.time()
        try:
            if name in sqls:
                result = difference(query(spark, sf_dir), db, sqls[name]) or "ok"
            else:
                result = f"rows only: {query(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            result = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        print(f"{name}: {result} ({time.time() - start:.1f}s)", flush=True)
