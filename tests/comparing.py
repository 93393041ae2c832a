"""Spark result against DuckDB result: same columns, same types, same multiset of rows."""

from __future__ import annotations

import math

import duckdb

from tests.conftest import TABLES

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


def key(row):
    return tuple((value is None, str(value)) for value in row)


def differences(frame, con, sql: str, show: int = 4) -> list[str]:
    result = con.execute(sql)
    duck_types = {d[0]: str(d[1]) for d in result.description}
    spark_types = {f.name: KINDS.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in frame.schema}
    problems = []
    if set(duck_types) != set(spark_types):
        return [f"columns differ: spark {sorted(spark_types)} duckdb {sorted(duck_types)}"]
    names = sorted(duck_types)
    for name in names:
        if duck_types[name] != spark_types[name]:
            problems.append(f"{name}: spark {spark_types[name]} duckdb {duck_types[name]}")
    order = [list(duck_types).index(name) for name in names]
    expected = sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=key)
    actual = sorted((tuple(plain(row[name]) for name in names) for row in frame.collect()), key=key)
    if len(expected) != len(actual):
        problems.append(f"rows: spark {len(actual)} duckdb {len(expected)}")
    if expected != actual:
        left, right = set(actual), set(expected)
        for row in sorted(left - right, key=key)[:show]:
            problems.append(f"only spark:  {dict(zip(names, row))}"[:1500])
        for row in sorted(right - left, key=key)[:show]:
            problems.append(f"only duckdb: {dict(zip(names, row))}"[:1500])
    if not actual:
        problems.append("empty result")
    return problems
