"""Compare a Spark result with DuckDB's: columns, types, and rows as a multiset."""

from __future__ import annotations

from collections import Counter

import duckdb
from pyspark.sql import DataFrame

GIVEN = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

# DuckDB type names and the Spark types that hold the same values.
SAME_TYPE = {
    "INTEGER": {"int"},
    "BIGINT": {"bigint"},
    "DOUBLE": {"double"},
    "VARCHAR": {"string"},
    "DATE": {"date"},
    "TIMESTAMP": {"timestamp_ntz"},
    "BOOLEAN": {"boolean"},
}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in GIVEN:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def difference(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when both hold the same rows, else what differs."""
    columns = sorted(result.columns)
    described = connection.execute(f"DESCRIBE {sql}").fetchall()
    theirs = {name: kind for name, kind, *_ in described}
    if sorted(theirs) != columns:
        return f"columns {columns} against {sorted(theirs)}"
    ours = dict(result.dtypes)
    kinds = {c: (ours[c], theirs[c]) for c in columns if ours[c] not in SAME_TYPE.get(theirs[c], set())}
    if kinds:
        return f"types {kinds}"
    names = ", ".join(f'"{c}"' for c in columns)
    expected = Counter(connection.execute(f"SELECT {names} FROM ({sql}) q").fetchall())
    actual = Counter(tuple(row) for row in result.select(*columns).collect())
    if actual == expected:
        return None
    return f"{sum(actual.values())} rows against {sum(expected.values())}; only here {list((actual - expected).items())[:3]}; only there {list((expected - actual).items())[:3]}"
