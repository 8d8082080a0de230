"""Comparison of a query with its SQL on the same Parquet tables."""

import os

import duckdb
import pyarrow.parquet as pq  # noqa: F401  duckdb reads through it


def rows_of(frame) -> list[str]:
    columns = sorted(frame.columns)
    values = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted(map(repr, values.itertuples(index=False, name=None)))


def sql_rows(sql: str, folder: str):
    with duckdb.connect() as con:
        for name in os.listdir(folder):
            con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{name}'")
        return con.execute(sql).df()


def assert_same(query, sql: str, spark, folder: str) -> None:
    ours, theirs = query(spark, folder).toPandas(), sql_rows(sql, folder)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)
