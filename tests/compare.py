"""Run registered queries next to their DuckDB twins and report differences.

Usage: python -m tests.compare sf0.01 [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

DATA = Path("/root/testdata")


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for file in sorted((DATA / sf).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def cell(value):
    """Comparable form of one value."""
    if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, pd.Timestamp):
        return value.date().isoformat()
    if hasattr(value, "isoformat"):
        return value.isoformat()[:10]
    if isinstance(value, bool):
        return value
    return float(value) + 0.0 if isinstance(value, (int, float)) else value


def rows(frame: pd.DataFrame) -> list[tuple]:
    ordered = frame.reindex(sorted(frame.columns), axis=1)
    table = [tuple(cell(v) for v in row) for row in ordered.itertuples(index=False, name=None)]
    return sorted(table, key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(ours: pd.DataFrame, theirs: pd.DataFrame) -> str | None:
    """None when both frames hold the same rows under the same column names."""
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(set(ours.columns) ^ set(theirs.columns))}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    a, b = rows(ours), rows(theirs)
    only_a, only_b = sorted(set(a) - set(b), key=str), sorted(set(b) - set(a), key=str)
    if not only_a and not only_b:
        return None
    names = sorted(ours.columns)
    shown = [(n, x, y) for n, x, y in zip(names, only_a[0], only_b[0]) if x != y] if only_a and only_b else only_a[:1] or only_b[:1]
    return f"{len(only_a)} of {len(a)} rows differ, first {shown[:4]}"


def main(sf: str, names: list[str]) -> None:
    from __spark_entry__ import oracle_sql, queries
    from barloom.session import local_session

    spark = local_session("8")
    spark.sparkContext.setLogLevel("OFF")
    connection = connect(sf)
    registered, twins = queries(), oracle_sql()
    for name in names or list(registered):
        start = time.time()
        try:
            ours = registered[name](spark, str(DATA / sf)).toPandas()
            middle = time.time()
            if name not in twins:
                print(f"{name:24s} rows-only {len(ours)} spark {middle - start:.1f}s", flush=True)
                continue
            theirs = connection.execute(twins[name]).df()
            found = differences(ours, theirs)
            print(f"{name:24s} {'OK' if found is None else 'DIFF ' + found} [{len(ours)}] "
                  f"spark {middle - start:.1f}s duckdb {time.time() - middle:.1f}s", flush=True)
        except Exception as error:  # report and go on with the next query
            print(f"{name:24s} FAIL {' '.join(str(error).split())[:300]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
