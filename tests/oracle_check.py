"""Compare catalogue queries with their DuckDB SQL on one data directory.

Usage: python -m tests.oracle_check [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

import __spark_entry__ as contract


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns in name order, comparable whatever the engine."""

    def cell(value):
        if value is None or value is pd.NaT or value is pd.NA or (isinstance(value, float) and value != value):
            return ""
        if isinstance(value, float):
            return repr(value + 0.0)
        return repr(value.item() if hasattr(value, "item") else value)

    ordered = frame[sorted(frame.columns)].astype(object)
    return sorted(tuple(cell(v) for v in row) for row in ordered.itertuples(index=False, name=None))


def differences(spark, con, name: str, sf_dir: str, show: int = 3) -> list[str]:
    rows = contract.queries()[name](spark, sf_dir)
    # columns of whole numbers stay whole where they hold nulls
    got = rows.toPandas().astype({c: "Int64" for c, kind in rows.dtypes if kind in ("int", "bigint")})
    want = con.execute(contract.oracle_sql()[name]).df()
    if sorted(got.columns) != sorted(want.columns):
        return [f"columns {sorted(got.columns)} != {sorted(want.columns)}"]
    left, right = canonical(got), canonical(want)
    if left == right:
        return []
    a, b = set(left), set(right)
    lines = [f"rows {len(left)} != {len(right)}, only spark {len(a - b)}, only sql {len(b - a)}"]
    return lines + [f"spark {r}" for r in sorted(a - b)[:show]] + [f"sql   {r}" for r in sorted(b - a)[:show]]


def main() -> None:
    from tests.conftest import session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), oracle(sf_dir)
    for name in sys.argv[2:] or contract.oracle_sql():
        start = time.time()
        try:
            found = differences(spark, con, name, sf_dir)
        except Exception as error:  # noqa: BLE001 - a report line per query
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        print(f"{'ok  ' if not found else 'DIFF'} {name} {time.time() - start:.1f}s", flush=True)
        for line in found:
            print("     " + line[:700], flush=True)


if __name__ == "__main__":
    main()
