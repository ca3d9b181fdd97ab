"""Compare a query with its DuckDB SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb


def rows(names, table) -> list[str]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(r[i] for i in order)) for r in table)


def check(spark, query, sql: str, sf_dir: str) -> int:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got = query(spark, sf_dir)
    want = con.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, map(tuple, got.collect())), rows(want.columns, want.fetchall())
    assert a == b
    return len(a)
