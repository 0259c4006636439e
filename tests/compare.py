"""Runs registered queries and holds them against their SQL on DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sf_dir: str, sql: str) -> list[tuple]:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(sql)
    return canonical([d[0] for d in cur.description], cur.fetchall())


def spark_rows(df) -> list[tuple]:
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def canonical(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else f"{x:.6f}"
        return str(x) if not isinstance(x, (int,)) or isinstance(x, bool) else f"{x}"

    return [tuple(names[i] for i in order), *sorted(tuple(cell(r[i]) for i in order) for r in rows)]
