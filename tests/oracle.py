"""Compare a registered query with its SQL, as sorted rows of sorted columns."""

from __future__ import annotations

import duckdb


def normal(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(normal(r[i]) for i in order) for r in rows), key=str)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(sf_dir: str, sql: str):
    con = duckdb.connect()
    import os

    for f in os.listdir(sf_dir):
        name = f.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{f}'")
    cursor = con.execute(sql)
    return rows_of([d[0] for d in cursor.description], cursor.fetchall())
