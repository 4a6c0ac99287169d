"""A registered query against its SQL in DuckDB, on the tables of one folder."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = Path(folder, f"{t}.parquet")
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else float(f"{v:.9g}")
        if isinstance(v, (list, tuple)):
            return tuple(plain(x) for x in v)
        return v

    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def same(spark, name, query, sql, folder):
    df = query(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    con = connect(folder)
    cur = con.execute(sql)
    theirs = rows([d[0] for d in cur.description], cur.fetchall())
    assert mine[0] == theirs[0], f"{name}: {mine[0]} {theirs[0]}"
    assert len(mine[1]) == len(theirs[1]), f"{name}: {len(mine[1])} {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1], strict=True):
        assert a == b, f"{name}: {a} {b}"
    return len(mine[1])
