"""A query beside its SQL: rows are compared as the driver does, columns by name and floats rounded."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(round(r[i], 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


def same(spark, query, sql, sf=SF):
    df = query(spark, sf)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got = con.execute(sql)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows([d[0] for d in got.description], got.fetchall())
