"""Side by side: a Spark query and its SQL in DuckDB over the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p if os.path.isfile(p) else p + '/*.parquet'}')")
    return c


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else round(v, 6) + 0.0
        if hasattr(v, "tzinfo"):
            return v.replace(tzinfo=None)
        return float(v) if v.__class__.__name__ == "Decimal" else v

    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


def compare(df, sql, connection):
    got = canonical(df.collect(), df.columns)
    rel = connection.execute(sql)
    names = [d[0] for d in rel.description]
    want = canonical(rel.fetchall(), names)
    assert sorted(names) == sorted(df.columns)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b, (a, b)
    return len(got)


