"""Runs queries beside their oracle SQL in DuckDB and compares whole results."""

from __future__ import annotations

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    rel = db.sql(sql)
    return rel.columns, rel.fetchall()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(norm(r[k]) for k in order) for r in data), key=repr)


def difference(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if both agree."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    columns, data = oracle(sf_dir, sql)
    want = rows(columns, data)
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(df.columns)} and {sorted(columns)}"
    if got == want:
        return ""
    extra, missing = [r for r in got if r not in set(want)][:3], [r for r in want if r not in set(got)][:3]
    return f"{len(got)} and {len(want)} rows; only here {extra}; only there {missing}"
