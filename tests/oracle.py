"""Spark's rows against DuckDB's."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = con.sql(f"select * from ({sql}) q").arrow()
    df = df.read_all() if hasattr(df, "read_all") else df
    names = sorted(df.column_names)
    return names, [tuple(r[n] for n in names) for r in df.to_pylist()]


def _key(row):
    return tuple("~" if v is None else f"{v:.6e}" if isinstance(v, float) else str(v) for v in row)


def differences(df, sf_dir: str, sql: str) -> list:
    names = sorted(df.columns)
    mine = sorted((tuple(r[n] for n in names) for r in df.collect()), key=_key)
    other_names, other = duck_rows(sf_dir, sql)
    if names != other_names:
        return [names, other_names]
    other.sort(key=_key)
    if len(mine) != len(other):
        return [len(mine), len(other)]
    same = lambda a, b: a == b or (isinstance(a, float) and isinstance(b, float) and (math.isclose(a, b, rel_tol=1e-9, abs_tol=2e-8) or (math.isnan(a) and math.isnan(b))))
    return [(a, b) for a, b in zip(mine, other, strict=True) if not all(map(same, a, b))][:3]
