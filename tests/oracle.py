"""Runs registered queries next to their DuckDB SQL and compares the rows."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("ORACLE_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = DATA):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if hasattr(value, "as_tuple"):
        return round(float(value), 9)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, int):
        return float(value)
    if hasattr(value, "isoformat"):
        return value.isoformat()
    return value


def difference(spark, con, name, function, sql, sf_dir: str = DATA) -> str:
    """What differs between both, or the empty text."""
    got = function(spark, sf_dir)
    rel = con.sql(sql)
    if sorted(got.columns) != sorted(rel.columns):
        return f"columns {sorted(got.columns)} against {sorted(rel.columns)}"
    order = sorted(got.columns)
    mine = sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr)
    at = [rel.columns.index(c) for c in order]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    if not mine:
        return "no rows"
    if len(mine) != len(theirs):
        return f"{len(mine)} rows against {len(theirs)}; first here {mine[:2]}, there {theirs[:2]}"
    for a, b in zip(mine, theirs, strict=True):
        if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b, strict=True)):
            return f"{order}: {a} against {b}"
    return ""
