"""Run a registered query and its SQL on the same parquet files and compare all rows."""
from __future__ import annotations

import math
import time
from collections import Counter

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else float(v)
    if hasattr(v, "item") and not isinstance(v, (pd.Timestamp,)):
        try:
            return _norm(v.item())
        except ValueError:
            return tuple(_norm(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, (int,)) and not isinstance(v, bool):
        return float(v)
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tzinfo else v)
    return str(v) if not isinstance(v, bool) else v


def rows_of(pdf: pd.DataFrame) -> Counter:
    cols = sorted(pdf.columns)
    return Counter(tuple(_norm(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False, name=None))


def compare(spark, sf_dir: str, fn, sql: str | None):
    t0 = time.time()
    got = fn(spark, sf_dir)
    dups = [c for c in got.columns if got.columns.count(c) > 1]
    assert not dups, f"duplicate columns {dups}"
    got = got.toPandas()
    t1 = time.time()
    if sql is None:
        return True, f"{len(got)} rows, no SQL", t1 - t0
    want = duck(sf_dir).sql(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}", t1 - t0
    bad_types = [c for c in got.columns if str(got[c].dtype)[:3] != str(want[c].dtype)[:3] and
                 not (got[c].isna().any() or want[c].isna().any())]
    a, b = rows_of(got), rows_of(want)
    if a == b:
        note = f" types differ: {[(c, str(got[c].dtype), str(want[c].dtype)) for c in bad_types]}" if bad_types else ""
        return True, f"{len(got)} rows{note}", t1 - t0
    only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
    return False, (f"spark {len(got)} sql {len(want)} differing {sum((a - b).values())}/{sum((b - a).values())}\n"
                   f"  cols {sorted(got.columns)}\n  spark {only_a}\n  sql   {only_b}"), t1 - t0
