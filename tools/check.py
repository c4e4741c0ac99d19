"""Run every query and compare it with its SQL on DuckDB.

usage: python tools/check.py [sf_dir] [name-part ...]   (env ROWS_PER_TASK=0 asks for eight cells)
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

from tallygrid.catalog import ORACLES, QUERIES
from tallygrid.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    return v


def key(row):
    return tuple((v is None, str(type(v).__name__), str(v)) for v in row)


def compare(got, want, cols):
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = sorted(got, key=key), sorted(want, key=key)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, cols {cols}: {bad[0][0]} != {bad[0][1]}"
    return None


def main() -> int:
    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    wanted = args[1:]
    spark = local_session(8, shared=tempfile.mkdtemp(prefix="spark-"))
    if os.environ.get("ROWS_PER_TASK"):
        spark.conf.set("tallygrid.rowsPerTask", os.environ["ROWS_PER_TASK"])
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    failed = []
    for name, fn in QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf)
            cols = sorted(df.columns)
            got = [tuple(normal(r[c]) for c in cols) for r in df.collect()]
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows {name} {len(got)} {took:.1f}s {dict(df.dtypes) if wanted else ''} {got[0] if got else ''}", flush=True)
                if not got:
                    failed.append(name)
                continue
            rel = con.sql(ORACLES[name])
            names = sorted(rel.columns)
            if names != cols:
                raise ValueError(f"columns {cols} != {names}")
            at = [rel.columns.index(c) for c in names]
            want = [tuple(normal(r[i]) for i in at) for r in rel.fetchall()]
            why = compare(got, want, cols)
            kinds = dict(df.dtypes)
            theirs = {c: str(t) for c, t in zip(rel.columns, rel.types)}
            pairs = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
            off = {c: (k, theirs[c]) for c, k in kinds.items() if pairs.get(k) != theirs[c]}
            print(f"{'ok  ' if not why else 'FAIL'} {name} {len(got)} {took:.1f}s {why or ''} {off or ''}", flush=True)
            if why:
                failed.append(name)
        except Exception as e:
            failed.append(name)
            text = str(e).split("JVM stacktrace")[0]
            print(f"FAIL {name} {type(e).__name__}: {text[:700]}", flush=True)
            if wanted:
                traceback.print_exc(limit=-6)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
