"""Compare registered queries with their SQL in DuckDB: python check.py [sf_dir] [name ...]."""

from __future__ import annotations

import math
import sys
import time

import duckdb

from eventlake.plans.catalog import ORACLES, QUERIES
from eventlake.plans.tables import TABLES
from eventlake.session import local_session


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool | None, str]:
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if name not in ORACLES:
        return None, f"{len(got)} rows, no SQL"
    rel = con.execute(ORACLES[name])
    columns = [d[0] for d in rel.description]
    want = rows_of(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} <> {sorted(columns)}"
    if got == want:
        return True, f"{len(got)} rows"
    extra = [g for g in got if g not in set(want)][:2]
    lacking = [w for w in want if w not in set(got)][:2]
    return False, f"{len(got)} rows <> {len(want)}; only here {extra}; only there {lacking}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(8), connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as exc:
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += ok is False
        print(f"{'ok  ' if ok else '--  ' if ok is None else 'BAD '} {name} {time.time() - start:.2f}s {note[:900]}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main())
