"""Runs registered queries against their DuckDB oracles: row count, schema and value compare.

``python tests/oracle.py [sf_dir] [name-prefix …]``
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

FAMILY = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "bigint", "HUGEINT": "hugeint", "DOUBLE": "double", "FLOAT": "float",
    "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp",
}


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        return f"{v.normalize():f}"
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0 if v != 0 else 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{norm(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def spark_type(t) -> str:
    s = t.simpleString()
    return {"smallint": "int", "tinyint": "int", "timestamp_ntz": "timestamp"}.get(s, s)


def duck_type(t) -> str:
    s = str(t)
    return FAMILY.get(s, s.lower())


def connect(sf_dir: str):
    from evalspark.plans.common import TABLES

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def compare(spark, con, name, fn, sql, sf_dir) -> str:
    """Empty text if the results agree, else what differs."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    if sql is None:
        return "" if got else "no rows"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"columns {cols} != {sorted(names)}"
    types = {d[0]: duck_type(d[1]) for d in cur.description}
    mine = {f.name: spark_type(f.dataType) for f in df.schema.fields}
    at = {n: i for i, n in enumerate(names)}
    want = sorted(tuple(norm(r[at[c]]) for c in cols) for r in cur.fetchall())
    diff = {c: (mine[c], types[c]) for c in cols if mine[c] != types[c]}
    if diff:
        return f"types {diff}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; only spark {[g for g in got if g not in want][:2]}; only duck {[w for w in want if w not in got][:2]}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return f"values {cols} {bad}"
    return "" if got else "no rows"


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from evalspark.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    only = argv[1:]
    spark, con = local_session(8, "oracle"), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    assert not set(oracles) - set(queries), set(oracles) - set(queries)
    for name, fn in queries.items():
        if only and not any(name.startswith(o) for o in only):
            continue
        t0 = time.time()
        try:
            problem = compare(spark, con, name, fn, oracles.get(name), sf)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:34s} {time.time() - t0:6.2f}s {'' if name in oracles else '(rows only) '}{problem}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
