"""Run registered queries against DuckDB: python tests/check_oracle.py [sf] [name ...]."""

from __future__ import annotations

import os
import sys
import time
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(cell(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, cell(x)) for k, x in v.items()))
    return v


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[bool, str]:
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    if got == want:
        return True, f"{sum(got.values())} rows"
    extra, missing = got - want, want - got
    return False, (
        f"spark {sum(got.values())} duckdb {sum(want.values())}; only spark {sum(extra.values())} "
        f"{list(extra)[:2]}; only duckdb {sum(missing.values())} {list(missing)[:2]}"
    )


def main() -> int:
    from cairn.session import local_session
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("sf") else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark, con = local_session(8), connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    picked = [q for q in queries if not args or any(q.startswith(a) for a in args)]
    bad = 0
    for name in picked:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in sqls:
                ok, note = compare(df, con, sqls[name])
            else:
                n = len(df.collect())
                ok, note = n > 0, f"{n} rows, no SQL"
        except Exception as e:  # a failing query is reported, the others still run
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(picked) - bad}/{len(picked)} ok")
    return bad


if __name__ == "__main__":
    sys.exit(main())
