"""Runs queries next to their DuckDB twins: python tests/check_twins.py [folder] [names...]"""

import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

import __spark_entry__ as e  # noqa: E402
from tidyshelf.session import local_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, int) and not isinstance(v, bool):
        return str(v)
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, folder, name, query, sql):
    """(ok, number of rows, note)"""
    df = query(spark, folder)
    mine = df.collect()
    if sql is None:
        return True, len(mine), "no twin"
    theirs = con.execute(sql)
    cols = [c[0] for c in theirs.description]
    other = theirs.fetchall()
    if sorted(cols) != sorted(df.columns):
        return False, len(mine), f"columns {sorted(df.columns)} / {sorted(cols)}"
    a, b = rows_of(df.columns, mine), rows_of(cols, other)
    if a == b:
        return True, len(mine), ""
    diff = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return False, len(mine), f"{len(a)} / {len(b)} rows, {sorted(cols)}\n  {diff[0]}\n  {diff[1]}"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(folder)
    bad = 0
    for name, query in e.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            ok, n, note = compare(spark, con, folder, name, query, e.oracle_sql().get(name))
        except Exception as x:  # noqa: BLE001 - reported, the run goes on
            ok, n, note = False, -1, f"{type(x).__name__}: {str(x)[:600]}"
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {n} rows {time.time() - start:.1f}s {note}", flush=True)
    print("bad:", bad)
