"""Run the registered queries beside their SQL: ``python tests/check_queries.py [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def comparable(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """Empty text when equal, else what differs."""
    mine = comparable([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    theirs = comparable(result.fetchall(), [d[0] for d in result.description])
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        a, b = set(map(repr, mine[1])), set(map(repr, theirs[1]))
        return f"rows {len(mine[1])} / {len(theirs[1])}, e.g. {sorted(a - b)[:3]} / {sorted(b - a)[:3]}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.conftest import session

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark, con = session(), duck(sf_dir)
    found, sql = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or found:
        start = time.time()
        try:
            df = found[name](spark, sf_dir)
            if name in sql:
                wrong = compare(df, con, sql[name])
            else:
                wrong = f"(no SQL) {df.count()} rows"
        except Exception as e:  # report and go on
            wrong = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if not wrong else 'DIFF'} {name} {time.time() - start:.1f}s {wrong}", flush=True)
