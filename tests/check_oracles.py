"""Compare registered queries with their DuckDB SQL: ``check_oracles.py [sf_dir] [query ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def rows_of(columns, rows):
    """Rows with columns by name, in an order that does not depend on the engine."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def text(value):
        return repr(float(value)) if isinstance(value, float) else repr(value)

    return sorted(columns), sorted(tuple(text(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, name: str, query, sql: str) -> str:
    """Empty text if both sides agree, else what differs."""
    df = query(spark, sf_dir)
    left_columns, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    right_columns, right = rows_of([d[0] for d in result.description], result.fetchall())
    if left_columns != right_columns:
        return f"columns {left_columns} / {right_columns}"
    if left != right:
        only_left, only_right = sorted(set(left) - set(right))[:2], sorted(set(right) - set(left))[:2]
        return f"{len(left)} / {len(right)} rows; {str(only_left)[:600]} / {str(only_right)[:600]}"
    return ""


def main() -> None:
    from conftest import make_session

    import __spark_entry__ as registered

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registered.queries())
    spark, con = make_session(), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(
                spark, con, sf_dir, name, registered.queries()[name], registered.oracle_sql()[name]
            )
        except Exception as error:  # report every query, whatever happens to one
            problem = "".join(traceback.format_exception_only(error))[:1500]
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")


if __name__ == "__main__":
    main()
