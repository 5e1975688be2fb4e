"""Runs registered queries next to their SQL checks and compares the rows.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _key(value) -> str:
    if isinstance(value, float):
        return repr(float(value))
    return f"{type(value).__name__}:{value}" if value is not None else "null"


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda n: columns[n])
    return sorted(columns), sorted(tuple(_key(row[n]) for n in order) for row in rows)


def compare(spark, connection, function, check, sf_dir):
    """(same, text): the text says what differs first."""
    frame = function(spark, sf_dir)
    mine = table(frame.columns, [tuple(r) for r in frame.collect()])
    result = connection.execute(check)
    theirs = table([c[0] for c in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return False, f"columns {mine[0]} against {theirs[0]}"
    if mine[1] == theirs[1]:
        return True, f"{len(mine[1])} rows"
    only_mine = sorted(set(mine[1]) - set(theirs[1]))[:2]
    only_theirs = sorted(set(theirs[1]) - set(mine[1]))[:2]
    return False, f"{len(mine[1])} against {len(theirs[1])} rows\n   mine   {only_mine}\n   theirs {only_theirs}"


def main() -> int:
    import __spark_entry__ as entry
    from postfunnel.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    spark = build_session("local[8]", spark__sql__shuffle__partitions=8, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                          spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    connection, checks, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, function in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            if name in checks:
                same, text = compare(spark, connection, function, checks[name], sf_dir)
            else:
                frame = function(spark, sf_dir)
                same, text = True, f"{frame.count()} rows, no check"
        except Exception as problem:  # keep going: the list of all failures is the point
            same, text = False, f"{type(problem).__name__}: {str(problem)[:900]}"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        bad += not same
        print(f"{'ok ' if same else 'BAD'} {name} {time.time() - start:.1f}s {text}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
