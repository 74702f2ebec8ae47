"""Compare registered queries with their SQL: `python tests/oracle_check.py [sf_dir] [name ...]`."""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as contract  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    names = [columns[at] for at in order]
    return names, sorted((tuple(row[at] for at in order) for row in rows), key=repr)


def compare(spark, con, name, sf_dir):
    frame = contract.queries()[name](spark, sf_dir)
    spark_side = canonical(frame.columns, [tuple(row) for row in frame.collect()])
    cursor = con.execute(contract.oracle_sql()[name])
    duck_side = canonical([column[0] for column in cursor.description], cursor.fetchall())
    return spark_side, duck_side


if __name__ == "__main__":
    from conftest import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), duck(sf_dir)
    for name in sys.argv[2:] or contract.queries():
        if name not in contract.oracle_sql():
            print(name, "no SQL;", contract.queries()[name](spark, sf_dir).count(), "rows")
            continue
        started = time.time()
        ours, theirs = compare(spark, con, name, sf_dir)
        print(name, "equal" if ours == theirs else "DIFFERENT", len(ours[1]), f"{time.time() - started:.1f}s")
        if ours != theirs:
            print(" ", ours[0], theirs[0], len(theirs[1]))
            for a, b in zip(ours[1], theirs[1]):
                if a != b:
                    print("  spark", repr(a)[:600])
                    print("  duck ", repr(b)[:600])
                    break
