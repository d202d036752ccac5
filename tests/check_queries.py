"""Compare registered queries with their SQL: python -m tests.check_queries <folder> [names]."""
import decimal
import glob
import math
import os
import sys


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return str([plain(item) for item in value]) if isinstance(value, (list, tuple)) else value


def connect(folder: str):
    import duckdb

    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return connection


def differences(spark, connection, name: str, folder: str) -> str | None:
    """None when both sides agree, else what differs."""
    from deltascope.queries import catalog

    frame = catalog.QUERIES[name](spark, folder)
    rows = frame.collect()
    if name not in catalog.ORACLES:
        return None if rows else "no rows"
    cursor = connection.execute(catalog.ORACLES[name])
    columns = [item[0] for item in cursor.description]
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(set(columns) ^ set(frame.columns))}"
    order = sorted(columns)
    left = sorted((tuple(plain(row[c]) for c in order) for row in rows), key=repr)
    right = sorted((tuple(plain(row[columns.index(c)]) for c in order) for row in cursor.fetchall()), key=repr)
    if left == right:
        return None
    only = lambda a, b: sorted(set(map(repr, a)) - set(map(repr, b)))[:2]
    return f"{len(left)} and {len(right)} rows; {order}; spark only {only(left, right)}; sql only {only(right, left)}"


if __name__ == "__main__":
    from deltascope.queries import catalog
    from deltascope.session import local_session

    session, database = local_session("check"), connect(sys.argv[1])
    for query in sys.argv[2:] or catalog.QUERIES:
        print(query, differences(session, database, query, sys.argv[1]) or "ok", flush=True)
