"""Run registered queries next to their SQL twins and report differences.

usage: python tests/compare.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import math
import os
import sys
import threading
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

LIMIT = float(os.environ.get("COMPARE_LIMIT", "60"))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return value + 0.0
    if isinstance(value, list):
        return tuple(cell(v) for v in value)
    return value


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(cell(row[i]) for i in order) for row in data), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    start = time.time()
    timer = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        frame = query(spark, sf_dir)
        spark_rows = [tuple(r) for r in frame.collect()]
    finally:
        timer.cancel()
    took = time.time() - start
    if sql is None:
        return f"rows-only {len(spark_rows)}", took, True
    timer = threading.Timer(LIMIT, con.interrupt)
    timer.start()
    try:
        cur = con.execute(sql)
        columns = [d[0] for d in cur.description]
        duck_rows = cur.fetchall()
    finally:
        timer.cancel()
    left_names, left = rows_of(frame.columns, spark_rows)
    right_names, right = rows_of(columns, duck_rows)
    if left_names != right_names:
        return f"COLUMNS {left_names} != {right_names}", took, False
    if len(left) != len(right):
        return f"ROWS {len(left)} != {len(right)}", took, False
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return f"VALUES {len(bad)}/{len(left)} e.g. {str(bad[0])[:600]}", took, False
    kinds = [
        (n, type(next((r[i] for r in left if r[i] is not None), None)).__name__,
         type(next((r[i] for r in right if r[i] is not None), None)).__name__)
        for i, n in enumerate(left_names)
    ]
    mixed = [k for k in kinds if k[1] != k[2]]
    if mixed:
        return f"TYPES {mixed}", took, False
    return f"ok {len(left)}", took, True


def main():
    from plumbline.session import local_session

    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    wanted = sys.argv[2:]
    spark = local_session("compare")
    con = connect(sf_dir)
    queries, twins = entry.queries(), entry.oracle_sql()
    failed = []
    for name, query in queries.items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            text, took, good = compare(spark, con, name, query, twins.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            text, took, good = f"ERROR {type(error).__name__} {str(error)[:1500]}", 0.0, False
        if not good:
            failed.append(name)
        print(f"{name:32s} {took:6.2f}s +{time.time() - start - took:5.2f}s {text}", flush=True)
    print("failed:", failed)


if __name__ == "__main__":
    main()
