"""Run registered queries and compare them with their SQL in DuckDB.

    python -m workload.check [sf folder] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb

from runledger import get_session
from workload import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def cell(value):
    """Numbers compare exactly, whatever their type."""
    if isinstance(value, float):
        return "NaN" if value != value else value + 0.0
    if isinstance(value, bool) or value is None or isinstance(value, (int, str)):
        return value
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(cell(row[i]) for i in order) for row in rows), key=str), [names[i] for i in order]


def compare(spark, con, name, sf):
    start = time.time()
    df = QUERIES[name](spark, sf)
    got, columns = rows_of(df.columns, df.collect())
    seconds = time.time() - start
    if name not in ORACLES:
        return seconds, len(got), "rows only"
    result = con.execute(ORACLES[name])
    want, want_columns = rows_of([d[0] for d in result.description], result.fetchall())
    if columns != want_columns:
        return seconds, len(got), f"COLUMNS {columns} != {want_columns}"
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    spelt = {d[0]: str(d[1]) for d in result.description}
    if got != want:
        only = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return seconds, len(got), f"VALUES {len(got)} != {len(want)}: {only}"
    return seconds, len(got), "ok " + " ".join(f"{c}:{kinds[c]}/{spelt[c]}" for c in columns)


def main(argv):
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    spark = get_session(
        "check", master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
           "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    bad = 0
    for name in argv[1:] or QUERIES:
        try:
            seconds, rows, verdict = compare(spark, con, name, sf)
        except Exception as error:  # noqa: BLE001 - the list of failures is the result
            seconds, rows, verdict = 0.0, 0, f"ERROR {str(error)[:600]}"
        bad += not verdict.startswith(("ok", "rows only"))
        print(f"{name:28s} {seconds:6.2f}s {rows:7d} {verdict}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
