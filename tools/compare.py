"""Run queries on Spark and their check SQL on DuckDB and compare the rows.

    python tools/compare.py [sf dir] [query ...]
"""

from __future__ import annotations

import math
import pathlib
import sys
import time

import duckdb

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from stringwatch.plans.catalog import CHECKS, QUERIES  # noqa: E402
from stringwatch.session import local_session  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def canonical(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(value):
        if value is None or (isinstance(value, float) and math.isnan(value)):
            return "~"
        if isinstance(value, bool):
            return str(int(value))
        if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
            return f"{float(value):.6f}".replace("-0.000000", "0.000000")
        return str(value)

    return [columns[i] for i in order], sorted(tuple(cell(row[i]) for i in order) for row in rows)


def compare(spark, connection, name: str, sf_dir: str) -> tuple[bool, str]:
    begin = time.time()
    frame = QUERIES[name](spark, sf_dir)
    ours = canonical(frame.columns, [tuple(r) for r in frame.collect()])
    spent = time.time() - begin
    if name not in CHECKS:
        return True, f"{len(ours[1])} rows, no SQL, {spent:.1f}s"
    relation = connection.sql(CHECKS[name])
    theirs = canonical(relation.columns, relation.fetchall())
    types = {c: str(t) for c, t in zip(relation.columns, relation.types)}
    if ours[0] != theirs[0]:
        return False, f"columns {ours[0]} vs {theirs[0]}"
    if ours[1] != theirs[1]:
        a, b = set(ours[1]), set(theirs[1])
        return False, (
            f"{len(ours[1])} vs {len(theirs[1])} rows; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"
        )
    wide = [f"{c}:{t}/{frame.schema[c].dataType.simpleString()}" for c, t in types.items()]
    return True, f"{len(ours[1])} rows, {spent:.1f}s, {' '.join(wide)}"


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        try:
            same, text = compare(spark, connection, name, sf_dir)
        except Exception as error:  # a failing query must not hide the others
            same, text = False, f"{type(error).__name__}: {str(error)[:600]}"
        failed += not same
        print("ok  " if same else "FAIL", name, text if not same else text[:150], flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
