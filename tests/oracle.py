"""Run registered queries beside their SQL and compare the rows.

    python -m tests.oracle /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

from panelforge.sources.tables import NAMES


def open_tables(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return bool(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (value + 0.0 if value else 0.0)
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.date | datetime.datetime):
        return value.isoformat()
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    return value


def normal_rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None if both sides agree, else what differs."""
    left = normal_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    result = con.execute(sql)
    right = normal_rows([d[0] for d in result.description], result.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    if repr(left[1]) != repr(right[1]):
        differing = [(a, b) for a, b in zip(left[1], right[1], strict=True) if repr(a) != repr(b)]
        return f"{len(differing)} of {len(left[1])} rows differ, first: {differing[0]}"
    return None


def main(folder: str, wanted: list[str]) -> int:
    from panelforge.catalog import QUERIES, SQL
    from panelforge.session import build_session

    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = open_tables(folder)
    names = [n for n in QUERIES if not wanted or any(n.startswith(w) for w in wanted)]
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in SQL:
                problem = compare(df, con, SQL[name])
                status = "ok" if problem is None else "DIFF " + problem
            else:
                status = f"rows {len(df.collect())} (no SQL)"
        except Exception as e:  # report and go on with the next query
            problem = status = "ERROR " + str(e)[: int(os.environ.get("ERR", "600"))]
        failed += status.startswith(("DIFF", "ERROR"))
        print(f"{name:45s} {time.time() - start:6.2f}s {status}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
