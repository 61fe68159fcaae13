"""Run registered queries against their SQL in DuckDB: ``python tests/check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from flowsift.session import build_session  # noqa: E402


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 6) + 0.0)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(row[i]) for i in order) for row in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def compare(spark, con, query, sql, sf_dir) -> str:
    """Empty if both give the same table, else the first difference."""
    df = query(spark, sf_dir)
    mine = table(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    other = table([d[0] for d in result.description], result.fetchall())
    if mine[0] != other[0]:
        return f"columns {mine[0]} != {other[0]}"
    if len(mine[1]) != len(other[1]):
        return f"{len(mine[1])} rows != {len(other[1])}"
    for a, b in zip(mine[1], other[1]):
        if a != b:
            return f"{a} != {b}"
    return ""


def main() -> int:
    import __spark_entry__ as registry

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    spark = build_session(
        "oracle", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle, failed = registry.oracle_sql(), []
    for name, query in registry.queries().items():
        if args[1:] and name not in args[1:]:
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = compare(spark, con, query, oracle[name], sf_dir)
            else:
                problem = "" if query(spark, sf_dir).count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {'' if name in oracle else '(rows only) '}{problem}", flush=True)
        failed += [name] if problem else []
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
