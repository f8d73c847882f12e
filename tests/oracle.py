"""Compare bound queries with their SQL on the shared tables.

Usage: ``python -m tests.oracle [--sf 0.001] [name ...]`` (a name may be a prefix).
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return connection


def cell(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.6g}" if value != int(value) else str(int(value))
    if isinstance(value, decimal.Decimal):
        return cell(float(value))
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return str([cell(item) for item in value])
    if isinstance(value, dict):
        return str({key: cell(item) for key, item in value.items()})
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda index: columns[index])
    return sorted([tuple(str(cell(row[index])) for index in order) for row in rows])


def compare(spark, connection, bound, sf_dir: str) -> tuple[int, str | None]:
    df = bound.build(spark, sf_dir)
    got = rows_of(df.columns, [tuple(row) for row in df.collect()])
    if bound.sql is None:
        return len(got), None
    result = connection.sql(bound.sql)
    if sorted(result.columns) != sorted(df.columns):
        return len(got), f"columns differ: {sorted(df.columns)} vs {sorted(result.columns)}"
    want = rows_of(result.columns, result.fetchall())
    if got != want:
        extra, missing = [row for row in got if row not in set(want)][:3], [row for row in want if row not in set(got)][:3]
        return len(got), f"{len(got)} vs {len(want)} rows; only spark {extra}; only sql {missing}; columns {sorted(df.columns)}"
    return len(got), None


def main() -> None:
    from lodestone.plans import all_queries
    from tests.conftest import build_session

    names = sys.argv[1:]
    sf = "0.001"
    if names[:1] == ["--sf"]:
        sf, names = names[1], names[2:]
    spark = build_session()
    sf_dir = f"/root/testdata/sf{sf}"
    connection = duck(sf_dir)
    bad = 0
    for name, bound in sorted(all_queries().items()):
        if names and not any(name.startswith(prefix) for prefix in names):
            continue
        start = time.time()
        try:
            count, problem = compare(spark, connection, bound, sf_dir)
        except Exception as error:  # noqa: BLE001 - report and go on
            count, problem = -1, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += problem is not None
        kind = "sql" if bound.sql else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {name} {kind} rows={count} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
