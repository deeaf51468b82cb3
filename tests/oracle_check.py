"""Run queries next to their DuckDB SQL and compare names, types and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents"
    " embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return db


def _value(v):
    if isinstance(v, float):
        return "null" if math.isnan(v) else repr(v + 0.0)
    return "null" if v is None else repr(v)


def _bag(table) -> list:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted(tuple(map(_value, row)) for row in zip(*columns, strict=True))


def _types(schema) -> dict:
    return {f.name: str(f.type).replace("large_", "") for f in schema}


def compare(frame, db, sql: str) -> tuple[int, list[str]]:
    """Row count and differences; none means equal."""
    got, want = frame.toArrow(), db.sql(sql).to_arrow_table()
    problems = []
    if _types(got.schema) != _types(want.schema):
        problems.append(f"types {_types(got.schema)} != {_types(want.schema)}")
    if sorted(got.column_names) != sorted(want.column_names):
        return got.num_rows, problems
    a, b = _bag(got), _bag(want)
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        problems.append(f"rows {len(a)} / {len(b)}; {only_a[:2]} / {only_b[:2]}")
    return got.num_rows, problems


def main(sf_dir: str, *names: str) -> None:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from __spark_entry__ import oracle_sql, queries
    from tests.conftest import make_session

    spark, db = make_session(), connect(sf_dir)
    oracles = oracle_sql()
    for name, run in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in oracles:
                rows, problems = compare(run(spark, sf_dir), db, oracles[name])
            else:
                rows, problems = run(spark, sf_dir).toArrow().num_rows, []
        except Exception as error:  # noqa: BLE001
            rows, problems = -1, [str(error)[:1500]]
        took = time.time() - start
        print(f"{'ok ' if not problems else 'BAD'} {name} {rows} rows {took:.1f}s", *problems, flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
