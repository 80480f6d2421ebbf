"""Hold queries against their SQL: ``python -m tests.compare FOLDER [NAME...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb


def rows_of(frame) -> list[tuple]:
    """Rows with columns in order of their names, floats rounded, sorted."""
    frame = frame[sorted(frame.columns)]
    clean = lambda x: None if x is None or x != x else round(x, 6) if isinstance(x, float) else x
    return sorted((tuple(clean(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=repr)


def tables(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in Path(folder).glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return db


def differs(frame, sql: str, db) -> str:
    """What differs between a query's rows and its SQL's, empty if nothing does."""
    ours, theirs = frame.toPandas(), db.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} and {sorted(theirs.columns)}"
    a, b = rows_of(ours), rows_of(theirs)
    if a != b:
        odd = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
        return f"{len(a)} and {len(b)} rows; {odd}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from tests.conftest import session

    spark, queries, sql = session(), entry.queries(), entry.oracle_sql()
    db = tables(sys.argv[1])
    for name in sys.argv[2:] or queries:
        began = time.time()
        try:
            found = differs(queries[name](spark, sys.argv[1]), sql[name], db) if name in sql else f"no SQL, {queries[name](spark, sys.argv[1]).count()} rows"
        except Exception as e:  # noqa: BLE001
            found = "ERROR " + str(e)[:300]
        print(name, round(time.time() - began, 1), found or "ok", flush=True)
