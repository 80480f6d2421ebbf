"""Queries over copies of the smallest tables with odd values, held against their SQL."""

from __future__ import annotations

import shutil

import duckdb
import pytest

from loomgraph.plans.catalogue import QUERIES, SQL
from tests.compare import differs, tables
from tests.test_queries import FOLDER


def changed(folder, table: str, sql: str) -> str:
    """A copy of the smallest tables in which ``table`` is what ``sql`` makes of it."""
    shutil.copytree(FOLDER, folder, dirs_exist_ok=True, copy_function=shutil.copyfile)
    folder.chmod(0o755)
    out = folder / f"{table}.parquet"
    out.unlink()
    duckdb.sql(sql.format(table=f"read_parquet('{FOLDER}/{table}.parquet')")).write_parquet(str(out))
    return str(folder)


@pytest.mark.parametrize("name", ["patch_diff", "undo_state", "restore_at_seq"])
def test_the_first_change_of_a_log_counts(spark, tmp_path, name):
    """A node is added by change 0 and again by change 700 only."""
    own = "event_id IN (0, 700)"
    first = f"SELECT * REPLACE (CASE WHEN {own} THEN 99999 ELSE user_id END AS user_id, CASE WHEN {own} THEN 'view' ELSE event_type END AS event_type) FROM {{table}}"
    folder = changed(tmp_path / "d", "events", first)
    assert differs(QUERIES[name](spark, folder), SQL[name], tables(folder)) == ""


@pytest.mark.parametrize("name", ["shacl_datatype", "shacl_report"])
def test_a_zero_with_a_sign_is_not_negative(spark, tmp_path, name):
    folder = changed(tmp_path / "d", "customer", "SELECT * REPLACE (CASE WHEN c_custkey % 10 = 1 THEN '-0.0'::DOUBLE ELSE c_acctbal END AS c_acctbal) FROM {table}")
    assert differs(QUERIES[name](spark, folder), SQL[name], tables(folder)) == ""
