"""The driver contract, and the oracle comparison of the quick relational queries."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from answerlake.catalog.registry import all_entries
from answerlake.session import TABLE_NAMES
from tests.conftest import SMALL
from tools.compare import compare

QUICK = [n for n, item in all_entries().items()
         if item.sql and item.build.__module__.rsplit(".", 1)[1] in ("desk", "money", "flows")]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    return con


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns[:2] == ["query_id", "rank"] and out.count() > 0


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_needs_no_session():
    """The contract must load before any session exists."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and len(e.oracle_sql()) > 150"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)


@pytest.mark.parametrize("name", QUICK)
def test_query_matches_oracle(name, tables, duck):
    note, same = compare(name, all_entries()[name], tables, duck)
    assert same or note.endswith("EMPTY"), note
