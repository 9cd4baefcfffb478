"""Every catalogue query against DuckDB, and the library without its optional subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

from sluiceway import catalogue

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(v):
    return str(v) if v is not None and v == v else None


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("nation", "region", "part", "orders", "customer", "lineitem", "events", "documents", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = catalogue.QUERIES[name](spark, sf_dir)
    want = con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    key = lambda rows: sorted(rows, key=repr)
    assert key([tuple(plain(r[c]) for c in columns) for r in df.collect()]) == key([tuple(plain(r[i]) for i in order) for r in want.fetchall()])


def test_library_does_not_need_the_subpackage():
    code = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("sluiceway.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
import importlib.util
real = importlib.util.find_spec
importlib.util.find_spec = lambda n, *a: None if n.startswith("sluiceway.llm") or n == "corpus_pipeline" else real(n, *a)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert len(e.queries()) == 78 and set(e.queries()) == set(e.oracle_sql()), len(e.queries())
import sluiceway.jobs, sluiceway.cli
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120).stderr == ""
