"""The driver's contract, with and without the llm folder."""

import subprocess
import sys
import textwrap
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
PLAIN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return con


def shown(v):
    return "0.0" if isinstance(v, float) and v == 0 else repr(v)


@pytest.mark.parametrize("name", PLAIN)
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    found = duck.sql(sql)
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in found.fetchall())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_rest_works_without_the_llm_folder():
    code = """
        import sys
        sys.modules["sextant.llm"] = None
        import __spark_entry__ as e
        assert e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
    """
    subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=Path(entry.__file__).parent, check=True, timeout=100)
