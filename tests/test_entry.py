"""The driver's contract, and that the rest stands without the corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from maskwright.plans.queries import ORACLES, QUERIES

ROOT = Path(__file__).resolve().parent.parent
SF = Path("/root/testdata/sf0.001")


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "sanitized", "replaced_groups", "replaced_occurrences", "status"] and df.count() > 0


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(rows):
    return sorted(tuple(map(repr, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_their_sql(spark, tables, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    rows = plain(tuple(r[c] for c in columns) for r in df.collect())
    if name in ORACLES:
        found = tables.sql(ORACLES[name])
        assert sorted(found.columns) == columns
        at = [found.columns.index(c) for c in columns]
        assert plain(tuple(r[i] for i in at) for r in found.fetchall()) == rows


def test_the_rest_stands_alone(tmp_path):
    shutil.copytree(ROOT / "maskwright", tmp_path / "maskwright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], said.stderr
