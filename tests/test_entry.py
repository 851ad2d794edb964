"""Every registered query with SQL against DuckDB, and the registration itself."""

from __future__ import annotations

import datetime
import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from stocklink.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, (list, tuple)):
        return tuple(norm(x) for x in value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return round(float(value), 5) if hasattr(value, "as_tuple") else value


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_against_sql(spark, sf_dir, con, name):
    got = entry.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = sorted((tuple(norm(r[c]) for c in columns) for r in got.collect()), key=str)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted((tuple(norm(r[i]) for i in at) for r in cursor.fetchall()), key=str)


def test_entry_and_names(spark):
    assert entry.entry(spark).columns[0] == "l_orderkey"
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalogue.QUERIES) <= set(entry.queries())


def test_import_without_the_corpus_subpackage(tmp_path):
    root = Path(entry.__file__).parent
    for source in root.rglob("*.py"):
        part = source.relative_to(root)
        if part.parts[0] in ("stocklink", "__spark_entry__.py") and "llm" not in part.parts:
            (tmp_path / part).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / part).write_text(source.read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); print(len(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    assert int(subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout) == len(catalogue.QUERIES)
